"""The corpus pipeline: quality classifier, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each to the shared folder as Parquet and
reads it again as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm import jaccard_join, mixing, packing, pii, quality_gam
from hyperweave.llm.common import free_name, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; learned from the labels of this stage's own documents."""
    return quality_gam.quality_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; of repeated rows one stays.

    Rows without an id stay, as do documents without words, which are linked with nothing."""
    found = jaccard_join.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.join(found, "doc_id", "left_anti").select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; ``n_chars`` follows the text."""
    return pii.redact_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated or left out to bring their sources to the production weights, in a global random order."""
    copy, key = free_name(docs, "copy"), free_name(docs, "mix_key")
    return mixing.mix_sources(docs, mixing.WEIGHTS, mixing.OTHER_WEIGHT, copy_name=copy, key_name=key).drop(copy, key)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, one row for each piece."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mixing_weights),
    ("packing", pack),
]

# No stage but mixing can be expressed in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs
