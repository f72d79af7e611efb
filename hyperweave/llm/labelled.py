"""Text statistics as features, and bounded samples of labelled rows to learn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperweave.llm import textkernel
from hyperweave.llm.common import hash_share, parts, trimmed

MAX_LABELLED = 8_000

# Features as (numerator, denominator) of text statistics; "1" is 1. Both forms below derive from this table.
FEATURES = {
    "words": ("n_words", "1"),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digit", "word_chars"),
    "sentence_ends": ("n_sentence_end", "n_words"),
    "bangs": ("n_bangs", "n_words"),
    "other_marks": ("n_other_ascii", "n_words"),
    "non_ascii": ("n_lead", "word_chars"),
    "distinct": ("n_distinct_words", "n_words"),
}


def feature_matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    one = np.ones(len(stats["n_words"]), np.int64)
    get = lambda k: one if k == "1" else stats[k]
    return np.column_stack([get(a) / np.maximum(get(b), 1) for a, b in FEATURES.values()])


def feature_column(name: str) -> Column:
    """The same value as ``feature_matrix`` has, from columns of the statistics."""
    a, b = FEATURES[name]
    return F.col(a).cast("double") if b == "1" else F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, all of ``STATS``) of each row's whole text; a null text is empty. One narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                stats = textkernel.text_stats(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(stats[k]) for k in textkernel.STATS)], names=["doc_id", *textkernel.STATS])

    took = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return took.mapInArrow(trimmed(run), "doc_id long, " + ", ".join(f"{k} long" for k in textkernel.STATS))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column | None = None, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of at most ``limit`` labelled documents, those with the smallest hashes of their ids.

    ``keep``: condition on labels' ``doc_id``. Null ids and labels are left out; of labels that are given twice for an
    id, and of documents that are, one is taken. Only the sample, of this bounded size, comes to the driver.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    if keep is not None:
        some = some.where(keep)
    some = some.where(hash_share(F.xxhash64("doc_id"), some.count(), 1.25 * limit + 100))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    stats = with_stats(docs.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi"))
    got = stats.dropDuplicates(["doc_id"]).toPandas()
    label = some.groupBy("doc_id").agg(F.min("label").alias("label")).toPandas().set_index("doc_id")["label"]
    got = got[got.doc_id.isin(label.index)].sort_values("doc_id", ignore_index=True)
    return feature_matrix({k: got[k].to_numpy() for k in textkernel.STATS}), label.loc[got.doc_id].to_numpy() if len(got) else np.empty(0, np.int64)
