"""Tetranucleotide frequencies of sequences ``(v, seq)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperweave import functions as fn

LETTERS = "ACGT"
CHUNK = 1 << 20
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(LETTERS):
    _CODE[[ord(_c), ord(_c.lower())]] = _i


def canonical_dictionary(spark: SparkSession, k: int = 4) -> DataFrame:
    """(kmer, feature): the canonical k-mers in order."""
    words = spark.range(4**k).select(F.concat(*[F.substring(F.lit("ACGT"), (F.shiftright("id", 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)]).alias("kmer"))
    found = words.select(fn.canonical(F.col("kmer")).alias("kmer")).distinct()
    return found.select("kmer", (F.row_number().over(Window.orderBy("kmer")) - 1).cast("long").alias("feature"))


def canonical_numbers(k: int) -> tuple[np.ndarray, list[str]]:
    """(number of the canonical k-mer for each k-mer, the canonical ones in order); two bits a letter, the first highest."""
    words = np.arange(4**k)
    digits = [(words >> 2 * i) & 3 for i in range(k)]
    reverse = sum((3 - d) << 2 * (k - 1 - i) for i, d in enumerate(digits))
    kept, number = np.unique(np.minimum(words, reverse), return_inverse=True)
    return number, ["".join(LETTERS[(w >> 2 * (k - 1 - i)) & 3] for i in range(k)) for w in kept.tolist()]


def count_words(raw: np.ndarray, k: int) -> np.ndarray:
    """How often each k-mer occurs in a sequence's bytes, in either case; those with other letters than ACGT don't count."""
    out = np.zeros(4**k, np.int64)
    for at in range(0, max(0, len(raw) - k + 1), CHUNK):
        codes = _CODE[raw[at : at + CHUNK + k - 1]]
        n = len(codes) - k + 1
        word, other = np.zeros(n, np.int64), np.zeros(n, bool)
        for i in range(k):
            word = word << 2 | codes[i : i + n]
            other |= codes[i : i + n] > 3
        out += np.bincount(word[~other], minlength=4**k)
    return out


def kmer_counts(sequences: DataFrame, min_length: int, k: int = 4) -> DataFrame:
    """(v, kmer, cnt) of sequences of ``min_length`` letters or more; k-mers with other letters than ACGT don't count.

    One narrow pass over bytes, in time proportional to their number; at most 136 rows (k = 4) leave a sequence. Rows of
    the same ``v`` are added up. Null and short sequences give nothing."""
    number, names = canonical_numbers(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kmer, cnt = [], [], []
            for i, seq in enumerate(batch.column(1)):
                counts = np.bincount(number, count_words(np.frombuffer(seq.as_buffer(), np.uint8), k), len(names))
                there = np.flatnonzero(counts)
                rows.append(np.full(len(there), i))
                kmer.append(there)
                cnt.append(counts[there].astype(np.int64))
            if rows:
                rows, kmer, cnt = map(np.concatenate, (rows, kmer, cnt))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(names, pa.string()).take(pa.array(kmer)), pa.array(cnt)], names=["v", "kmer", "cnt"])

    long = sequences.where(F.length("seq") >= max(min_length, k)).select("v", F.col("seq").cast("binary").alias("seq"))
    counted = long.mapInArrow(run, f"v {sequences.schema['v'].dataType.simpleString()}, kmer string, cnt long")
    return counted.groupBy("v", "kmer").agg(F.sum("cnt").alias("cnt"))


def tnf(counts: DataFrame) -> DataFrame:
    """Counts with values scaled to length one for each sequence."""
    norm = F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(Window.partitionBy("v")))
    return counts.select("v", "kmer", "cnt", (F.col("cnt") / norm).alias("val"))


def feature_vectors(values: DataFrame, dictionary: DataFrame, vertices: DataFrame) -> DataFrame:
    """Dense (v, features) of every vertex; sequences without any k-mer have zeros."""
    n = dictionary.count()
    cells = values.join(F.broadcast(dictionary), "kmer").groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("feature", "val"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    return vertices.join(cells, "v", "left").select("v", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(dense).alias("features"))
