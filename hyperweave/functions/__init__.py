"""Column functions: alignment quality, k-mers, names, safe inverses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mapping_probability(mapq: Column) -> Column:
    return F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.lit(1.0) - F.pow(F.lit(10.0), -mapq / F.lit(10.0))))


def explained_fraction(aligned: Column, length: Column) -> Column:
    return F.when(length > 0, F.least(F.lit(1.0), aligned / F.greatest(F.lit(1), length))).otherwise(0.0)


def edge_weight(q: Column, k: Column) -> Column:
    return q * F.lit(2.0) / (k - 1)


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def kmers(sequence: Column, k: int = 4) -> Column:
    n = F.length(sequence)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(sequence, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def safe_name(name: Column) -> Column:
    clean = F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
    return F.when(clean == "", "bin").otherwise(clean)


def inverse_root(degree: Column) -> Column:
    """1 / sqrt(degree), and 1 where the degree is not positive."""
    return F.lit(1.0) / F.sqrt(F.when(degree > 0, degree).otherwise(1.0))


def query_length(cigar: Column, seq: Column) -> Column:
    """Length of the read part in a SAM record: of SEQ, or by the operations M I S = X where SEQ is ``*``."""
    return F.when((seq != "*") & (seq != ""), F.length(seq)).otherwise(_cigar_sum(cigar, "MIS=X")).cast("int")


def aligned_length(cigar: Column) -> Column:
    return _cigar_sum(cigar, "MI=X").cast("int")


def _cigar_sum(cigar: Column, ops: str) -> Column:
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), 1), F.lit(0), lambda s, x: s + x.cast("int"))
