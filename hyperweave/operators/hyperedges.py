"""From alignments to weighted hyperedges.

``alignments``: ordinal, read_id, flag, contig, mapq, qlen, qaln; ``contigs``: idx, name. One shuffle by read serves
the merge per contig and all windows per read; the contig join is left to the optimizer (broadcast when small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperweave import functions as fn
from hyperweave.config import Filters

SECONDARY_OR_UNMAPPED = 0x104


def mapped(alignments: DataFrame) -> DataFrame:
    """Primary and supplementary alignments."""
    return alignments.where(F.col("flag").bitwiseAND(F.lit(SECONDARY_OR_UNMAPPED)) == 0)


def passing(alignments: DataFrame, f: Filters) -> DataFrame:
    return mapped(alignments).where((F.col("mapq") >= f.mapq_min) & (F.col("qaln") >= f.segment_min_bases))


def last_index(contigs: DataFrame) -> DataFrame:
    """name -> idx; of a name given twice the last one."""
    return contigs.groupBy("name").agg(F.max("idx").alias("idx"))


def merge_contigs(alignments: DataFrame, contigs: DataFrame, f: Filters) -> DataFrame:
    """A row per read and contig: best mapq, longest alignment, first ordinal, read length, idx (null: unknown contig)."""
    by_read = passing(alignments, f).repartition("read_id")
    merged = by_read.groupBy("read_id", "contig").agg(F.max("mapq").alias("mapq"), F.max("qaln").alias("qaln"), F.min("ordinal").alias("ordinal"), F.max("qlen").alias("qlen"), F.count("*").alias("segments"))
    return merged.join(last_index(contigs).withColumnRenamed("name", "contig"), "contig", "left")


def hyperedges(alignments: DataFrame, contigs: DataFrame, f: Filters) -> DataFrame:
    """edge_id (the read), k, r, q_read, q_prime, w, members: the first contigs by appearance, up to the cap."""
    per_read = Window.partitionBy("read_id")
    known = merge_contigs(alignments, contigs, f).withColumn("qlen", F.max("qlen").over(per_read)).where("idx IS NOT NULL")
    known = known.withColumn("k_all", F.count("*").over(per_read)).where(F.col("k_all") >= f.min_segments_per_read)
    known = known.withColumn("pos", F.row_number().over(per_read.orderBy("ordinal"))).where(F.col("pos") <= f.max_hyperedge_size)
    edges = known.groupBy("read_id").agg(
        F.count("*").alias("k"), F.max("qlen").alias("qlen"), F.sum("qaln").alias("qaln"),
        F.exp(F.avg(F.log(fn.mapping_probability(F.col("mapq"))))).alias("q_read"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda s: s["idx"]).alias("members"),
    )
    edges = edges.withColumn("r", fn.explained_fraction(F.col("qaln"), F.col("qlen"))).withColumn("q_prime", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r") * F.col("q_read"))))
    return edges.where("k >= 2").select(F.col("read_id").alias("edge_id"), "k", "r", "q_read", "q_prime", fn.edge_weight(F.col("q_prime"), F.col("k")).alias("w"), "members")


def in_universe(alignments: DataFrame, contigs: DataFrame, f: Filters) -> tuple[DataFrame, DataFrame]:
    """Passing alignments to known contigs, and to unknown ones."""
    rows, names = passing(alignments, f), contigs.select(F.col("name").alias("contig"))
    return rows.join(names, "contig", "left_semi"), rows.join(names, "contig", "left_anti")


def read_bundles(alignments: DataFrame) -> DataFrame:
    """Measures of each read over its mapped alignments."""
    out = mapped(alignments).groupBy("read_id").agg(F.sum("qaln").alias("qaln"), F.max("qlen").alias("qlen"), F.countDistinct("contig").alias("n_contigs"), F.min("qaln").alias("min_segment_qaln"), F.avg("mapq").alias("mean_mapq"))
    return out.select("read_id", fn.explained_fraction(F.col("qaln"), F.col("qlen")).alias("explained_frac"), "n_contigs", "min_segment_qaln", "mean_mapq")


def funnel(alignments: DataFrame, contigs: DataFrame, f: Filters) -> DataFrame:
    """One row of the eight counters, by aggregation (never accumulators: retried tasks would count twice)."""
    good = (F.col("mapq") >= f.mapq_min) & (F.col("qaln") >= f.segment_min_bases)
    rows = mapped(alignments).withColumn("good", good).join(last_index(contigs).withColumnRenamed("name", "contig"), "contig", "left")
    reads = rows.groupBy("read_id").agg(F.max("good").alias("good"), F.countDistinct(F.when(F.col("good") & F.col("idx").isNotNull(), F.col("contig"))).alias("k"), F.sum(F.when(F.col("good") & F.col("idx").isNull(), 1).otherwise(0)).alias("discarded"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    enough = F.col("good") & (F.col("k") >= f.min_segments_per_read)
    return reads.agg(
        F.count("*").alias("reads_total"), count(~F.col("good")).alias("reads_filtered_low_quality"), count(F.col("good")).alias("reads_pass_segments"),
        F.coalesce(F.sum("discarded"), F.lit(0)).cast("long").alias("contig_hits_discarded"), count(F.col("good") & (F.col("k") < f.min_segments_per_read)).alias("reads_filtered_small"),
        count(enough).alias("reads_pass_contigs"), count(enough & (F.col("k") > f.max_hyperedge_size)).alias("edges_truncated"), count(enough & (F.lit(f.max_hyperedge_size) > 0) & (F.col("k") > 0)).alias("edges_yielded"),
    )


PROBE_SPAN = 1 << 20


def sort_order_probe(alignments: DataFrame, first: int | None = None) -> DataFrame:
    """Reads that come in more than one run of consecutive records (none: the file is grouped by read).

    ``first``: look at so many records at the beginning of each file only, as a probe. Records are compared within spans of ``PROBE_SPAN``
    ordinals; a read that goes on from one span to the next is corrected by the spans' ends, a row for each."""
    files = [c for c in ("file",) if c in alignments.columns]
    rows = alignments.select(*files, "read_id", "ordinal", F.floor(F.col("ordinal") / PROBE_SPAN).alias("span"))
    if first is not None:  # ordinals of a file's first split go on without gaps, those of others are far higher
        begin = F.lit(0)
        if files:
            rows = rows.join(rows.groupBy(*files).agg(F.min("ordinal").alias("begin")), "file")
            begin = F.col("begin")
        rows = rows.where(F.col("ordinal") - begin < first)
    before = F.lag("read_id").over(Window.partitionBy(*files, "span").orderBy("ordinal"))
    starts = rows.select(*files, "read_id", (~F.col("read_id").eqNullSafe(before)).cast("long").alias("starts"))
    ends = rows.groupBy(*files, "span").agg(F.min_by(F.struct("read_id"), "ordinal").alias("head"), F.max_by(F.struct("read_id"), "ordinal").alias("tail"))
    goes_on = ends.withColumn("before", F.lag("tail").over(Window.partitionBy(*files).orderBy("span"))).where(F.col("before").isNotNull() & F.col("head.read_id").eqNullSafe(F.col("before.read_id")) & F.col("head.read_id").isNotNull())
    every = starts.unionByName(goes_on.select(*files, F.col("head.read_id").alias("read_id"), F.lit(-1).cast("long").alias("starts")))
    return every.groupBy(*files, "read_id").agg(F.sum("starts").alias("runs")).where("runs > 1")
