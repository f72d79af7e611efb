"""FASTA, SAM and BAM scans, and tables of bins. All give records an ordinal: order in the file carries meaning.

SAM text is split by Spark; BAM by a Python data source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperweave import functions as fn
from hyperweave.sources import bam


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, description, seq, length) in file order. Records are split at line starts with ``>``."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^>", "").alias("value"))
    record = raw.where(F.trim("value") != "").withColumn("value", F.regexp_replace("value", "\r", ""))
    head = F.substring_index("value", "\n", 1)
    seq = F.regexp_replace(F.substring(F.col("value"), F.length(head) + 2, F.length("value")), r"\s", "")
    found = record.select("file", "at", F.shiftright("at", 33).alias("split"), F.split(head, r"\s+", 2)[0].alias("name"), head.alias("description"), seq.alias("seq"))
    # places within a split of a file plus what the splits before it hold, a row for each; sequences stay where they are read
    sizes = record.groupBy("file", F.shiftright("at", 33).alias("split")).agg(F.count("*").alias("n"))
    before = sizes.select("file", "split", (F.sum("n").over(Window.orderBy("file", "split")) - F.col("n")).alias("before"))
    at = record.select(F.col("file").alias("f"), F.col("at").alias("a"), (F.row_number().over(Window.partitionBy("file", F.shiftright("at", 33)).orderBy("at")) - 1).alias("place"))
    numbered = found.join(before, ["file", "split"]).join(at, (F.col("f") == F.col("file")) & (F.col("a") == F.col("at")))
    return numbered.select((F.col("before") + F.col("place")).cast("long").alias("idx"), "name", "description", "seq", F.length("seq").cast("long").alias("length"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"), "value")
    f = F.split("value", "\t")
    return lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        "file", "ordinal", f[0].alias("read_id"), f[1].cast("int").alias("flag"), f[2].alias("contig"), f[4].cast("int").alias("mapq"),
        fn.query_length(f[5], f[9]).alias("qlen"), fn.aligned_length(f[5]).alias("qaln"),
    )


def sam_sort_order(spark: SparkSession, path: str) -> DataFrame:
    """(file, sort_order) as headers declare it."""
    head = spark.read.text(path).where(F.col("value").startswith("@HD")).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r"\tSO:(\w+)", 1).alias("sort_order"))
    return head.where("sort_order <> ''")


def sort_order(spark: SparkSession, path: str) -> str | None:
    """The order that headers declare: of several files only one that all share."""
    if path.endswith(".bam"):
        found = {bam.sort_order(p) for p in path.split(",")}
    else:
        found = {r.sort_order for r in sam_sort_order(spark, path).select("sort_order").distinct().collect()}
    return found.pop() if len(found) == 1 else None


def read_alignments(spark: SparkSession, path: str, split_bytes: int = bam.SPLIT_BYTES) -> DataFrame:
    if path.endswith(".bam"):
        spark.dataSource.register(bam.BamDataSource)
        return spark.read.format("hyperweave_bam").option("paths", path).option("splitBytes", split_bytes).load()
    return read_sam(spark, path)


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """(contig, bin) of a table with that header; of a contig given twice the last row wins."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if not {"contig", "bin"} <= set(raw.columns):
        raise ValueError("bins.tsv must have columns: contig, bin")
    return raw.select(F.monotonically_increasing_id().alias("at"), "contig", "bin").groupBy("contig").agg(F.max_by("bin", "at").alias("bin"))
