"""Sinks: tables, statistics, sequences by bin, hyperedges. Results that tools read are single files under plain names."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from hyperweave import functions as fn


def _files(spark: SparkSession, folder: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _rename(spark: SparkSession, folder: str, path: str) -> None:
    """The one part file of ``folder`` becomes ``path``."""
    fs, at = _files(spark, folder)
    (part,) = [f.getPath() for f in fs.listStatus(at(folder)) if f.getPath().getName().startswith("part-")]
    fs.delete(at(path), True)
    if not fs.rename(part, at(path)):
        raise OSError(f"{path} could not be written")


def _single(df: DataFrame, path: str, write: Callable[[DataFrameWriter, str], None]) -> None:
    spark, parts = df.sparkSession, f"{path}.parts"
    write(df.coalesce(1).write.mode("overwrite"), parts)
    _rename(spark, parts, path)
    fs, at = _files(spark, parts)
    fs.delete(at(parts), True)


def write_tsv(df: DataFrame, path: str) -> None:
    """One file with a header, in the order of ``df``; for results of a row per contig or bin."""
    _single(df, path, lambda w, p: w.option("sep", "\t").option("header", True).option("quote", "").csv(p))


def write_json(df: DataFrame, path: str) -> None:
    _single(df, path, lambda w, p: w.json(p))


def write_text(df: DataFrame, path: str) -> None:
    _single(df, path, lambda w, p: w.text(p))


def write_edges(edges: DataFrame, path: str, per_file: int = 200_000) -> None:
    edges.write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)


def bins(contigs: DataFrame, labels: DataFrame) -> DataFrame:
    """(contig, bin) in order of the contigs, from ``labels(v, cluster)``."""
    return contigs.join(labels, contigs["idx"] == labels["v"]).orderBy("idx").select(F.col("name").alias("contig"), F.concat(F.lit("bin_"), F.col("cluster").cast("string")).alias("bin"))


def bin_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("cluster").alias("bin")).agg(F.count("*").alias("num_contigs")).orderBy(F.desc("num_contigs"), "bin")


def assigned(contigs: DataFrame, bin_table: DataFrame) -> DataFrame:
    """Contigs that have a bin, with the bin's file name."""
    return contigs.join(bin_table.withColumnRenamed("contig", "name"), "name").withColumn("bin", fn.safe_name(F.col("bin")))


def fasta_records(with_bins: DataFrame) -> DataFrame:
    """(bin, idx, record): sequences wrapped at 60 letters."""
    wrapped = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    return with_bins.select("bin", "idx", F.concat(F.lit(">"), "description", F.lit("\n"), wrapped).alias("record"))


def write_fasta_by_bin(with_bins: DataFrame, path: str) -> None:
    """``<bin>.fasta`` for each bin, records in the order of contigs. A bin, one file, is written by one task as a stream."""
    spark, parts = with_bins.sparkSession, f"{path}/_parts"
    records = fasta_records(with_bins).withColumn("folder", F.col("bin"))
    records.repartition("bin").sortWithinPartitions("bin", "idx").select("folder", F.col("record").alias("value")).write.mode("overwrite").partitionBy("folder").text(parts)
    fs, at = _files(spark, parts)
    for folder in fs.listStatus(at(parts)):  # one for each bin; files are only renamed
        if folder.isDirectory():
            name = unquote(folder.getPath().getName().removeprefix("folder="))
            _rename(spark, folder.getPath().toString(), f"{path}/{name}.fasta")
    fs.delete(at(parts), True)


def bin_stats(with_bins: DataFrame) -> DataFrame:
    return with_bins.groupBy("bin").agg(F.count("*").alias("num_contigs"), F.sum(F.length("seq").cast("long")).alias("total_bases")).orderBy(F.desc("num_contigs"), F.desc("total_bases"), "bin")
