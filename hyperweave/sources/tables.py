"""Driver tables, and the adapter that reads order lines as alignments of reads to contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a read, a line an alignment, a part a contig; some lines are secondary, unmapped or supplementary."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    flag = F.when(F.col("l_linenumber") == 7, 256).when(F.col("l_linenumber") == 6, 4).when(F.col("l_linenumber") == 5, 2048).otherwise(0)
    return lines.select(
        F.row_number().over(order).cast("long").alias("ordinal"), F.col("l_orderkey").alias("read_id"), flag.alias("flag"), F.col("l_partkey").alias("contig"),
        F.col("l_quantity").cast("int").alias("mapq"), F.floor("o_totalprice").cast("long").alias("qlen"), F.floor("l_extendedprice").cast("long").alias("qaln"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_partkey").alias("name"))


def some_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without one part in ten: for operators that are about contigs outside the universe."""
    return universe(spark, sf_dir).where("idx % 10 <> 3")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("v"), F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("seq"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("long").alias("cluster"))
