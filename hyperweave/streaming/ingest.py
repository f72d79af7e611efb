"""Structured Streaming: SAM files that arrive in a folder become hyperedges, batch by batch.

A read must lie whole in one file. Each batch replaces its own folder, so that a batch run again leaves no double edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hyperweave import functions as fn
from hyperweave.config import Filters
from hyperweave.operators import hyperedges


def stream_hyperedges(spark: SparkSession, folder: str, contigs: DataFrame, f: Filters, out: str, checkpoint: str) -> StreamingQuery:
    f_ = F.split("value", "\t")
    lines = spark.readStream.schema("value string").text(folder).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    rows = lines.select(f_[0].alias("read_id"), f_[1].cast("int").alias("flag"), f_[2].alias("contig"), f_[4].cast("int").alias("mapq"), fn.query_length(f_[5], f_[9]).alias("qlen"), fn.aligned_length(f_[5]).alias("qaln"))

    def write(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("ordinal", F.monotonically_increasing_id())
        hyperedges.hyperedges(numbered, contigs, f).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
