"""Helpers that several operators share: input tables, shared scratch space, column names, memory of workers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES, PART_ROWS = 1 << 20, 1024
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs on this machine (local
    mode, as in tests) a temporary folder is taken and set for the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="hyperweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables in the shared folder: ``write`` cuts a lineage, survives lost executors. What is not kept goes at the end,
    or before by ``drop``. The shuffle files of a write go as soon as it is done, not when the driver collects its garbage.

    A lazy result needs the tables that it reads; those are named in ``keep`` and stay until ``clean``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/hyperweave/{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        conf, before = self.spark.conf, self.spark.conf.get(SHUFFLE_CLEANUP)
        conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(SHUFFLE_CLEANUP, before)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names that nothing reads any more."""
        gone = [p for p in self.paths if p.rsplit("/", 1)[1].rsplit("-", 1)[0] in names]
        for path in gone:
            delete(self.spark, path)
        self.paths = [p for p in self.paths if p not in gone]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, where it stays until ``clean``, and read back."""
    return Scratch(df.sparkSession).write(df, name, keep=True)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that operators keep in the shared folder; results that are still to be read are lost."""
    delete(spark, f"{scratch_dir(spark)}/hyperweave")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_share(value: Column, n: int, wanted: float) -> Column:
    """Whether a hash is among the smallest ones, of which ``n`` different values have about ``wanted``.

    Before an exact sort and limit it leaves each task a bounded part, whatever the number of tasks."""
    return F.lit(True) if wanted >= n else value <= F.lit(int(-(2**63) + wanted / n * 2**64))


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of whole rows, of about ``PART_BYTES`` of that string column and ``PART_ROWS`` rows at most."""
    texts, begin, size = batch.column(column), 0, 0
    for i in range(batch.num_rows):
        n = texts[i].as_buffer().size if texts[i].is_valid else 0
        if i > begin and (size + n > PART_BYTES or i - begin == PART_ROWS):
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def trimmed(run: Callable) -> Callable:
    """A function of batches after which the worker gives the memory that it no longer uses back to the system."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return out
