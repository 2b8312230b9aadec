"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that go to a Python worker together where whole texts do: bounds what an executor and its workers hold of them.
BATCH_ROWS = 2_000


def take(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and nothing else.

    An exactly matching name is preferred over one that differs in case, and the first over later
    ones, so extra columns with clashing names never make a reference ambiguous.
    """
    have = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])

    def index(name: str) -> int:
        if name in have:
            return have.index(name)
        low = [c.lower() for c in have]
        if name.lower() in low:
            return low.index(name.lower())
        raise ValueError(f"no column {name!r} among {have}")

    return plain.select(*[F.col(f"_c{index(n)}").alias(n) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where a session on one machine (master local) leaves it unset a temporary folder is used; a
    cluster without one is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="glotmill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


@contextlib.contextmanager
def no_leftovers(spark: SparkSession):
    """Queries that run inside delete their shuffle files when they have ended, not some time later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    with no_leftovers(df.sparkSession):
        return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """From now on at most BATCH_ROWS rows go to a Python worker together. It stays set, as results are computed later; it sets no result."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Return what a Python worker has freed to the system. Workers live on after their tasks, and their memory counts beside the executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def row_key(*cols: Column | str) -> Column:
    """A 64-bit key of the row's identifying columns; rows that agree in all of them share it."""
    return F.xxhash64(*cols)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, everything else as it is. For short strings."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Scratch:
    """Intermediate tables in the shared folder: computed once, readable by every executor, freed when used."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table, or add it to one, and read that back; the shuffle files that made it go."""
        with no_leftovers(self.spark):
            df.write.mode("append").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def keep_all(self, parts: Iterable[DataFrame], name: str) -> DataFrame:
        """Write one after another into one table, each with no shuffle files of the ones before, and read it back."""
        for df in parts:
            out = self.keep(df, name)
        return out

    def free(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
