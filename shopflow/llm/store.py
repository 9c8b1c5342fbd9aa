"""Intermediate tables in the shared folder (``spark.checkpoint.dir``).

A written table cuts the lineage like ``checkpoint()`` does, survives the loss
of executors, and is compressed; ``drop`` frees it once its readers are done.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shopflow.sources.storage import run_dir


BATCH_CONF, BATCH_DEFAULT, BATCH_BYTES = (
    "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "8m")


def bounded_batches(spark: SparkSession) -> None:
    """Smaller record batches for Python workers, unless the session chose a size:
    whole texts are large rows, and a worker holds a batch in several forms."""
    now = spark.conf.get(BATCH_CONF, str(BATCH_DEFAULT))
    if now.rstrip("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def tidied(run):
    """``run`` for mapInArrow; at the end of a partition, memory that was freed goes
    back to the system. Workers live on between tasks, and two share an executor."""
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):   # not glibc
            pass
    return wrapped


class Store:
    """One run's tables. Not reused between runs."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = run_dir(spark, label)
        self.n = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self.n:02d}-{name}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table of this run; later reads of it would fail."""
        path = self.paths.pop(id(df), None)
        if path is None:
            return
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)
