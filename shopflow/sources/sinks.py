"""Sinks: plain appends and replay-safe per-batch folders.

A streaming ``foreachBatch`` may run a batch again after a failure, and its rows
may then be fewer, or none (stock is read anew). Each batch owns the folder
``batch_id=<n>`` and overwrites it as a whole, also with no rows, so a replay
replaces whatever the first attempt wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.sources.tables import file_system


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows to a table folder."""
    df.write.mode("append").format(fmt).save(path)


def write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """Replace exactly what batch ``batch_id`` wrote to ``path``."""
    df.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")


def clear_batch(spark: SparkSession, paths: tuple[str, ...], batch_id: int) -> bool:
    """Remove what batch ``batch_id`` wrote to the sinks. False, and nothing done,
    where a sink would be left without any folder to read: the batch then writes
    its empty table."""
    own = f"batch_id={batch_id}"
    for path in paths:
        files, target = file_system(spark, path)
        others = [f for f in files.listStatus(target) if f.getPath().getName() != own] \
            if files.exists(target) else []
        if not others:
            return False
    for path in paths:
        files, target = file_system(spark, f"{path}/{own}")
        files.delete(target, True)
    return True


def read_sink(spark: SparkSession, path: str, schema: str | None = None,
              fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path)


def stored_before(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame | None:
    """The rows that earlier batches stored (what a replayed batch wrote itself is
    left out); None while nothing is stored."""
    files, target = file_system(spark, path)
    if not files.exists(target):
        return None
    return spark.read.schema(f"{schema}, batch_id long").parquet(path).where(
        F.col("batch_id") < batch_id).drop("batch_id")
