"""W01 on a live call feed: the failure rate over the last N calls of each instance.

What a batch must know of the past are the last N - 1 calls of every instance. They
are kept as a small table per batch (``tails``: instances times N - 1 rows); a batch
puts its own calls behind them and rates the whole with the batch operator, which
spreads a hot instance over many tasks. (State keyed by instance would hand all
calls of a hot instance to one task, to be ordered there.) Every batch overwrites
its own folders and reads the tails of the one before, so a batch that is run again
gives the same rows.

Calls are taken in the order of their batches, and by (ts, event_id) within one: a
call that arrives late counts as made when it arrived.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.functions import constants as C
from shopflow.operators import telemetry as TL
from shopflow.plans.joins import counted_broadcast
from shopflow.sources import sinks
from shopflow.sources.storage import output_dir, run_dir
from shopflow.sources.tables import file_system
from shopflow.streaming.common import start, topic_reader

CALL_SCHEMA = "instance string, target string, event_id long, ts timestamp_ntz, error boolean, duration_s double"
_TAIL_SCHEMA = "instance string, ts timestamp_ntz, event_id long, failed boolean"


@dataclass
class FailurePaths:
    rates: str
    tails: str
    checkpoint: str


def _tail_batches(spark: SparkSession, path: str) -> list[int]:
    files, target = file_system(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def process_calls(paths: FailurePaths, calls: DataFrame, batch_id: int, window_calls: int,
                  time_limit_s: float | None = None, block_rows: int = 1 << 20) -> None:
    """Rates the calls of one batch and leaves the tails for the next one."""
    spark = calls.sparkSession
    earlier = [n for n in _tail_batches(spark, paths.tails) if n < batch_id]
    new = calls.select("instance", "ts", "event_id", TL.failed_call("error", "duration_s", time_limit_s)
                       .alias("failed"), F.lit(1).alias("arrived"))
    if earlier:
        old = spark.read.schema(_TAIL_SCHEMA).parquet(f"{paths.tails}/batch_id={earlier[-1]}")
        new = old.withColumn("arrived", F.lit(0)).unionByName(new)
    rated = TL.failure_rate(new, window_calls, block_rows=block_rows, order=("arrived", "ts", "event_id"),
                            keep=("failed",)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sinks.write_batch(rated.where("arrived = 1").drop("arrived", "failed"), paths.rates, batch_id)
        ends = rated.groupBy("instance").agg(F.max("position").alias("calls"))
        tails = rated.join(counted_broadcast(ends), "instance").where(
            F.col("position") > F.col("calls") - (window_calls - 1))
        sinks.write_batch(tails.select("instance", "ts", "event_id", "failed"), paths.tails, batch_id)
    finally:
        rated.unpersist()
    for n in earlier[:-1]:                # the last one is read if this batch is run again
        files, target = file_system(spark, f"{paths.tails}/batch_id={n}")
        files.delete(target, True)


def run_failure_stream(spark: SparkSession, topic: str, paths: FailurePaths | None = None,
                       window_calls: int = C.INVENTORY_WINDOW, time_limit_s: float | None = None,
                       options: dict[str, str] | None = None, trigger: dict | None = None,
                       block_rows: int = 1 << 20) -> FailurePaths:
    """Calls (``CALL_SCHEMA``) appended to the folder ``topic`` -> rates per call."""
    if paths is None:
        base = output_dir(spark, "failure-stream")
        paths = FailurePaths(f"{base}/rates", f"{base}/tails", run_dir(spark, "failure-stream"))
    feed = topic_reader(spark, topic, CALL_SCHEMA, "parquet", options)
    start(feed.writeStream.foreachBatch(lambda df, n: process_calls(
        paths, df, n, window_calls, time_limit_s, block_rows)), paths.checkpoint, trigger)
    return paths
