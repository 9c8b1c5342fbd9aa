"""Metric samples per scrape interval and application, as a stream.

Watermarks need a ``timestamp`` column, the samples carry ``timestamp_ntz``:
the event time is cast (session time zone UTC) for the stream and cast back in
the output. Append mode emits a window once the watermark has passed its end,
so the state stays bounded; windows still open at the end of a run are emitted
by a later run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.operators import telemetry as T
from shopflow.sources import fixtures as fx
from shopflow.sources.storage import output_dir, run_dir
from shopflow.sources.tables import file_system, read_table, table_path
from shopflow.streaming.common import bounded, start, use_rocksdb


def sample_feed(spark: SparkSession, sf_dir: str, options: dict[str, str] | None = None) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).options(**bounded("parquet", options))
    path = table_path(sf_dir, "events")
    files, target = file_system(spark, path)
    if not files.getFileStatus(target).isDirectory():
        # A table of one file: a stream reads folders.
        reader, path = reader.option("pathGlobFilter", "events.parquet"), sf_dir
    return fx.calls_from_events(reader.parquet(path))


def rollup_stream(samples: DataFrame, targets: DataFrame, interval: str, delay: str) -> DataFrame:
    labelled = T.label_samples(samples, targets).withColumn("ts", F.col("ts").cast("timestamp"))
    agg = T.rollup(labelled.withWatermark("ts", delay), interval)
    return agg.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      "application", "samples", "total_duration_s", "max_duration_s")


def run_rollup_stream(spark: SparkSession, sf_dir: str, interval: str, delay: str,
                      options: dict[str, str] | None = None, base: str | None = None,
                      trigger: dict | None = None) -> str:
    """Run until the available input is processed (or, with another trigger, on);
    ``base`` reuses an earlier run's output and checkpoint (a restart)."""
    use_rocksdb(spark)
    out_dir, checkpoint = (f"{base}/out", f"{base}/_checkpoint") if base else (
        output_dir(spark, "rollup-stream"), run_dir(spark, "rollup-stream"))
    out = rollup_stream(sample_feed(spark, sf_dir, options), fx.targets(spark), interval, delay)
    start(out.writeStream.outputMode("append").format("parquet").option("path", out_dir),
          checkpoint, trigger)
    return out_dir
