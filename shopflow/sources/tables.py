"""Readers for the source tables (one parquet dataset per table).

Only ``spark.read`` is used, so Catalyst prunes columns and pushes filters into
the parquet scan; a cluster may swap the format (``jdbc``, a document store)
without touching the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a location, wherever it is stored."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def read_table(spark: SparkSession, sf_dir: str, name: str,
               fmt: str = "parquet", options: dict[str, str] | None = None) -> DataFrame:
    """A source table. Formats without files (``jdbc``) are named by ``options``
    alone (``dbtable`` defaults to the table's name)."""
    reader = spark.read.format(fmt)
    if fmt == "jdbc":
        return reader.options(**({"dbtable": name} | (options or {}))).load()
    return reader.options(**(options or {})).load(table_path(sf_dir, name))
