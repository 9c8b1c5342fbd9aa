"""Locations for sinks, stream checkpoints and lineage cuts.

Checkpoints and lineage cuts go under the shared folder the cluster names in
``spark.checkpoint.dir``; sinks go under ``shopflow.output.dir``, or beside the
checkpoints where that is not set. A local folder of our own is only made on a
``local`` master (tests, laptops) that names none; a cluster without a shared
folder is an error, since executors and driver could not see each other's files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

OUTPUT_CONF = "shopflow.output.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only on a local master."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="shopflow-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", conf_dir)
        except Exception:  # noqa: BLE001 - core settings may be read-only at run time
            pass
    if sc is None:
        return conf_dir.rstrip("/")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir().rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh, never reused folder for one run's checkpoints or lineage cuts."""
    return f"{shared_dir(spark)}/shopflow-runs/{label}-{uuid.uuid4().hex}"


def output_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for one run's sinks, apart from the checkpoints if the
    session names a place for them."""
    base = spark.conf.get(OUTPUT_CONF, None)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}" if base else run_dir(spark, f"{label}-sinks")
