"""Where jobs may write, and what the entry does without the optional subpackage."""

from __future__ import annotations

import subprocess
import sys

import pytest

from shopflow.sources import storage
from tests.conftest import ROOT


class _Session:
    """A session on a given master without a shared folder."""

    def __init__(self, master):
        conf = {"spark.master": master}
        self.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: conf.get(k, d)),
                                      "set": staticmethod(conf.__setitem__)})
        folder = []
        self.sparkContext = type("Context", (), {
            "getCheckpointDir": staticmethod(lambda: folder[0] if folder else None),
            "setCheckpointDir": staticmethod(folder.append)})


def test_a_cluster_without_shared_folder_is_an_error():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(_Session(master))


def test_sinks_have_a_place_of_their_own(spark, tmp_path):
    spark.conf.set(storage.OUTPUT_CONF, str(tmp_path))
    try:
        assert storage.output_dir(spark, "x").startswith(f"{tmp_path}/x-")
        assert not storage.run_dir(spark, "x").startswith(str(tmp_path))
    finally:
        spark.conf.unset(storage.OUTPUT_CONF)


def test_entry_works_without_the_training_data_folder(tmp_path):
    """Everything else imports and registers when that subpackage is not there."""
    package = tmp_path / "shopflow"
    package.mkdir()
    for item in (ROOT / "shopflow").iterdir():
        if item.name not in ("llm", "__pycache__"):
            (package / item.name).symlink_to(item)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = ("import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); "
            "assert q.keys() == o.keys(); print(len(q))")
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, timeout=120, check=False)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 40
