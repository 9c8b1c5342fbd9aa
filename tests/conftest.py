from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from shopflow.session import build_session
    s = build_session("local[4]", app_name="shopflow-tests", shuffle_partitions=8)
    # Tests only: a checkpoint folder of our own where the session names none.
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shopflow-test-ckpt-"))
    yield s
    s.stop()
