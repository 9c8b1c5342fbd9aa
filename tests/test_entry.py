"""The driver's contract survives a missing subpackage or library."""

from __future__ import annotations

import subprocess
import sys

import pytest

from tests.conftest import ROOT

BLOCK = """
import sys
for name in {names}:
    sys.modules[name] = None          # importing it fails
import __spark_entry__ as E
names = set(E.queries())
assert set(E.oracle_sql()) <= names
print(len([n for n in names if not n.startswith("op") or n.startswith("order")]), "op7_secret_scan" in names, "pipeline" in names)
"""


@pytest.mark.parametrize("names, operators", [((), True), (("tiktoken",), False), (("ahocorasick",), False),
                                              (("corpus_pipeline",), True)])
def test_missing_modules(names, operators):
    from shopflow.queries import QUERIES
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", BLOCK.format(names=names)], cwd=ROOT, text=True,
                         capture_output=True, check=True).stdout.split()
    with_llm = (ROOT / "shopflow/llm/queries.py").exists()
    with_pipeline = with_llm and operators and (ROOT / "corpus_pipeline.py").exists() and not names
    assert out[1] == str(operators and with_llm) and out[2] == str(with_pipeline)
    assert int(out[0]) == len(QUERIES) + (out[2] == "True")
