"""Every registered query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from shopflow.queries import ORACLE, QUERIES
from shopflow.sources.tables import TABLES, table_path
from tests.conftest import SMALL
from tools.check_oracle import rows_of

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SMALL, t)}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 113
    assert df.columns == ["request_id", "sku_code", "price", "quantity", "line_total"]
