"""The values FIXTURES.md records for the fixtures at sf0.01."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

import __spark_entry__ as E
from shopflow.operators import telemetry as TL
from shopflow.sources import fixtures as fx
from tests.conftest import MEDIUM


def test_accepted_requests_and_line_totals(spark):
    acc = E.queries()["orders_in_stock"](spark, MEDIUM)
    row = acc.agg(F.count(F.lit(1)).alias("n"), F.sum("line_total").alias("s")).collect()[0]
    assert row.n == 1194
    assert row.s == Decimal("1568726293.94")


def test_flagged_calls_error_only(spark):
    calls = fx.calls(spark, MEDIUM).withColumn("failed", F.coalesce("error", F.lit(False)))
    assert TL.failure_rate(calls, 5).where("flagged").count() == 579
    assert TL.failure_rate(calls, 10).where("flagged").count() == 329
