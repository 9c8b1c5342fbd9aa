"""Order acceptance semantics on hand-made rows (FIXTURES.md edge cases)."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import functions as F

from shopflow.operators import orders as O

REQ_SCHEMA = ("request_id string, sku_code string, price decimal(18,2), quantity int, "
              "user_details struct<email:string,first_name:string,last_name:string>")
INV_SCHEMA = "id bigint, sku_code string, quantity int"
USER = ("a@example.com", "A", "B")


def _outcomes(spark, reqs, inv):
    r = spark.createDataFrame(reqs, REQ_SCHEMA)
    i = spark.createDataFrame(inv, INV_SCHEMA)
    return {row.request_id: row.outcome
            for row in O.with_outcome(O.with_stock_flag(r, i)).collect()}


def test_quantity_must_equal_stock(spark):
    out = _outcomes(spark, [("r1", "s", Decimal("1.00"), 3, USER), ("r2", "s", Decimal("1.00"), 5, USER)],
                    [(1, "s", 5)])
    assert out == {"r1": O.OUT_OF_STOCK, "r2": O.ACCEPTED}


def test_duplicate_stock_rows_do_not_multiply(spark):
    r = spark.createDataFrame([("r1", "s", Decimal("2.00"), 2, USER)], REQ_SCHEMA)
    i = spark.createDataFrame([(1, "s", 2), (2, "s", 2)], INV_SCHEMA)
    assert O.in_stock(r, i).count() == 1
    assert O.with_stock_flag(r, i).count() == 1


def test_null_fields(spark):
    out = _outcomes(spark, [
        ("price", "s", None, 1, USER),
        ("user", "s", Decimal("1.00"), 1, None),
        ("email", "s", Decimal("1.00"), 1, (None, "A", "B")),
        ("qty", "s", Decimal("1.00"), None, USER),
        ("qty_oos", "x", None, 1, None),
    ], [(1, "s", 1), (2, "s", None)])
    assert out == {"price": O.INVALID, "user": O.INVALID, "email": O.INVALID,
                   "qty": O.OUT_OF_STOCK, "qty_oos": O.OUT_OF_STOCK}


def test_zero_and_negative_quantity_pass(spark):
    out = _outcomes(spark, [("z", "s", Decimal("1.00"), 0, USER), ("n", "t", Decimal("1.00"), -1, USER)],
                    [(1, "s", 0), (2, "t", -1)])
    assert out == {"z": O.ACCEPTED, "n": O.ACCEPTED}


def test_lookup_failure_is_not_in_stock(spark):
    r = spark.createDataFrame([(k, "t" if k != "r3" else "none", Decimal("1.00"), 1, USER)
                               for k in ("r1", "r2", "r3")], REQ_SCHEMA)
    stock = spark.createDataFrame([(1, "t", 1)], INV_SCHEMA)
    got = {row.request_id: (row.in_stock, row.lookup_failed)
           for row in O.stock_fallback(r, stock, F.when(F.col("request_id") == "r1", True)).collect()}
    assert got == {"r1": (False, True), "r2": (True, False), "r3": (False, False)}


def test_line_total_and_order_row(spark):
    r = spark.createDataFrame([("r1", "s", Decimal("19.99"), 3, USER)], REQ_SCHEMA)
    o = O.build_orders(r, as_of=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).collect()[0]
    assert o.price == Decimal("59.97")
    assert dict(O.build_orders(r).dtypes)["price"] == "decimal(29,2)"
    assert re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", o.order_number)
    again = O.build_orders(r).collect()[0]
    assert again.order_number == o.order_number          # deterministic across runs


def test_largest_line_total(spark):
    r = spark.createDataFrame([("r1", "s", Decimal("9999999999999999.99"), 2_000_000_000, USER)], REQ_SCHEMA)
    assert O.build_orders(r).first().price == Decimal("9999999999999999.99") * 2_000_000_000


def test_a_request_without_key_gets_no_number(spark):
    r = spark.createDataFrame([(None, "s", Decimal("1.00"), 1, USER), (None, "s", Decimal("1.00"), 1, USER)],
                              REQ_SCHEMA)
    assert [x.order_number for x in O.build_orders(r).collect()] == [None, None]
    stock = spark.createDataFrame([(1, "s", 1)], INV_SCHEMA)
    flagged = O.with_outcome(O.with_stock_flag(r, stock)).collect()
    assert [x.outcome for x in flagged] == [O.INVALID, O.INVALID]


def test_ids_go_on_from_the_stored_ones(spark):
    df = spark.createDataFrame([("b",), ("a",)], "order_number string")
    first = O.surrogate_ids(df)
    again = O.surrogate_ids(df, after=O.last_id(first)).orderBy("id").collect()
    assert [(x.id, x.order_number) for x in again] == [(3, "a"), (4, "b")]
    assert O.last_id(None) == 0


def test_response_text(spark):
    df = spark.createDataFrame([("r1", "sku_9", O.OUT_OF_STOCK), ("r2", "sku_1", O.ACCEPTED)],
                               "request_id string, sku_code string, outcome string")
    got = {r.request_id: (r.status, r.body) for r in O.order_response(df).collect()}
    assert got["r1"] == (500, "Product with Skucode sku_9is out of stock")
    assert got["r2"] == (201, "Order Placed Successfully")


def test_surrogate_ids_dense_in_key_order(spark):
    keys = [f"k{i:05d}" for i in range(997, 0, -1)]
    df = spark.createDataFrame([(k,) for k in keys], "order_number string").repartition(7)
    got = O.surrogate_ids(df).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 998))
    assert [r.order_number for r in got] == sorted(keys)


def test_unique_order_numbers(spark):
    df = spark.createDataFrame([("n1", "b"), ("n1", "a"), ("n2", "c")], "order_number string, request_id string")
    got = {r.order_number: (r.request_id, r.copies) for r in O.unique_order_numbers(df).collect()}
    assert got == {"n1": ("a", 2), "n2": ("c", 1)}
    hist = spark.createDataFrame([("n2",)], "order_number string")
    assert [r.order_number for r in O.new_order_numbers(df, hist).collect()] == ["n1", "n1"]


def test_stock_predicate_is_exact(spark):
    from shopflow.sources import fixtures as fx
    from tests.conftest import MEDIUM
    inv = fx.inventory(spark, MEDIUM)
    assert inv.where(O.stock_predicate("sku_1", 28)).count() == 1
    assert inv.where(O.stock_predicate("sku_01", 28)).count() == 0     # not the same string
    assert inv.where(O.stock_predicate("sku_1", 27)).count() == 0      # equality, not "at least"
