"""Stock as of a request's time, and stock as of a batch's first attempt."""

from __future__ import annotations

from datetime import datetime

import pytest

from shopflow.operators import orders as O
from shopflow.sources.commits import CommitLog
from shopflow.sources.snapshots import StockSnapshots
from shopflow.sources.storage import run_dir
from shopflow.streaming import orders_stream as S
from shopflow.streaming.orders_stream import process_order_batch
from tests.test_key_index import _paths, _requests, _stored

HISTORY = "snapshot int, valid_from timestamp_ntz, sku_code string, quantity int"


def day(n):
    return datetime(2024, 1, n)


def _history(spark):
    return spark.createDataFrame([
        (0, day(2), "a", 1), (0, day(2), "b", 1), (0, day(2), "a", 1), (0, day(2), None, 1),
        (1, day(4), "a", 1), (1, day(4), "b", 2),
        (2, day(6), "b", 1), (2, day(6), "c", None),
        (3, day(8), "a", 1)], HISTORY)


def test_intervals(spark):
    rows = {(r.sku_code, r.quantity, r.held_from, r.held_to) for r in O.stock_intervals(_history(spark)).collect()}
    assert rows == {("a", 1, day(2), day(6)), ("a", 1, day(8), None), ("b", 1, day(2), day(4)),
                    ("b", 2, day(4), day(6)), ("b", 1, day(6), day(8))}


def test_flag_as_of(spark):
    asked = [("a", 1, n) for n in (1, 2, 5, 6, 7, 8, 30)] + [("b", 1, n) for n in (2, 4, 6, 8)] + [
        ("a", 2, 3), (None, 1, 3), ("a", None, 3), ("a", 1, None), ("c", None, 7)]
    requests = spark.createDataFrame([(i, s, q, day(n) if n else None) for i, (s, q, n) in enumerate(asked)],
                                     "request_id int, sku_code string, quantity int, requested_at timestamp_ntz")
    got = {r.request_id: r.in_stock for r in O.stock_flag_as_of(requests, _history(spark)).collect()}
    right = {("a", 1, 2), ("a", 1, 5), ("a", 1, 8), ("a", 1, 30), ("b", 1, 2), ("b", 1, 6)}
    assert got == {i: a in right for i, a in enumerate(asked)}
    assert O.stock_flag_as_of(requests, _history(spark).limit(0)).where("in_stock").count() == 0


def _take(spark, snapshots, *keys):
    return snapshots.take(spark.createDataFrame([(i, f"s-{k}", 1) for i, k in enumerate(keys)],
                                                "id long, sku_code string, quantity int"))


def test_a_second_attempt_sees_the_stock_of_the_first(spark, monkeypatch):
    """Stopped before anything was staged; then the stock changes."""
    paths, snapshots = _paths(spark), StockSnapshots(spark, run_dir(spark, "stock"))
    assert _take(spark, snapshots, "a", "b") == 0
    batch = _requests(spark, "a", "b", "c")
    monkeypatch.setattr(S.O, "surrogate_ids", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        process_order_batch(paths, snapshots, batch, 0)
    monkeypatch.undo()
    assert CommitLog(spark, paths.commits).staged(0) is None
    assert _take(spark, snapshots, "c") == 1
    process_order_batch(paths, snapshots, batch, 0)
    orders, events = _stored(spark, paths)
    assert len(orders) == 2 and orders == events
    # The next batch sees the stock as of now.
    process_order_batch(paths, snapshots, _requests(spark, "a", "c"), 1)
    stored = {r.request_id for r in spark.read.parquet(paths.orders).where("batch_id = 1").collect()}
    assert stored == {"c"}


def test_snapshots_are_numbered_and_dropped(spark):
    snapshots = StockSnapshots(spark, run_dir(spark, "stock"))
    assert snapshots.numbers() == []
    for keys in ("ab", "b", "bc"):
        _take(spark, snapshots, *keys)
    assert snapshots.numbers() == [0, 1, 2] and snapshots.read(2).count() == 2
    assert snapshots.history().count() == 5
    snapshots.drop_before(2)
    assert snapshots.numbers() == [2] and snapshots.read(2).count() == 2
