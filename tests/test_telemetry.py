"""Count-based windows, routing, log parsing and histograms on small frames."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from shopflow.functions import constants as C
from shopflow.operators import telemetry as TL
from shopflow.sources import fixtures as fx

CALL_SCHEMA = "instance string, event_id bigint, ts timestamp_ntz, failed boolean"
T0 = datetime(2024, 1, 1)


def _calls(spark, rows):
    return spark.createDataFrame(rows, CALL_SCHEMA)


def test_fewer_than_min_calls_not_flagged(spark):
    rows = [("i", k, T0 + timedelta(seconds=k), True) for k in range(4)]
    got = TL.failure_rate(_calls(spark, rows), 5).orderBy("event_id").collect()
    assert [r.flagged for r in got] == [False] * 4
    assert [r.n_calls for r in got] == [1, 2, 3, 4]


def test_three_of_five_flagged(spark):
    fails = [True, False, True, False, True]
    rows = [("i", k, T0 + timedelta(seconds=k), f) for k, f in enumerate(fails)]
    last = TL.failure_rate(_calls(spark, rows), 5).orderBy("event_id").collect()[-1]
    assert (last.n_calls, last.n_failed, last.failure_rate, last.flagged) == (5, 3, 0.6, True)


import pytest


@pytest.mark.parametrize("window,block", [(10, 11), (5, 6), (5, 1 << 20)])
def test_blocked_window_equals_brute_force(spark, window, block):
    rnd = random.Random(7)
    rows = []
    for k in range(600):
        inst = "hot" if rnd.random() < 0.6 else f"i{rnd.randint(0, 3)}"
        ts = T0 + timedelta(seconds=rnd.randint(0, 300))          # ties in ts on purpose
        rows.append((inst, k, ts, rnd.random() < 0.4))
    got = TL.failure_rate(_calls(spark, rows), window, block_rows=block, num_partitions=6).toPandas()
    pdf = pd.DataFrame(rows, columns=["instance", "event_id", "ts", "failed"]).sort_values(
        ["instance", "ts", "event_id"])
    g = pdf.groupby("instance")["failed"]
    pdf["n_failed"] = g.transform(lambda s: s.astype(int).rolling(window, min_periods=1).sum()).astype(int)
    pdf["n_calls"] = g.transform(lambda s: s.rolling(window, min_periods=1).count()).astype(int)
    merged = got.merge(pdf, on="event_id", suffixes=("", "_bf"))
    assert len(merged) == 600
    assert (merged.n_failed == merged.n_failed_bf).all()
    assert (merged.n_calls == merged.n_calls_bf).all()


def test_flag_changes_equal_brute_force_across_blocks(spark):
    rnd = random.Random(11)
    rows = [(f"i{k % 3}", k, T0 + timedelta(seconds=k // 2), rnd.random() < 0.5) for k in range(600)]
    rated = TL.failure_rate(_calls(spark, rows), 5, num_partitions=4)
    got = {(r.instance, r.event_id, r.healthy_before, r.healthy)
           for r in TL.flag_changes(rated, block_rows=7).collect()}
    want, last = set(), {}
    for r in sorted(rated.collect(), key=lambda r: (r.instance, r.position)):
        before = last.get(r.instance, False)
        if r.flagged != before:
            want.add((r.instance, r.event_id, not before, not r.flagged))
        last[r.instance] = r.flagged
    assert got == want and len(got) > 50


def test_failed_call_time_limit(spark):
    df = spark.createDataFrame([(False, 3.5), (None, 1.0), (True, 0.1), (False, 3.0)],
                               "error boolean, duration_s double")
    got = [r.f for r in df.select(TL.failed_call(F.col("error"), F.col("duration_s")).alias("f")).collect()]
    assert got == [True, False, True, False]
    got = [r.f for r in df.select(TL.failed_call(F.col("error"), F.col("duration_s"), None).alias("f")).collect()]
    assert got == [False, False, True, False]


def test_routes(spark):
    access = spark.createDataFrame(
        [(1, "GET", "/api/product", True, 200), (2, "GET", "/aggregate/order-service/v3/api-docs", False, 200),
         (3, "POST", "/fallbackRoute", True, 200), (4, "GET", "/fallbackRoute", True, 200),
         (5, "GET", "/nope", True, 200), (6, "POST", "/api/order", False, 200)],
        "event_id bigint, method string, path string, ok boolean, status int")
    routed = TL.fallback_response(TL.rewrite_path(TL.classify_routes(access, fx.routes(spark))))
    got = {r.event_id: (r.route_id, r.forward_path, r.status, r.body) for r in routed.collect()}
    assert got[1] == ("product_service", "/api/product", 200, None)
    assert got[2] == ("order_service_swagger", "/api-docs", 503, C.SERVICE_UNAVAILABLE_TEXT)
    assert got[3] == (None, None, 404, None)
    assert got[4] == ("fallbackRoute", "/fallbackRoute", 200, None)
    assert got[5] == (None, None, 404, None)
    assert got[6] == ("order_service", "/api/order", 404, None)     # the fallback serves GET only


def test_log_parsers(spark):
    lines = spark.createDataFrame([
        ("2024-01-02 03:04:05 [exec-1] shop.x.Handler [abc,def] - hello, world",),
        ("2024-01-02 03:04:06 [exec-2] shop.x.Handler [,] - no ids",),
    ], "line string")
    got = TL.parse_log_lines(lines).collect()
    assert (got[0].trace_id, got[0].span_id, got[0].message) == ("abc", "def", "hello, world")
    assert got[0].ts == datetime(2024, 1, 2, 3, 4, 5)
    assert (got[1].trace_id, got[1].span_id) == (None, None)
    assert [r.parsed for r in got] == [True, True]
    odd = spark.createDataFrame([("\tat shop.Handler.run(Handler.java:7)",), ("",), (None,),
                                 ("2024-13-45 99:00:00 [e] l [a,b] - m",),
                                 ("2024-01-02 03:04:05 [e] l [a,b] - m \x01 x",)], "line string")
    for r in TL.parse_log_lines(odd).collect():
        assert (r.parsed, r.ts, r.thread, r.trace_id, r.message) == (False, None, None, None, None)
    assert [r[0] for r in lines.select(TL.line_trace_id(F.col("line"))).collect()] == ["abc", ""]
    triple = spark.createDataFrame([("t INFO [app,tid9,sid1] - m",), ("t INFO [app,,] - m",)], "line string")
    assert [r.trace_id for r in TL.extract_trace_id(triple).collect()] == ["tid9", None]


def test_labels_and_levels(spark):
    df = spark.createDataFrame([("a", "h", "DEBUG"), ("a", "h", "WARN"), ("a", "h", "NOPE")],
                               "application string, host string, level string")
    s = df.select(TL.label_string(df).alias("l")).collect()[0].l
    assert s == "application=a,host=h,level=DEBUG"
    m = df.select(TL.parse_labels(TL.label_string(df)).alias("m")).collect()[0].m
    assert m == {"application": "a", "host": "h", "level": "DEBUG"}
    assert [r.level for r in df.where(TL.level_at_least(F.col("level"))).collect()] == ["WARN"]


def test_histogram_cumulative(spark):
    spans = spark.createDataFrame(
        [(1, "t1", "app", 0.003, T0), (2, "t2", "app", 0.2, T0 + timedelta(seconds=9)),
         (3, "t3", "app", 0.2, T0 + timedelta(seconds=5)), (4, "t4", "app", 50.0, T0)],
        "event_id bigint, trace_id string, application string, duration_s double, ts timestamp_ntz")
    h = {r.le: r for r in TL.duration_histogram(spans).collect()}
    assert len(h) == len(TL.DEFAULT_BOUNDS) + 1               # every bound and +inf
    assert [h[k].cumulative for k in sorted(h)] == [1, 1, 1, 1, 1, 3, 3, 3, 3, 3, 3, 4]
    assert {(r.total_samples, float(r.total_s)) for r in h.values()} == {(4, 50.403)}
    assert h[0.05].samples == 0 and h[0.05].max_s is None
    assert h[0.25].exemplar_trace_id == "t2"          # the latest sample of the bucket
    assert h[float("inf")].samples == 1


def test_trace_sample_keeps_whole_traces(spark):
    spans = spark.createDataFrame([(i, f"t{i % 50}") for i in range(500)], "event_id bigint, trace_id string")
    kept = TL.trace_sample(spans, 0.3)
    per_trace = kept.groupBy("trace_id").count().collect()
    assert all(r["count"] == 10 for r in per_trace)
    assert 0 < len(per_trace) < 50
    assert TL.trace_sample(spans, 1.0).count() == 500
    assert TL.trace_sample(spans, 0.0).count() == 0
    many = spark.range(200_000).selectExpr("cast(id as string) as trace_id")
    assert abs(TL.trace_sample(many, 0.00001 * 3).count() - 6) < 8     # finer than 1/65536
    none = spark.createDataFrame([(1, None)], "event_id bigint, trace_id string")
    assert [TL.trace_sample(none, p).count() for p in (0.5, 1.0)] == [0, 0]


def test_sort_by_time_orders_each_label_set(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b"]), "h", "INFO", T0 + timedelta(seconds=rnd.randint(0, 50)), k)
            for k in range(400)]
    df = spark.createDataFrame(rows, "application string, host string, level string, "
                                     "ts timestamp_ntz, event_id bigint")
    key = lambda r: (r.application, r.host, r.level, r.ts, r.event_id)
    parts = TL.sort_by_time(df, num_partitions=6).rdd.glom().collect()
    flat = [r for p in parts for r in p]
    assert len(flat) == 400
    # Partitions in range order, each sorted: the concatenation is the total order.
    assert [key(r) for r in flat] == sorted(key(r) for r in df.collect())
