"""What one task or one batch holds stays a share of the whole, however the input is stored."""

from __future__ import annotations

from datetime import datetime

from shopflow.operators import orders as O
from shopflow.sources.storage import run_dir


def _executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_history_in_one_file_is_spread_before_it_is_made_distinct(spark):
    path = run_dir(spark, "history")
    spark.range(300).selectExpr("0 as snapshot", "timestamp_ntz'2024-01-01 00:00:00' as valid_from",
                                "concat('s', id) as sku_code", "cast(id % 5 as int) as quantity") \
        .coalesce(1).write.parquet(path)
    held = O.stock_intervals(spark.read.parquet(path))
    plan = _executed(held)
    pairs = plan[:plan.rindex("FileScan")].rsplit("REPARTITION_BY_NUM", 1)
    assert len(pairs) == 2 and "HashAggregate" not in pairs[1].split("FileScan")[0]
    assert {(r.held_from, r.held_to) for r in held.collect()} == {(datetime(2024, 1, 1), None)}
    assert held.count() == 300


def test_lines_are_shuffled_as_they_are_and_once(spark, tmp_path):
    """Orders and customers above the broadcast limit: of the lines' side, one exchange, before any text."""
    from shopflow.plans.joins import MAX_BYTES_CONF
    from shopflow.sources import fixtures as fx
    from tests.conftest import SMALL
    spark.conf.set(MAX_BYTES_CONF, "1000")
    try:
        plan = _executed(fx.requests(spark, SMALL))
    finally:
        spark.conf.unset(MAX_BYTES_CONF)
    assert plan.count("hashpartitioning(l_orderkey") == 1
    assert plan.count("hashpartitioning(o_custkey") == 1
    above = plan[:plan.index("hashpartitioning(l_orderkey")]
    assert "concat(sku_" in above and "concat(sku_" not in plan[len(above):]


def test_a_large_batch_is_packed_by_several_tasks(spark):
    from shopflow.sources import sinks
    from shopflow.sources.compaction import compact, read_batches
    path = run_dir(spark, "compact")
    for b in range(2):
        sinks.write_batch(spark.range(20_000).selectExpr("cast(id as string) as k"), path, b)
    files = [f for f in spark.read.parquet(f"{path}/batch_id=0").inputFiles()]
    size = sum(spark.sparkContext._jvm.java.io.File(f.removeprefix("file://")).length() for f in files)
    compact(spark, path, "k string", target_bytes=size // 4)
    compact(spark, path, "k string", target_bytes=size // 4, keep_last=0)
    span = next(n for n in {f.split("/")[-2] for f in read_batches(spark, path, "k string").inputFiles()}
                if n.startswith("span=0-0"))
    rows = [r["count"] for r in spark.read.parquet(f"{path}/{span}").groupBy("_metadata.file_name").count().collect()]
    assert len(rows) >= 4 and max(rows) < 10_000
    assert read_batches(spark, path, "k string").count() == 40_000


def test_deliveries_are_made_of_many_files(spark):
    from shopflow.queries import _deliver
    topic = run_dir(spark, "topic")
    each = _deliver(spark.range(800).selectExpr("cast(id as string) as request_id", "'{' as value"), topic, 4)
    assert each == 2 and len(spark.read.parquet(topic).inputFiles()) == 8      # 8 shuffle partitions
    few = run_dir(spark, "topic")
    assert _deliver(spark.range(1).selectExpr("cast(id as string) as request_id", "'{' as value"), few, 4) == 1
    assert spark.read.parquet(few).count() == 1


def test_a_batch_holds_only_what_it_decides(spark):
    from shopflow.operators import decode as D
    from shopflow.streaming.orders_stream import _decided
    from tests.test_streaming import REQUEST, _stock
    rows = [(f"r{i}", REQUEST % (f"s{i}", 1)) for i in range(50)] + [
        ("cut", '{"skuCode": "s1"'), (None, REQUEST % ("s1", 1)), ("nobody", '{"skuCode": "s1", "quantity": 1}')]
    batch = spark.createDataFrame(rows, "request_id string, value string")
    kept = _decided(D.decode_order_requests(batch), _stock(spark, (1, "s1", 1), (2, "s1", 1), (3, "s7", 1)))
    got = sorted((r.request_id or "", r.rejected, r.value is not None) for r in kept.collect())
    assert got == [("", False, True), ("cut", True, True), ("r1", False, False), ("r7", False, False)]


def test_a_file_batch_is_bounded_by_bytes(spark):
    from shopflow.streaming.common import bounded
    assert list(bounded("parquet", None)) == ["maxBytesPerTrigger"]
    assert bounded("parquet", {"maxFilesPerTrigger": "1"}) == {"maxFilesPerTrigger": "1"}
    assert "maxOffsetsPerTrigger" in bounded("kafka", None)


def test_a_session_that_names_no_state_store_keeps_keys_off_the_heap(spark):
    from shopflow.streaming.common import ROCKSDB, ROCKSDB_CONF, STATE_STORE_CONF, use_rocksdb
    other = spark.newSession()
    other.conf.unset(STATE_STORE_CONF)
    for key in ROCKSDB_CONF:
        other.conf.unset(key)
    use_rocksdb(other)
    assert other.conf.get(STATE_STORE_CONF) == ROCKSDB
    assert other.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"
    assert int(other.conf.get("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB")) <= 500
    chosen = "org.example.OwnProvider"
    other.conf.set(STATE_STORE_CONF, chosen)
    use_rocksdb(other)
    assert other.conf.get(STATE_STORE_CONF) == chosen


def test_a_large_stock_is_asked_through_a_filter_first(spark):
    from pyspark.sql import functions as F
    from shopflow.operators import decode as D
    from shopflow.plans.joins import MAX_BYTES_CONF
    from shopflow.streaming.orders_stream import _decided
    from tests.test_streaming import REQUEST
    asked = [(f"r{i}", REQUEST % (f"s{i}", i % 7)) for i in range(4000)] + [
        ("twice", REQUEST % ("s7", 0)), ("cut", '{"skuCode": "s1"'), ("cut too", '{"skuCode": "s1"'),
        (None, REQUEST % ("s7", 0)), ("no sku", '{"quantity": 1}'), ("no quantity", '{"skuCode": "s7"}')]
    stock = [(i, f"s{i}", i % 7) for i in range(0, 4000, 20)] + [
        (1, "s1", 5), (7, "s7", 0), (7, "s7", 0), (8, None, 1), (9, "s9", None)]
    stock = spark.createDataFrame(stock, "id long, sku_code string, quantity int")
    decoded = D.decode_order_requests(spark.createDataFrame(asked, "request_id string, value string"))
    want = sorted(map(str, _decided(decoded, lambda: stock).collect()))
    held = O.with_stock_flag(decoded, stock).where("in_stock and not rejected")
    spark.conf.set(MAX_BYTES_CONF, "5000")                   # below the stock, above the filter
    try:
        few = O.maybe_in_stock(decoded, stock, F.col("rejected"))
        assert held.select("request_id").exceptAll(few.select("request_id")).isEmpty()
        assert held.count() + 2 <= few.count() < 800
        got = _decided(decoded, lambda: stock)
        assert "BroadcastHashJoin" in _executed(got)
        assert sorted(map(str, got.collect())) == want and len(want) == 205
        # A stock of other types is not told apart by hashes, and a filter has its limit too.
        wide = stock.withColumn("quantity", F.col("quantity").cast("long"))
        assert O.maybe_in_stock(decoded, wide, F.col("rejected")) is decoded
        assert sorted(map(str, _decided(decoded, lambda: wide).collect())) == want
        spark.conf.set(MAX_BYTES_CONF, "500")
        assert O.maybe_in_stock(decoded, stock, F.col("rejected")) is decoded
        assert sorted(map(str, _decided(decoded, lambda: stock).collect())) == want
    finally:
        spark.conf.unset(MAX_BYTES_CONF)
