"""Key index and commit log: what a batch reads, and what it leaves behind when it stops half-way."""

from __future__ import annotations

import pytest

from shopflow.sources import key_index as K
from shopflow.sources import sinks
from shopflow.sources.commits import CommitLog, committed_rows
from shopflow.sources.key_index import KeyIndex
from shopflow.sources.storage import run_dir
from shopflow.streaming import orders_stream as S
from shopflow.streaming.notify_stream import NotifyPaths, process_event_batch
from shopflow.streaming.orders_stream import OrderStreamPaths, process_order_batch, run_order_stream
from tests.test_streaming import REQUEST, _feed, _stock


def _keys(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "order_number string")


def _store(spark, index, table, batch_id, keys):
    sinks.write_batch(_keys(spark, keys), table, batch_id)
    index.add(_keys(spark, keys), batch_id, len(keys))


def test_no_stored_key_is_missed(spark):
    base = run_dir(spark, "index")
    index = KeyIndex(spark, f"{base}/index")
    sizes = (1, 3, 1024, 1025, 5000)
    for b, n in enumerate(sizes):
        _store(spark, index, f"{base}/t", b, [f"k-{b}-{i}" for i in range(n)])
    asked = [f"k-{b}-{i}" for b, n in enumerate(sizes) for i in range(n)] + [f"new-{i}" for i in range(20_000)]
    found = index.candidates(_keys(spark, asked), len(sizes)).collect()
    right = {(f"k-{b}-{i}", b) for b, n in enumerate(sizes) for i in range(n)}
    got = {(r.key, r.batch_id) for r in found}
    assert right <= got
    assert len(got - right) < 20                  # of 100,000 pairs asked, and hardly ever one
    known = index.known(_keys(spark, asked), f"{base}/t", len(sizes))
    assert {r.order_number for r in known.collect()} == {k for k, _ in right}


def test_only_folders_that_may_hold_a_key_are_read(spark, monkeypatch):
    base = run_dir(spark, "index")
    index = KeyIndex(spark, f"{base}/index")
    for b in range(12):
        _store(spark, index, f"{base}/t", b, [f"k-{b}-{i}" for i in range(50)])
    read = []
    folders = KeyIndex.folders
    monkeypatch.setattr(KeyIndex, "folders", lambda self, table, batches: read.extend(
        folders(self, table, batches).inputFiles()) or folders(self, table, batches))
    known = index.known(_keys(spark, ["k-4-7", "k-9-1", "other", None]), f"{base}/t", 12)
    assert {r.order_number for r in known.collect()} == {"k-4-7", "k-9-1"}
    assert {f.split("batch_id=")[1].split("/")[0] for f in read} == {"4", "9"}
    read.clear()
    assert index.known(_keys(spark, ["a", "b"]), f"{base}/t", 12) is None and not read
    # Batches from the one asked for on are left out: it may be run again.
    assert index.known(_keys(spark, ["k-4-7"]), f"{base}/t", 4) is None


def test_filters_are_merged_and_answer_alike(spark, monkeypatch):
    monkeypatch.setattr(K, "MERGE", 4)
    base = run_dir(spark, "index")
    index = KeyIndex(spark, f"{base}/index")
    for b in range(14):
        _store(spark, index, f"{base}/t", b, [f"k-{b}-{i}" for i in range(20)])
        if b in (4, 9):                            # run again, right after a merge
            _store(spark, index, f"{base}/t", b, [f"k-{b}-{i}" for i in range(10)])
    spans, own = index._folders()
    assert len(spans) + len(own) < 8 and spans
    asked = [f"k-{b}-{i}" for b in range(14) for i in range(20)]
    got = {(r.key, r.batch_id) for r in index.candidates(_keys(spark, asked), 14).collect()}
    assert got == {(f"k-{b}-{i}", b) for b in range(14) for i in range(10 if b in (4, 9) else 20)}


def _paths(spark):
    base = run_dir(spark, "orders-log")
    return OrderStreamPaths(f"{base}/orders", f"{base}/events", f"{base}/rejects", f"{base}/cp",
                            f"{base}/log", f"{base}/index")


def _requests(spark, *keys):
    return spark.createDataFrame([(k, REQUEST % (f"s-{k}", 1)) for k in keys], "request_id string, value string")


def _held(spark, *keys):
    return _stock(spark, *[(i, f"s-{k}", 1) for i, k in enumerate(keys)])


def _stored(spark, paths):
    orders = {r.order_number for r in spark.read.parquet(paths.orders).collect()}
    events = {r.value.split('"')[3] for r in spark.read.parquet(paths.events).collect()}
    return orders, events


def test_a_batch_that_stopped_between_the_sinks_delivers_what_it_decided(spark, monkeypatch):
    """Less stock at the second attempt: orders, events and a broker's log agree."""
    paths, batch = _paths(spark), _requests(spark, "a", "b", "c")
    broker = []
    publish = S.publish_batch

    def failing(events, *rest):
        broker.append({r.order_number for r in events.select("order_number").collect()})
        raise OSError("the broker went away")

    monkeypatch.setattr(S, "publish_batch", failing)
    with pytest.raises(OSError):
        process_order_batch(paths, _held(spark, "a", "b", "c"), batch, 0)
    log = CommitLog(spark, paths.commits)
    assert log.batches() == [] and log.staged(0) is not None
    assert spark.read.parquet(paths.orders).count() == 3
    assert committed_rows(spark, paths.orders, log).count() == 0      # readers of marked batches see none
    monkeypatch.setattr(S, "publish_batch", lambda events, *rest: (
        broker.append({r.order_number for r in events.select("order_number").collect()}), publish(events, *rest)))
    process_order_batch(paths, _held(spark, "a"), batch, 0)
    orders, events = _stored(spark, paths)
    assert len(orders) == 3 and orders == events == broker[0] == broker[1]
    assert committed_rows(spark, paths.orders, log).count() == 3
    # Committed: run once more, it does nothing.
    process_order_batch(paths, _held(spark), batch, 0)
    assert _stored(spark, paths) == (orders, events) and len(broker) == 2
    assert log.staged(0) is None


def test_a_batch_that_stopped_while_staging_decides_anew(spark, monkeypatch):
    paths, batch = _paths(spark), _requests(spark, "a", "b")
    monkeypatch.setattr(S.O, "surrogate_ids", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        process_order_batch(paths, _held(spark, "a", "b"), batch, 0)
    monkeypatch.undo()
    assert CommitLog(spark, paths.commits).staged(0) is None
    process_order_batch(paths, _held(spark, "b"), batch, 0)
    orders, events = _stored(spark, paths)
    assert len(orders) == 1 and orders == events


def test_numbers_and_ids_over_many_batches(spark):
    """Each batch delivers its neighbour's requests again; ids go on without gaps."""
    paths = _paths(spark)
    for b in range(3):
        process_order_batch(paths, _held(spark, *"abcd"), _requests(spark, *"abcd"[b:b + 2]), b)
    orders = spark.read.parquet(paths.orders).collect()
    assert sorted(r.request_id for r in orders) == list("abcd")
    assert sorted(r.id for r in orders) == [1, 2, 3, 4]
    assert CommitLog(spark, paths.commits).before(3) == {"rows": 1, "last_id": 4}


def test_empty_batches_with_a_log(spark):
    paths = _paths(spark)
    for b, keys in enumerate(((), ("a",), ())):
        process_order_batch(paths, _held(spark, "a"), _requests(spark, *keys) if keys else spark.createDataFrame(
            [], "request_id string, value string"), b)
    assert spark.read.parquet(paths.orders).count() == 1
    assert CommitLog(spark, paths.commits).batches() == [0, 1, 2]


def test_another_checkpoint_is_refused(spark):
    paths, topic, stock = _paths(spark), run_dir(spark, "requests"), _stock(spark, (1, "s", 1))
    _feed(spark, topic, ("k0", REQUEST % ("s", 1)))
    run_order_stream(spark, topic, stock, paths)
    paths.checkpoint += "-other"
    with pytest.raises(Exception, match="another checkpoint"):
        run_order_stream(spark, topic, stock, paths)
    assert spark.read.parquet(paths.orders).count() == 1


@pytest.mark.parametrize("window", [None, "0 seconds"])
def test_deliveries_after_the_window(spark, window):
    paths, topic, stock = _paths(spark), run_dir(spark, "requests"), _stock(spark, (1, "s", 1))
    for n in range(2):
        _feed(spark, topic, ("k0", REQUEST % ("s", 1)), (f"own-{n}", REQUEST % ("s", 1)))
        run_order_stream(spark, topic, stock, paths, redelivery_window=window)
    orders = spark.read.parquet(paths.orders).collect()
    assert sorted(r.request_id for r in orders) == ["k0", "own-0", "own-1"]
    assert sorted(r.id for r in orders) == [1, 2, 3]


def test_work_of_a_batch_does_not_grow_with_the_batches_before(spark, monkeypatch):
    """A batch with new numbers reads no stored folder; one with old ones reads theirs."""
    paths, table = _paths(spark), None
    index, table = KeyIndex(spark, paths.index), paths.orders
    for b in range(36):                                   # as 36 batches would leave them
        _store(spark, index, table, b, [f"stored-{b}"])
    spans, own = index._folders()
    assert len(spans) + len(own) < K.MERGE
    CommitLog(spark, paths.commits).commit(35, rows=1, last_id=36)
    seen, read = [], KeyIndex.folders
    monkeypatch.setattr(KeyIndex, "folders",
                        lambda self, at, batches: seen.append(batches) or read(self, at, batches))
    process_order_batch(paths, _held(spark, "a"), _requests(spark, "a"), 36)
    assert seen == []
    process_order_batch(paths, _held(spark, "a", "b"), _requests(spark, "a", "b"), 37)
    assert seen == [[36]]
    rows = spark.read.schema("id long, order_number string, batch_id long").parquet(table).where("batch_id >= 36")
    assert sorted((r.id, r.batch_id) for r in rows.collect()) == [(37, 36), (38, 37)]


def _event(number):
    return (number, f"{number}@x", "F", "L", False, f'{{"orderNumber":"{number}"}}')


def test_the_outbox_holds_a_number_once_for_good(spark):
    base = run_dir(spark, "outbox")
    paths = NotifyPaths(f"{base}/outbox", f"{base}/dead", f"{base}/cp", f"{base}/index")
    schema = ("order_number string, email string, first_name string, last_name string, "
              "quarantined boolean, value string")
    for b, numbers in enumerate((["a", "b"], ["a", "d", "d"], ["b", "e"])):
        batch = spark.createDataFrame([_event(n) for n in numbers], schema)
        for _ in range(1 + b % 2):               # one is run again, too
            process_event_batch(paths, batch, b)
    rows = spark.read.parquet(paths.outbox).collect()
    assert sorted(r.order_number for r in rows) == ["a", "b", "d", "e"]
    assert {r.order_number: r.batch_id for r in rows}["a"] == 0
