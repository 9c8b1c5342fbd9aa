import zlib
from collections import Counter, defaultdict

from shopflow.llm import sharding as S
from shopflow.llm.queries import QUERIES
from shopflow.llm.sharding import N_SHARDS, shard_rows, write_shards

from .conftest import MEDIUM


def _check_law(rows, n_shards):
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    sizes = [len(per[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_query_law_and_digests(spark):
    rows = QUERIES["op1_sharding"](spark, MEDIUM).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert r["law"] == "rows" and r["grown_shard"] is None
    _check_law(rows, N_SHARDS)


def test_every_shard_matches_the_mixture(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    total = Counter(r["source"] for r in docs.select("source").collect())
    n = sum(total.values())
    rows = shard_rows(docs, 8, bucket_rows=30).collect()
    _check_law(rows, 8)
    for shard in range(8):
        own = Counter(r["source"] for r in rows if r["shard"] == shard)
        for source, c in total.items():
            assert abs(own[source] - sum(own.values()) * c / n) < 2


def test_order_is_the_sort_by_fractional_rank(spark):
    """Brute force: rank by the same seeded hash, sort by (2r+1)/2c."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    place = {r["doc_id"]: r["place"] for r in docs.selectExpr(
        "doc_id", "xxhash64(doc_id, crc32(cast(text as binary)), "
        "cast(octet_length(text) + 8 as bigint), 42) as place").collect()}
    by_source = defaultdict(list)
    for r in docs.select("doc_id", "source").collect():
        # Spark's ranks follow buckets of the unsigned hash, then the signed hash.
        by_source[r["source"]].append((place[r["doc_id"]] % 2**64 >> 63, place[r["doc_id"]], r["doc_id"]))
    order = []
    for own in by_source.values():
        own.sort()
        order += [((2 * i + 1) / (2 * len(own)), p, d) for i, (_, p, d) in enumerate(own)]
    order.sort()
    got = sorted(shard_rows(docs).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in got] == [d for *_, d in order]


def test_prefix_sums_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "COARSE_BITS", 2)
    docs = spark.range(500).selectExpr("id as doc_id", "string(id) as text", "string(id % 3) as source")
    small = shard_rows(docs, 5, bucket_rows=4).collect()
    _check_law(small, 5)
    monkeypatch.undo()
    assert sorted(map(tuple, small)) == sorted(map(tuple, shard_rows(docs, 5).collect()))


def test_odd_rows(odd_docs, no_docs):
    rows = shard_rows(odd_docs, 3).collect()
    assert len(rows) == 10
    _check_law(rows, 3)
    assert shard_rows(no_docs).collect() == []


def test_hot_source_is_spread_over_buckets(spark):
    docs = spark.range(3000).selectExpr(
        "id as doc_id", "'t' as text", "if(id % 3 = 0, 'rare', 'hot') as source")
    rows = shard_rows(docs, 7, bucket_rows=100).collect()
    _check_law(rows, 7)
    for s in range(7):
        own = [r["source"] for r in rows if r["shard"] == s]
        assert abs(own.count("rare") - len(own) / 3) < 2


def test_written_shards_hold_every_row_in_its_place(spark, odd_docs, no_docs, tmp_path):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    write_shards(docs, str(tmp_path / "a"), 6)
    back = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    want = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_rows(docs, 6).collect()}
    assert {r["doc_id"]: (r["_shard"], r["_slot"]) for r in back.collect()} == want
    odd = odd_docs.withColumnRenamed("c0", "_slot")
    write_shards(odd, str(tmp_path / "b"), 3)
    back = spark.read.parquet(str(tmp_path / "b"))
    assert sorted(map(str, back.select(*odd.columns).collect())) == sorted(map(str, odd.collect()))
    write_shards(no_docs, str(tmp_path / "c"), 3)
