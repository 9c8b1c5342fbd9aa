import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from shopflow.llm.fingerprints import BINS, likeness, order_minhash, with_next
from shopflow.llm import fingerprints as P
from shopflow.llm.queries import QUERIES

from .conftest import MEDIUM


def test_query_equals_brute_force(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(
        f"{MEDIUM}/documents.parquet").collect()), reverse=True)
    rows = {r["doc_id"]: r for r in QUERIES["op10_order_minhash"](spark, MEDIUM).collect()}
    assert len(rows) == len(docs)
    prints, bins = {}, {}
    for i, (d, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[1][:half]
        r = rows[d]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, following = (set(x.split(" ")) for x in (
            r["fingerprint"], r["edited_fingerprint"], rows[after[0]]["fingerprint"]))
        for other, near in ((changed, r["near_edited"]), (following, r["near_next"])):
            numbers = {x[:-8] for x in own | other}
            assert abs(near - len(own & other) / len(numbers)) < 1e-12
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    far = [r["near_next"] for r in rows.values()]
    near = [r["near_edited"] for r in rows.values()]
    assert sum(near) / len(near) > 4 * sum(far) / len(far)


def _near(spark, pairs, **how):
    df = spark.createDataFrame(pairs, "a string, b string").repartition(1)
    return [r[0] for r in df.select(likeness(order_minhash(F.col("a"), **how),
                                             order_minhash(F.col("b"), **how))).collect()]


def test_order_and_repeats_count(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    blocks = [words[i:i + 40] for i in range(0, 400, 40)]
    moved = [w for b in rng.sample(blocks, 10) for w in b]
    edited = list(words)
    for at in range(0, 400, 40):
        edited[at] = "changed"
    text = " ".join(words)
    same, shuffled, changed, doubled, other = _near(spark, [
        (text, text), (text, " ".join(moved)), (text, " ".join(edited)), (text, text + " " + text),
        (text, " ".join(f"z{i}" for i in range(400)))])
    assert same == 1.0 and other == 0.0
    # Nearly the same k-mers in another order are less alike than real edits.
    assert shuffled < changed < 1 and doubled < 1


def test_repeats_are_numbered(spark):
    df = spark.createDataFrame([("a b c " * 3 + "a b c",), ("a b c " * 9 + "a b c",)], "t string")
    one, two = (r[0] for r in df.select(order_minhash(F.col("t"), k=1, ell=1)).collect())
    assert len(one) < len(two) <= BINS
    assert {x >> 32 for x in one} <= {x >> 32 for x in two}


def test_tuples_hold_the_smallest_in_text_order(spark):
    """With one bin and ell beyond the text, two texts agree only if all is equal."""
    texts = ["a b c d e", "a b c e d", "b a c d e", "a b c d e f", "a b c d e"]
    pairs = [(texts[0], t) for t in texts]
    assert _near(spark, pairs, k=1, ell=50, bins=1) == [1.0, 0.0, 0.0, 0.0, 1.0]


def test_next_in_blocks_and_ties(spark):
    rows = [(i * 7 % 1000 - 300, f"t{i}") for i in range(0, 1000, 3)]
    rows += [(50, "x"), (50, "y"), (None, "n"), (None, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(6)
    key = {r["text"]: r["k"] for r in df.selectExpr(
        "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as k").collect()}
    order = sorted(((i, t or "") for i, t in rows),
                   key=lambda r: (r[0] is None, -(r[0] or 0), key[r[1]]))
    want = {(i, t): order[(n + 1) % len(order)][1] for n, (i, t) in enumerate(order)}
    for block_rows in (10, 2000):
        got = {(r["id"], r["text"]): r["next_text"] for r in with_next(df, block_rows).collect()}
        assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    columns = [F.col("doc_id").alias("id"), "text"]
    rows = with_next(odd_docs.select(*columns)).collect()
    assert len(rows) == 10 and all(r["next_text"] is not None and r["print"] for r in rows)
    assert with_next(no_docs.select(*columns)).collect() == []
    alone = with_next(spark.createDataFrame([(1, "only one")], "id long, text string")).collect()
    assert [(r["text"], r["next_text"]) for r in alone] == [("only one", "only one")]


def test_native_plan(spark):
    plan = QUERIES["op10_order_minhash"](spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _order(spark, rows):
    texts = spark.createDataFrame([(t or "",) for _, t in rows], "t string")
    key = {r["t"]: r["k"] for r in texts.selectExpr("t", "xxhash64(t) as k").collect()}
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: key[r[1] or ""])
    named.sort(key=lambda r: r[0], reverse=True)
    return named + sorted((r for r in rows if r[0] is None), key=lambda r: key[r[1] or ""])


KINDS = {
    "wide": ("long", [(s * (9 * 10**18 - i * 10**15), f"w{s}{i}") for i in range(60) for s in (1, -1)]),
    "ends": ("long", [(-2**63, "least"), (2**63 - 1, "most"), (0, "zero"), (None, "none")]),
    "text": ("string", [(f"id-{i * 37 % 101}", f"t{i}") for i in range(101)] + [(None, "n"), ("", "e")]),
    "outlier": ("long", [(i, f"o{i}") for i in range(150)] + [(10**17, "far")]),
    "nulls": ("long", [(i if i % 3 else None, f"u{i}") for i in range(300)]),
    "all null": ("long", [(None, f"v{i}") for i in range(50)]),
}


@pytest.mark.parametrize("kind", KINDS)
def test_next_for_ids_of_any_kind(spark, kind):
    typed, rows = KINDS[kind]
    df = spark.createDataFrame(rows, f"id {typed}, text string").repartition(3)
    order = _order(spark, rows)
    want = {r: order[(n + 1) % len(order)][1] for n, r in enumerate(order)}
    got = {(r["id"], r["text"]): r["next_text"] for r in with_next(df, 10).collect()}
    assert got == want


@pytest.mark.parametrize("kind", ["wide", "outlier", "nulls", "text"])
def test_no_block_is_large(spark, kind):
    typed, rows = KINDS[kind]
    df = spark.createDataFrame(rows, f"id {typed}, text string").withColumn("text_key", F.xxhash64("text"))
    bounds, n = P._bounds(df.select("id"), 10)
    nulls = sum(i is None for i, _ in rows)
    sizes = df.groupBy(P._block(bounds, n, max(1, nulls // 10))).count().collect()
    assert len(sizes) > 5 and max(r["count"] for r in sizes) <= 30
    known = df.where("id is not null").groupBy(P._block(bounds, n, 1)).count().collect()
    assert max(r["count"] for r in known) <= 10
