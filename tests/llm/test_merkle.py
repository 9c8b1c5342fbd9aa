"""The manifest against trees built and proofs climbed with plain lists."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from shopflow.llm import merkle as M
from shopflow.llm.queries import QUERIES
from shopflow.sources.tables import read_table
from tests.llm.conftest import SMALL

COLUMNS = M.COLUMNS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """Levels from the hashes up to one node."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i:i + 3])) for i in range(0, len(low), 3)])
    return levels


def climb(levels, i, folded, proof):
    for level in levels[:-1]:
        run = level[i - i % 3:i - i % 3 + 3]
        left, right = "".join(run[:i % 3]), "".join(run[i % 3 + 1:])
        proof += left + right
        folded = sha(left + folded + right)
        i //= 3
    return folded, proof


def brute(rows, tamper):
    """Rows (doc_id, source, lang, n_chars, text) -> sorted result tuples."""
    sources = {}
    for r in rows:
        sources.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(
            (r[0] is not None, r[0] if r[0] is not None else 0, leaf(r), leaf(tamper(r)), r))
    trees = []
    for key in sorted(sources):
        members = sorted(sources[key], key=lambda m: m[:4])
        trees.append((members, tree([m[2] for m in members])))
    top = tree([levels[-1][0] for _, levels in trees])
    out = []
    for place, (members, levels) in enumerate(trees):
        for i, m in enumerate(members):
            folded, proof = climb(levels, i, m[3], "")
            folded, proof = climb(top, place, folded, proof)
            out.append((m[4][0], m[2], levels[-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def untouched(row):
    return row


def query_tamper(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 2 or row[4] is None:
        return row
    return (*row[:4], row[4].replace("\n", ""))


def got(result):
    return sorted([tuple(r) for r in result.collect()], key=str)


def docs(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, source string, lang string, n_chars long, text string")


def made(sizes):
    return [(100 * s + i, None if s == 0 else f"src{s}", "en", i, f"line {i}\nof {s}")
            for s, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("sizes", [(1,), (2,), (3,), (4,), (0, 1, 1), (10, 3, 1, 9), (28,), (1, 1, 1, 1)])
def test_small_trees(spark, sizes):
    rows = made(sizes)
    assert got(M.manifest(docs(spark, rows))) == brute(rows, untouched)


def test_several_links_and_many_sources(spark, monkeypatch):
    """Links of two levels (blocks of nine), so trees are several links high."""
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "BLOCK", 9)
    for sizes in ((100, 9, 10, 1), (82, 81), (1,) * 30):
        rows = made(sizes)
        assert got(M.manifest(docs(spark, rows))) == brute(rows, untouched)


def test_a_source_above_one_block(spark):
    rows = made((3, 1600, 730, 729, 1))
    assert got(M.manifest(docs(spark, rows))) == brute(rows, untouched)


def test_tampered_rows_do_not_verify(spark):
    rows = made((5, 40, 2))
    changed = {"text": F.when(F.col("doc_id") == 103, F.lit("other")).otherwise(F.col("text"))}
    result = M.manifest(docs(spark, rows), tampered=changed)
    want = brute(rows, lambda r: (*r[:4], "other") if r[0] == 103 else r)
    assert got(result) == want
    assert [r.doc_id for r in result.where("not verified").collect()] == [103]


def test_nulls_ties_and_text_ids(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (None, "", None, 0, "x"), (1, "b", None, 1, "é"),
            (1, "b", "en", 1, "é"), (1, "b", "en", 1, "é"), (2, "a", "en", -5, "\n"), (3, "é", "en", 7, "y\n")]
    assert got(M.manifest(docs(spark, rows))) == brute(rows, untouched)
    named = [(None if r[0] is None else f"id{r[0]}", *r[1:]) for r in rows]
    result = got(M.manifest(docs(spark, named, "string")))
    assert len(result) == len(rows) and all(r[-1] for r in result)


def test_odd_tables(spark, odd_docs, odd_rows, no_docs):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows]
    assert got(M.manifest(odd_docs)) == brute(rows, untouched)
    empty = M.manifest(no_docs)
    assert empty.count() == 0 and empty.columns == M.manifest(odd_docs).columns


def test_row_limit_of_the_session_is_kept(spark):
    before = spark.conf.get(M.ROW_LIMIT_CONF)
    M.manifest(docs(spark, made((3,))))
    assert spark.conf.get(M.ROW_LIMIT_CONF) == before


def test_query_against_brute_force(spark):
    table = read_table(spark, SMALL, "documents")
    rows = [tuple(r) for r in table.select(*COLUMNS).collect()]
    result = QUERIES["op13_merkle_manifest"](spark, SMALL)
    assert got(result) == brute(rows, query_tamper)
    assert 0 < result.where("not verified").count() < len(rows)
