"""Exact duplicates against a dictionary of texts, also where hashes collide."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from shopflow.llm.exact_dedup import exact_duplicates
from shopflow.llm.queries import QUERIES
from shopflow.sources.tables import read_table
from tests.llm.conftest import SMALL


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    """Rows (id, text) -> sorted (id, keep_id, size, digest) and texts' kept counts."""
    groups = {}
    for id_, text in rows:
        groups.setdefault(normal(text), []).append(id_)
    out = []
    for id_, text in rows:
        ids = groups[normal(text)]
        known = [i for i in ids if i is not None]
        out.append((id_, min(known) if known else None, len(ids),
                    hashlib.sha256(normal(text).encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def check(result, rows):
    got = result.collect()
    want, n_groups = brute(rows)
    assert sorted([(r[0], r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n_groups == len({r.text_sha256 for r in kept})
    assert all(r[0] == r.keep_id for r in kept)


def docs(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, text string")


ROWS = [(3, "a  b"), (1, "a\t\nb"), (2, "a b"), (9, None), (8, ""), (7, " "), (6, "\x0b"), (5, "a b "),
        (4, "é b"), (10, "A b"), (11, "a b"), (12, "a b")]


def test_blanks_nulls_and_smallest_id(spark):
    check(exact_duplicates(docs(spark, ROWS)), ROWS)


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    rows = ROWS + [(20 + i, f"text {i % 7}") for i in range(60)] + [(None, "text 3"), (None, "lonely")]
    one = lambda text, digest: F.unhex(F.lit("00"))
    two = lambda text, digest: F.unhex(F.substring(digest, 1, 2))
    for weak in (one, two):
        check(exact_duplicates(docs(spark, rows), content_hash=weak), rows)


def test_repeated_rows_keep_one(spark):
    rows = [(1, "x y")] * 5 + [(1, "x  y")] * 3 + [(None, "z")] * 4 + [(2, "x y")]
    check(exact_duplicates(docs(spark, rows)), rows)


def test_text_ids_and_a_hot_group(spark):
    rows = [(f"id-{i:05d}", "the same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    check(exact_duplicates(docs(spark, rows, "string")), rows)


def test_odd_tables(spark, odd_docs, odd_rows, no_docs):
    check(exact_duplicates(odd_docs), [(r[0], r[1]) for r in odd_rows])
    got = exact_duplicates(odd_docs.withColumnRenamed("doc_id", "own").withColumnRenamed("text", "body"),
                           "own", "body")
    assert got.columns == ["own", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_duplicates(no_docs).count() == 0


def test_members_of_a_hot_group_are_compared_in_many_tasks(spark):
    """No task of the comparison holds a group: its members are dealt over salts."""
    from shopflow.llm import exact_dedup as X
    rows = spark.createDataFrame([(bytearray(b"a"), "t", 8, i) for i in range(2000)],
                                 "hash binary, norm string, salts long, row long")
    plan = X._unequal_hashes(rows, 1)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(hash" in line and "salt" in line]
    assert len(dealt) == 2 and "SortMergeJoin" in plan
    assert X._unequal_hashes(rows, 1).count() == 0
    odd = rows.withColumn("norm", F.when(F.col("row") == 1999, "u").otherwise(F.col("norm")))
    assert X._unequal_hashes(odd, 1).count() == 1


def test_query_reads_every_row(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SMALL, "documents").collect()]
    check(QUERIES["op11_exact_dedup"](spark, SMALL), rows)
