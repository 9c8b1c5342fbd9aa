"""The audit against filters applied one after another to lists of rows."""

from __future__ import annotations

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from shopflow.llm import filter_audit as A
from shopflow.llm.queries import QUERIES
from shopflow.sources.tables import read_table
from tests.llm.conftest import SMALL


def fails(rows):
    """Per row (id, text, lang): the letters it fails."""
    texts = {}
    for id_, text, _ in rows:
        texts.setdefault(text or "", []).append(id_)
    out = []
    for id_, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 100:
            f.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            f.add("C")
        if re.search("[#$%&*|]", t):
            f.add("D")
        known = [i for i in texts[t] if i is not None]
        if any(i < id_ for i in known) if id_ is not None else known:
            f.add("E")
        out.append(f)
    return out


def brute(rows, good, toxic):
    """Filters applied left to right, for every part and order."""
    failing, out = fails(rows), {}
    for part in {lang or "" for *_, lang in rows}:
        own = [(r[0], f) for r, f in zip(rows, failing) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                total[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone),
                    sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone), letter]
        for key, row in out.items():
            if key[0] == part and isinstance(row[-1], str):
                row[-1] = total[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def got(result):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = result.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def made(n, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words[:rng.choice((40, 300))], k=rng.choice((20, 99, 100, 150))))
        text = text.upper() if rng.random() < 0.2 else text
        text += rng.choice(("", "", " 50%", "\n#"))
        rows.append((i, text, rng.choice(("en", "fr", None, ""))))
    return rows + [(n + i, rng.choice(rows)[1], "en") for i in range(n // 2)]


def labels(spark, good, toxic):
    ids = sorted({*good, *toxic})
    return spark.createDataFrame([(i, int(i in good), int(i in toxic)) for i in ids] or [(-1, 0, 0)],
                                 "doc_id long, quality int, toxic int")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_every_order_and_step(spark):
    rows, good, toxic = made(120), set(range(0, 180, 3)), set(range(0, 180, 7))
    assert got(A.audit(docs(spark, rows), labels(spark, good, toxic))) == brute(rows, good, toxic)


def test_nulls_ties_and_repeated_rows(spark, odd_docs, odd_rows, no_docs):
    rows = [(r[0], r[1], r[2]) for r in odd_rows]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(A.audit(odd_docs, none)) == brute(rows, set(), set())
    again = spark.createDataFrame([(5, 1, None), (5, 0, 1), (None, 1, 1)], none.schema)
    assert got(A.audit(odd_docs, again)) == brute(rows, {5}, {5})
    assert A.audit(no_docs, none).count() == 0


def test_a_hot_text_is_counted_before_it_is_shuffled(spark):
    rows = [(i, "the same text", "en" if i % 2 else "fr") for i in range(3000)]
    result = A.audit(docs(spark, rows), labels(spark, {0, 1}, {2}))
    by = {(r.part, r.filter_order, r.step): r for r in result.collect()}
    assert by["fr", "EABCD", 1].removed == 1499 and by["fr", "EABCD", 2].removed == 1
    assert by["en", "EABCD", 1].removed == 1500 and by["en", "EABCD", 1].kept == 0


def test_gray_walk_visits_each_subset_by_one_toggle():
    rng = random.Random(1)
    for n in range(1, 7):
        cells = {m: [rng.randrange(9), rng.randrange(9)] for m in rng.sample(range(1 << n), rng.randint(1, 1 << n))}
        states = A.gray_walk(cells, n)
        for subset in range(1 << n):
            assert states[subset] == [sum(c[i] for m, c in cells.items() if not m & subset) for i in (0, 1)]


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in read_table(spark, SMALL, "documents").collect()]
    marks = read_table(spark, SMALL, "labels").collect()
    want = brute(rows, {r.doc_id for r in marks if r.quality == 1}, {r.doc_id for r in marks if r.toxic == 1})
    assert got(QUERIES["op12_filter_audit"](spark, SMALL)) == want


def test_states_are_stored_per_part(spark):
    cells = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 0, 2, 0, 1)],
                                  "part string, mask int, rows long, good long, toxic long")
    state = A.walk_states(cells).first()
    assert len(state.kept) == 32 and state.kept[0] == 7 and state.kept[31] == 2 and state.good[1] == 0
    steps = A.audit_steps(A.walk_states(cells))
    assert steps.count() == 600 and steps.where(F.col("shapley") == 300).count() == 240
