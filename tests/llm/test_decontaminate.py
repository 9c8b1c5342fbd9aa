import random
import re

import numpy as np

from shopflow.llm.decontaminate import DROP, MASKS, SPAN, best_part, contamination, grow
from shopflow.llm.queries import QUERIES

from .conftest import MEDIUM


def _words(text):
    return re.findall(r"\w+", (text or "").lower())


def _whole_items(docs, items):
    """Brute force: items that occur in a document word for word."""
    out = set()
    for d, text in docs:
        have = " " + " ".join(_words(text)) + " "
        out |= {(d, i) for i, t in items if " " + " ".join(_words(t)) + " " in have}
    return out


def test_masks_leave_every_two_substitutions_out():
    for a in range(SPAN):
        for b in range(SPAN):
            assert any(a not in m and b not in m for m in MASKS)


def test_query_finds_whole_items_and_nothing_else(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet")
            .select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet")
             .select("item_id", "text").collect()]
    rows = QUERIES["op2_decontamination"](spark, MEDIUM).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == _whole_items(docs, items)
    texts = dict(docs)
    benchmark = dict(items)
    for r in rows:
        own = _words(texts[r["doc_id"]])[r["first_word"]:r["first_word"] + r["overlap"]]
        assert len(set(_words(benchmark[r["item_id"]])) & set(own)) > 0
        assert r["matched"] >= 0.8 * r["overlap"]


def test_substitutions_are_tolerated(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(40)]
    docs = []
    for i, text in items:
        words = text.split()
        for at in range(rng.randrange(6), 30, 6):
            words[at] = "changed"
        docs.append((i, " ".join(rng.choices(vocabulary, k=80) + words + rng.choices(vocabulary, k=80))))
    docs += [(1000 + i, " ".join(rng.choices(vocabulary, k=200))) for i in range(40)]
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i, _ in items}


def test_passages_from_the_middle_of_an_item(spark):
    """Whole or with every fifth word changed, from any word of the item on."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(60)]
    docs, exact = [], {}
    for i, text in items:
        size = 13 if i < 30 else 25
        at = rng.randrange(6, 60 - size)
        words = text.split()[at:at + size]
        if i >= 30:
            words[4::5] = ["changed"] * 5
        else:
            exact[i] = 80
        docs.append((i, " ".join(rng.choices(vocabulary, k=80) + words + rng.choices(vocabulary, k=80))))
    found = {(r["doc_id"], r["item_id"]): r for r in contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(found) == {(i, i) for i, _ in items}
    for i, first in exact.items():
        r = found[i, i]
        assert (r["first_word"], r["overlap"], r["matched"]) == (first, 13, 13)


def test_best_part_equals_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        same = np.array([rng.random() < 0.6 for _ in range(rng.randrange(1, 40))], bool)
        least, share = rng.randrange(1, 16), rng.choice((0.5, 0.7, 0.9, 1.0))
        passing = [int(same[a:b].sum()) for a in range(len(same)) for b in range(a + least, len(same) + 1)
                   if same[a:b].sum() >= share * (b - a)]
        got = best_part(same, least, share)
        assert (got is None) == (not passing)
        if got:
            a, b = got
            assert b - a >= least and same[a:b].sum() >= share * (b - a)
            assert same[a:b].sum() == max(passing)


def test_case_and_punctuation_do_not_hide_an_item(spark):
    item = "Eins zwei drei VIER fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn"
    doc = "vorher «Eins, zwei; drei – vier FÜNF: sechs (sieben) acht. neun zehn elf zwölf dreizehn vierzehn!"
    found = contamination(spark.createDataFrame([(1, doc)], "doc_id long, text string"),
                          spark.createDataFrame([(2, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["matched"]) for r in found] == [(1, 2, 14)]


def test_short_items_are_found_whole(spark):
    items = [(1, "Who wrote it?"), (2, "who wrote"), (3, " ".join(f"w{i}" for i in range(11))),
             (4, "never there"), (5, "Ja"), (6, "...")]
    docs = [(1, "they asked: who WROTE it, then; who wrote it"), (2, "who, wrote this"),
            (3, " ".join(f"w{i}" for i in range(40))), (4, " ".join(f"w{i}" for i in range(10))),
            (5, "there never wrote who"), (6, "ja"), (7, "who"), (8, "wrote it")]
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in found) == [
        (1, 1, 2, 3, 3), (1, 2, 2, 2, 2), (2, 2, 0, 2, 2), (3, 3, 0, 11, 11), (6, 5, 0, 1, 1)]


def test_scripts_without_blanks(spark):
    items = [(1, "光合作用是植物把光能转化为化学能的过程吗？"), (2, "日本の首都はどこですか"),
             (3, "เมืองหลวงของประเทศไทยคือที่ไหน"), (4, "𠀀𠀁𠀂")]
    docs = [(1, "前面有别的字，光合作用是植物把光能转化为化学能的过程吗。后面也有。"),
            (2, "質問：「日本の首都はどこですか」と聞いた"), (3, "ก่อนเมืองหลวงของประเทศไทยคือที่ไหนหลัง"),
            (4, "x𠀀𠀁𠀂y"), (5, "光合作用"), (6, "日本の首都")]
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(1, 5)}
    assert all(r["matched"] == r["overlap"] for r in found)


def test_grow_takes_the_best_extension():
    same = np.array([0, 1, 1, 0, 1] + [1] * SPAN + [1, 0, 1, 1, 1, 0, 0, 0, 0, 1], bool)
    a, b = grow(same, 5)
    assert (a, b) == (4, 5 + SPAN + 5)
    assert DROP == 6


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (None, " ".join(f"w{i}" for i in range(100, 120))),
                                   (3, "too short")], "item_id long, text string")
    rows = contamination(odd_docs, items).collect()
    # Both ids that hold the long text, and one row for a repeated row.
    assert sorted((str(r["doc_id"]), r["item_id"], r["first_word"], r["matched"]) for r in rows) == [
        ("5", None, 100, 20), ("None", None, 100, 20)]
    assert contamination(no_docs, items).collect() == []
    assert contamination(odd_docs, items.where("false")).collect() == []


def _reach(steps):
    score = best = end = 0
    for n, same in enumerate(steps, 1):
        score += 1 if same else -2
        if score > best:
            best, end = score, n
        if max(best, 0) - score > DROP:
            break
    return end


def _best(same, least, share):
    n = len(same)
    if n < least:
        return None
    if sum(same) >= share * n:
        a, b = 0, n
    else:
        found = []
        for a in range(n):
            ends = [b for b in range(a + max(least, 1), n + 1) if sum(same[a:b]) >= share * (b - a) - 1e-9]
            if ends:
                found.append((sum(same[a:ends[-1]]), -a, ends[-1]))
        if not found:
            return None
        _, a, b = max(found)
        a = -a
    while b - a > least and not same[b - 1]:
        b -= 1
    while b - a > least and not same[a]:
        a += 1
    return a, b


def _brute(doc, item, min_overlap=13, share=0.7):
    """(first_word, overlap, matched) by laying the item on every diagonal."""
    best = None
    for diagonal in range(-len(item), len(doc)):
        lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
        same = [doc[i] == item[i - diagonal] for i in range(lo, hi)]
        done = (0, 0)
        for at in range(len(same) - SPAN + 1):
            if not any(all(same[at + p] for p in m) for m in MASKS) or (at >= done[0] and at + SPAN <= done[1]):
                continue
            done = a, b = at - _reach(same[:at][::-1]), at + SPAN + _reach(same[at + SPAN:])
            part = _best(same[a:b], min(min_overlap, len(item)), share)
            if part:
                x, y = a + part[0], a + part[1]
                best = max(best or (0, 0, 0), (sum(same[x:y]), y - x, -(lo + x)))
    return best and (-best[2], best[1], best[0])


def test_overlaps_against_brute_force(spark):
    """Item, place, length and agreeing words, also of long items and of parts of items."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(2000)]
    items = {i: rng.choices(vocabulary, k=rng.choice((20, 60, 250))) for i in range(10)}
    docs = {}
    for i, item in items.items():
        words = [w if rng.random() > i / 30 else "changed" for w in item]
        cut = rng.randrange(len(words) // 3)
        docs[i] = rng.choices(vocabulary, k=70) + words[cut:] + rng.choices(vocabulary, k=90) + words[:15]
    docs[100] = rng.choices(vocabulary, k=300)
    rows = contamination(
        spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["overlap"], r["matched"]) for r in rows}
    want = {(d, i): b for d, doc in docs.items() for i, item in items.items() if (b := _brute(doc, item))}
    assert got == want and len(got) >= 9


def test_overlaps_far_from_the_last_hit_are_whole(spark):
    """Every fourth word replaced after the first 14: growth goes on without a hit."""
    item = [f"w{i}" for i in range(400)]
    words = [w if i < 14 or i % 4 else "changed" for i, w in enumerate(item)]
    doc = ["before"] * 30 + words + ["behind"] * 30
    row, = contamination(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"),
                         spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert (row["first_word"], row["overlap"], row["matched"]) == _brute(doc, item)
    assert row["overlap"] > 390
