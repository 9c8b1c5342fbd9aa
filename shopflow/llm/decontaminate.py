"""Benchmark decontamination by spaced-seed hashing.

Texts and items become word hashes (lower case; letters and digits). A window of
``SPAN`` words is cut into ``PARTS`` equal parts; each of the fixed masks ignores
two of the parts, so any two substituted words in a window leave at least one
mask untouched. Masked windows of the items (the test hashes) are joined with
those of the documents (the training hashes). Around a hit, item and document
are laid word against word on the hit's diagonal and the overlap grows both ways
while it scores: +1 a match, -2 a mismatch, until it falls ``DROP`` below its
best. Every hit that earlier growth did not reach is grown. The part of it with
the most agreeing words counts as contamination when it is ``min_overlap`` words
long (or as long as the item) and ``min_match`` of its words agree.

The documents' windows pass a bitmap of the test hashes before the join. The
bitmap has a fixed size whatever the benchmark's; it lets every true hit pass,
and the join drops the others. Documents are read once; what passes is written
as regions in the shared folder: the words from the longest item's length before the first of
neighbouring hits to as many behind the last, so no overlap is cut. (Hits nearer than that
share a region, so regions hold three times the document's words at most.)

Items shorter than one window are found where their whole word sequence stands,
by its hash; a row gives the first place. Each character of a script written
without blanks (Han, kana, Thai and others) counts as a word.

Defined results: null or empty texts, and those without a word, match nothing. Every row of documents is judged by its text; a row per (row's
id, text, item) found, so repeated rows give one row. Null ids are carried.
Other columns are ignored and may have any name. Very long texts are searched whole; an
empty table of documents or items gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.store import Store, bounded_batches, tidied
from shopflow.llm.words import buffers, chunks, mix, word_hashes

SPAN, PARTS = 12, 4
#: Word positions that each mask compares: all but two of the four parts.
MASKS = tuple(
    tuple(p for p in range(SPAN) if p // (SPAN // PARTS) not in left_out)
    for left_out in itertools.combinations(range(PARTS), 2))
DROP = 6
BITMAP_BITS = 24
#: Word hashes of all items up to so many bytes are broadcast, else shuffled.
BROADCAST_BYTES = 8 << 20

_FACTORS = mix(np.arange(1, SPAN + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HITS = "array<struct<mask:int,hash:long,pos:int>>"


def window_hashes(words: np.ndarray) -> list[np.ndarray]:
    """For each mask, the hash of every window (also of those across rows)."""
    n = max(0, len(words) - SPAN + 1)
    scaled = {p: words[p:p + n] * _FACTORS[p] for p in range(SPAN)}
    out = []
    for number, mask in enumerate(MASKS):
        acc = np.full(n, _FACTORS[number])
        for p in mask:
            acc += scaled[p]
        out.append(acc)
    return out


def whole_windows(first: np.ndarray, n_words: int, span: int = SPAN) -> np.ndarray:
    """Which windows lie within one row."""
    n = max(0, n_words - span + 1)
    inside = np.ones(n, bool)
    for cut in first[1:-1]:
        inside[max(0, cut - span + 1):cut] = False
    return inside


def short_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` words, for items shorter than a window."""
    count = max(0, len(words) - n + 1)
    acc = np.full(count, _FACTORS[n] * _STEP)
    for p in range(n):
        acc += words[p:p + count] * _FACTORS[p]
    return mix(acc)


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << BITMAP_BITS) - 1)
    return (h >> np.uint64(64 - BITMAP_BITS)), (h >> np.uint64(8)) & low


def _item_rows(batches):
    """(iid, words, hashes): an item's word hashes and its masked windows."""
    for batch in batches:
        raw, off = buffers(batch.column(1))
        blobs, hits = [], []
        for i in range(len(off) - 1):
            words, _ = word_hashes(raw, off[i:i + 2], plain_words=True, characters=True)
            blobs.append(words.tobytes())
            n = len(words)
            # An item shorter than a window is one hash, its number of words the mask's.
            masks = {len(MASKS) + n: short_hashes(words, n)} if 0 < n < SPAN else \
                dict(enumerate(window_hashes(words)))
            hits.append([{"mask": m, "hash": int(v), "pos": p} for m, h in masks.items()
                         for p, v in enumerate(h.view(np.int64))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(blobs, pa.binary()),
             pa.array(hits, pa.list_(pa.struct([("mask", pa.int32()), ("hash", pa.int64()),
                                                ("pos", pa.int32())])))],
            ["item_id", "words", "hits"])


def bitmap(test: DataFrame) -> bytes:
    """The bits of all test hashes; at most 2**BITMAP_BITS bits reach the driver."""
    shift = 64 - BITMAP_BITS
    low = (1 << BITMAP_BITS) - 1
    bits = test.select(F.explode(F.array(
        F.shiftrightunsigned("hash", shift),
        F.shiftrightunsigned("hash", 8).bitwiseAND(F.lit(low)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for row in words.collect():
        out[row["word"]] = row["bits"]
    return out.tobytes()


def _regions(shared_bits, lengths, context):
    def run(batches):
        bits = np.frombuffer(shared_bits.value, np.uint64)
        one, six, low = np.uint64(1), np.uint64(6), np.uint64(63)

        def held(at):
            return (bits[at >> six] >> (at & low)) & one == one

        for batch in batches:
            raw, off = buffers(batch.column(2))
            out = {"row": [], "start": [], "words": [], "hits": []}
            for a, b in chunks(off):
                words, first = word_hashes(raw, off[a:b + 1], plain_words=True, characters=True)
                inside = whole_windows(first, len(words))
                found = []
                for m, h in enumerate(window_hashes(words)):
                    p, q = _probes(h)
                    at = np.flatnonzero(held(p) & inside)
                    at = at[held(q[at])]
                    if len(at):
                        found.append((np.full(len(at), m, np.int32), h[at].view(np.int64), at))
                if found:
                    _collect(out, found, words, first, a, context)
                for n in lengths:
                    h = short_hashes(words, n)
                    p, q = _probes(h)
                    at = np.flatnonzero(held(p) & whole_windows(first, len(words), n))
                    at = at[held(q[at])]
                    if len(at):
                        _collect_short(out, n, h[at].view(np.int64), at, words, first, a)
            rows = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows),
                 pa.array(out["start"], pa.int32()), pa.array(out["words"], pa.binary()),
                 pa.array(out["hits"], pa.list_(pa.struct(
                     [("mask", pa.int32()), ("hash", pa.int64()), ("pos", pa.int32())])))],
                ["id", "text_key", "start", "words", "hits"])
    return run


def _collect(out, found, words, first, base, context):
    """Hits less than ``context`` words apart in a row form one region, with so
    many words on each side."""
    mask, value, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    mask, value, at = mask[order], value[order], at[order]
    row = np.searchsorted(first, at, side="right") - 1
    new = np.concatenate(([True], (np.diff(at) >= max(SPAN, context)) | (np.diff(row) > 0)))
    edges = np.append(np.flatnonzero(new), len(at))
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        r = int(row[s])
        lo = max(int(first[r]), int(at[s]) - context)
        hi = min(int(first[r + 1]), int(at[e - 1]) + SPAN + context)
        out["row"].append(base + r)
        out["start"].append(lo - int(first[r]))
        out["words"].append(words[lo:hi].tobytes())
        out["hits"].append([{"mask": int(m), "hash": int(v), "pos": int(p) - lo}
                            for m, v, p in zip(mask[s:e], value[s:e], at[s:e], strict=True)])


def _collect_short(out, n, value, at, words, first, base):
    """The first occurrence in a row of each run of n words is a region."""
    row = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((at, value, row))
    new = np.concatenate(([True], (np.diff(value[order]) != 0) | (np.diff(row[order]) != 0)))
    for k in order[new]:
        r, p = int(row[k]), int(at[k])
        out["row"].append(base + r)
        out["start"].append(p - int(first[r]))
        out["words"].append(words[p:p + n].tobytes())
        out["hits"].append([{"mask": len(MASKS) + n, "hash": int(value[k]), "pos": 0}])


def grow(same: np.ndarray, at: int) -> tuple[int, int]:
    """The overlap [a, b) around the window that starts at ``at``: the best
    scoring extension each way, given up once it falls DROP below its best."""
    def reach(steps):
        size = 256
        while True:
            score = np.cumsum(np.where(steps[:size], 1, -2))
            if len(score) == 0:
                return 0
            best = np.maximum.accumulate(np.maximum(score, 0))
            stop = np.flatnonzero(best - score > DROP)
            if len(stop) or size >= len(steps):
                break
            size *= 4
        score = score[:stop[0]] if len(stop) else score
        return int(np.argmax(score)) + 1 if len(score) and score.max() > 0 else 0
    return at - reach(same[:at][::-1]), at + SPAN + reach(same[at + SPAN:])


def best_part(same: np.ndarray, least: int, min_match: float) -> tuple[int, int] | None:
    """Of the stretches of ``same`` that are ``least`` long and agree in
    ``min_match`` of their words, the one with the most agreeing words, without
    the mismatches at its ends (down to ``least``)."""
    n = len(same)
    if n < least:
        return None
    count = np.concatenate(([0], np.cumsum(same)))
    a, b = 0, n
    if count[n] < min_match * n:
        # For each start the last end that keeps the share.
        over = count - min_match * np.arange(n + 1)
        after = np.maximum.accumulate(over[::-1])
        end = n - np.searchsorted(after, over - 1e-9, side="left")
        good = np.flatnonzero(end - np.arange(n + 1) >= max(least, 1))
        if not len(good):
            return None
        a = int(good[np.argmax(count[end[good]] - count[good])])
        b = int(end[a])
    while b - a > least and not same[b - 1]:
        b -= 1
    while b - a > least and not same[a]:
        a += 1
    return a, b


def _overlaps(same: np.ndarray, seeds: list[int], least: int, min_match: float):
    """(a, b) of the best passing part of each overlap grown on a diagonal. A window
    inside the overlap grown before it would grow to a part of that overlap. A
    diagonal shorter than a window is that of a short item, found whole."""
    if len(same) < SPAN:
        if same.all():
            yield 0, len(same)
        return
    done = (0, 0)
    for at in sorted(seeds):
        if at >= done[0] and at + SPAN <= done[1]:
            continue
        done = a, b = grow(same, at)
        part = best_part(same[a:b], least, min_match)
        if part:
            yield a + part[0], a + part[1]


def _verify(min_overlap: int, min_match: float):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            keep, start, length, matched = [], [], [], []
            for i, r in enumerate(rows):
                doc = np.frombuffer(r["words"], np.uint64)
                item = np.frombuffer(r["item_words"], np.uint64)
                seeds: dict[int, list[int]] = {}
                for h in r["at"]:
                    seeds.setdefault(h["diagonal"], []).append(h["pos"])
                best = None
                for diagonal, at in seeds.items():
                    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
                    same = doc[lo:hi] == item[lo - diagonal:hi - diagonal]
                    for a, b in _overlaps(same, [p - lo for p in at],
                                          min(min_overlap, len(item)), min_match):
                        n = int(same[a:b].sum())
                        best = max(best or (0, 0, 0), (n, b - a, -(r["start"] + lo + a)))
                if best:
                    keep.append(i)
                    matched.append(best[0])
                    length.append(best[1])
                    start.append(-best[2])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("text_key").take(at),
                 batch.column("item_id").take(at), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(matched, pa.int64())],
                ["id", "text_key", "item_id", "first_word", "overlap", "matched"])
    return run


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", min_overlap: int = 13,
                  min_match: float = 0.7) -> DataFrame:
    """(id_col, text_key, item_id, first_word, overlap, matched): for each document
    row and item that overlap, the overlap with the most matching words.
    ``text_key`` is xxhash64 of the text."""
    spark = docs.sparkSession
    store = Store(spark, "decontaminate")
    bounded_batches(spark)
    tests = store.save(
        items.select(F.col(item_id_col).alias("item_id"), F.lower(item_text_col).alias("text"))
             .mapInArrow(_item_rows, f"item_id {dict(items.dtypes)[item_id_col]}, words binary, "
                                     f"hits {_HITS}")
             .withColumn("iid", F.monotonically_increasing_id()), "items")
    test = tests.select("iid", F.explode("hits").alias("h")).select(
        "iid", "h.mask", "h.hash", F.col("h.pos").alias("item_pos"))
    bits = spark.sparkContext.broadcast(bitmap(test))
    n_words = (F.octet_length("words") / 8).cast("int")
    lengths = sorted(r["n"] for r in tests.select(n_words.alias("n")).where(
        (F.col("n") > 0) & (F.col("n") < SPAN)).distinct().collect())
    context = tests.agg(F.max(n_words).alias("n")).first()["n"] or 0
    regions = store.save(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"),
                    F.lower(text_col).alias("text"))
            .mapInArrow(tidied(_regions(bits, lengths, context)), f"id {dict(docs.dtypes)[id_col]}, text_key long, "
                                        f"start int, words binary, hits {_HITS}")
            .withColumn("rid", F.monotonically_increasing_id()), "regions")
    train = regions.select("rid", F.explode("hits").alias("h")).select(
        "rid", "h.mask", "h.hash", "h.pos")
    # Every hit of a diagonal: an overlap may begin behind the first.
    hits = train.join(test, ["mask", "hash"]).groupBy("rid", "iid").agg(F.collect_set(F.struct(
        (F.col("pos") - F.col("item_pos")).alias("diagonal"), "pos")).alias("at"))
    known = tests.select("iid", "item_id", F.col("words").alias("item_words"))
    size = known.agg(F.sum(F.octet_length("item_words") + 32).alias("bytes")).first()["bytes"] or 0
    if size <= BROADCAST_BYTES:
        known = F.broadcast(known)
    verified = hits.join(regions.select("rid", "id", "text_key", "start", "words"), "rid") \
        .join(known, "iid").select("id", "text_key", "item_id", "start", "words", "item_words", "at") \
        .mapInArrow(_verify(min_overlap, min_match),
                    f"id {dict(docs.dtypes)[id_col]}, text_key long, "
                    f"item_id {dict(items.dtypes)[item_id_col]}, first_word long, overlap long, "
                    "matched long")
    best = F.max(F.struct("matched", "overlap", (-F.col("first_word")).alias("first"))).alias("m")
    return verified.groupBy(F.col("id").alias(id_col), "text_key", "item_id").agg(best).select(
        id_col, "text_key", "item_id", (-F.col("m.first")).alias("first_word"),
        F.col("m.overlap").alias("overlap"), F.col("m.matched").alias("matched"))
