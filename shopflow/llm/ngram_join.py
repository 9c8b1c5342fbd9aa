"""N-gram Jaccard join: size-aware, light sets by subsets, heavy sets by lists.

A document's set holds its distinct k-word shingles (64-bit hashes). Two sets
link when ``den * |r & s| >= num * |r | s|``; the result gives each row its set
size and the smallest id of its component of links. Every link is found:

* Equal sets are one set from the start (128-bit digest).
* Light sets, of at most x shingles: two sets of sizes m, n link exactly when
  they share a subset of the fixed size ``c(m, n) = ceil(num(m+n)/(num+den))``.
  Each set lists these subsets for every partner size; sets that meet in a
  subset are linked to its least member. No pair is checked.
* Heavy sets: inverted lists are scanned. The shingles are first taken in hash
  order; a set whose prefix shares too few shingles with any other set cannot
  link and leaves. The rest are ordered by how many sets hold a shingle; only
  prefixes of rare shingles go into lists, lists with a common set form one
  cluster, and inside a cluster each set scans the lists of its shingles and
  counts overlaps exactly. Sets already joined to the cluster's hub are not
  scanned again, so a group of near copies costs about one scan per outsider.
  Clusters beyond ``block_shingles`` are cut into blocks that are met pairwise
  by separate tasks; only links leave a task, never candidate pairs.
* x is the size at which the rows written by both ways together are fewest,
  computed from the histogram of small sizes.

Defined results: null and blank texts have the empty set, link with nothing and
keep their own id. Rows repeated or with equal ids each get a row. A null id is
never a component's least id unless all its ids are null. Other columns are
ignored and may have any name.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.components import connected_components
from shopflow.llm.store import Store, bounded_batches, tidied
from shopflow.llm.words import buffers, chained, chunks, mix, word_hashes

#: Largest size up to which the subset way is considered at all.
LIGHT_LIMIT = 24
#: Shingles a task holds of one block of a cluster (eight bytes each).
BLOCK_SHINGLES = 1_000_000
#: Ids of surviving sets that are broadcast at most (eight bytes each).
BROADCAST_IDS = 500_000

_SETS = "id long, text_key long, digest binary, n long, head binary"


class Bound:
    """The threshold num/den in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("0 < num <= den")
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        """Overlap that a set of size n has with any partner, at least; also the
        least size of a partner."""
        return -(-self.num * n // self.den)

    def most(self, n: int) -> int:
        """Largest size of a partner."""
        return n * self.den // self.num

    def overlap(self, m: int, n: int) -> int:
        return -(-self.num * (m + n) // (self.num + self.den))

    def extra(self, n: int) -> int:
        """Shared shingles that the hash-ordered prefix must show."""
        return 1 + n // 10

    def head(self, n: int) -> int:
        """Length of the hash-ordered prefix."""
        return min(n, n - self.least(n) + self.extra(n))

    def subsets(self, n: int, x: int) -> Iterator[tuple[int, int]]:
        """(partner size, subset size) for every partner of at most x shingles."""
        for m in range(max(1, self.least(n)), min(x, self.most(n)) + 1):
            yield m, self.overlap(m, n)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, off = buffers(column)
    for a, b in chunks(off):
        words, first = word_hashes(raw, off[a:b + 1])
        runs, begin = chained(words, first, k)
        for i in range(b - a):
            own = runs[begin[i]:begin[i + 1]]
            if len(own) > 1:
                own = np.sort(own)
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield own


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _read_sets(k: int, bound: Bound):
    def run(batches):
        for batch in batches:
            digests, sizes, heads = [], [], []
            for s in shingle_sets(batch.column(2), k):
                n = len(s)
                digests.append(_digest(s))
                sizes.append(n)
                heads.append((s if n <= LIGHT_LIMIT else s[:bound.head(n)]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(heads, pa.binary())],
                ["id", "text_key", "digest", "n", "head"])
    return run


def _whole_sets(k: int):
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), k))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(s) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "shingles"])
    return run


def light_boundary(sizes: dict[int, int], bound: Bound) -> int:
    """The x with the fewest rows: subsets of light sets plus list entries of the
    sets that then still need lists."""
    top = max(sizes, default=0)
    best, best_cost = 0, None
    for x in range(0, LIGHT_LIMIT + 1):
        subsets = sum(c * math.comb(n, o) for n, c in sizes.items() if n <= x
                      for _, o in bound.subsets(n, x))
        lists = sum(c * (bound.head(n) + n) for n, c in sizes.items()
                    if bound.least(x + 1) <= n <= top)
        if best_cost is None or subsets + lists < best_cost:
            best, best_cost = x, subsets + lists
    return best


_choices: dict[tuple[int, int], np.ndarray] = {}


def _subset_keys(s: np.ndarray, m: int, c: int) -> np.ndarray:
    n = len(s)
    if (n, c) not in _choices:
        _choices[(n, c)] = np.array(list(itertools.combinations(range(n), c)), dtype=np.int64)
    picked = s[_choices[(n, c)]]
    lo, hi = min(m, n), max(m, n)
    acc = np.full(len(picked), np.uint64(lo * (LIGHT_LIMIT + 1) * 2 + hi))
    for j in range(c):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + picked[:, j])
    return acc


def _light_rows(bound: Bound, x: int):
    def run(batches):
        for batch in batches:
            sids = batch.column(0).to_pylist()
            heads = batch.column(1).to_pylist()
            keys, who, side = [], [], []
            held = 0
            for sid, head in zip(sids, heads, strict=True):
                s = np.frombuffer(head, np.uint64)
                for m, c in bound.subsets(len(s), x):
                    got = _subset_keys(s, m, c)
                    keys.append(got)
                    who.append(np.full(len(got), sid, np.int64))
                    side.append(np.full(len(got), 0 if m == len(s) else 1 if m > len(s) else 2,
                                        np.int32))
                    held += len(got)
                if held > 100_000:
                    yield _rows(keys, who, side)
                    keys, who, side, held = [], [], [], 0
            if held:
                yield _rows(keys, who, side)
    return run


def _rows(keys, who, side):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(who)),
         pa.array(np.concatenate(side))], ["key", "sid", "side"])


def light_links(sets: DataFrame, bound: Bound, x: int) -> DataFrame:
    """Links (a, b) among sets of at most x shingles."""
    rows = sets.where(F.col("n").between(1, x)).select("sid", "head").mapInArrow(
        _light_rows(bound, x), "key long, sid long, side int")
    met = rows.groupBy("key").agg(F.min("sid").alias("b"), F.max("sid").alias("top"),
                                  F.min("side").alias("s0"), F.max("side").alias("s1"))
    # Sets of one size meet among themselves; otherwise both sizes must be there.
    met = met.where("b <> top and (s1 = 0 or s0 <> s1)").select("key", "b")
    return rows.join(met, "key").where("sid <> b").select(F.col("sid").alias("a"), "b").distinct()


def _explode_shingles(head_of):
    def run(batches):
        for batch in batches:
            sids = batch.column(0).to_numpy()
            sizes = batch.column(1).to_numpy()
            blobs = batch.column(2).to_pylist()
            at = 0
            while at < len(blobs):
                part, held = [], 0
                begin = at
                while at < len(blobs) and held < 200_000:
                    s = np.frombuffer(blobs[at], np.uint64)
                    s = s[:head_of(int(sizes[at]))] if head_of else s
                    part.append(s)
                    held += len(s)
                    at += 1
                lens = [len(s) for s in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(part).view(np.int64)),
                     pa.array(np.repeat(sids[begin:at], lens)),
                     pa.array(np.repeat(sizes[begin:at], lens))], ["token", "sid", "n"])
    return run


def surviving(sets: DataFrame, bound: Bound, x: int) -> DataFrame:
    """Ids of the sets whose hash-ordered prefix allows a heavy link.

    Of two linked sets, both prefixes hold the first ``extra`` (of the smaller
    set) common shingles; so that many prefix shingles must occur in two sets.
    A shingle is at most once in a set's prefix: no list holds more than one row
    of a set, which bounds the part of all rows that one key can have.
    """
    heavy = sets.where(F.col("n") >= max(1, bound.least(x + 1))).select("sid", "n", "head")
    rows = heavy.mapInArrow(tidied(_explode_shingles(bound.head)), "token long, sid long, n long")
    shared = rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))) \
                 .where("df > 1")
    need = f"((n * {bound.num} + {bound.den - 1}) div {bound.den})"
    return shared.groupBy("sid").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")) \
        .where(f"shared >= 1 + {need} div 10").select("sid")


def rare_lists(whole: DataFrame, bound: Bound) -> DataFrame:
    """List entries (token, sid): each set's rarest shingles, as many as a link
    cannot do without, left out where no other set holds them."""
    rows = whole.mapInArrow(tidied(_explode_shingles(None)), "token long, sid long, n long")
    shared = rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))) \
                 .where("df > 1")
    own = Window.partitionBy("sid")
    need = f"((n * {bound.num} + {bound.den - 1}) div {bound.den})"
    # Shingles of one set only come first in the order and use up the prefix.
    return shared.withColumn("held", F.count(F.lit(1)).over(own)) \
        .withColumn("rank", F.row_number().over(own.orderBy("df", "token"))) \
        .where(f"rank <= held - {need} + 1").select("token", "sid")


def scan_lists(sids: np.ndarray, sets: list[np.ndarray], bound: Bound) -> list[tuple[int, int]]:
    """Links that join the sets' components, by scanning inverted lists.

    The hub (the set whose shingles most others hold) comes first; a set that is
    in the hub's component when its turn comes is not scanned: any link it has
    to a later set is either found by that set's scan or inside the component.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    row_of = np.repeat(np.arange(m), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(token)
    keep = df[token] > 1
    token, row_of = token[keep], row_of[keep]
    order = np.argsort(token, kind="stable")
    lists = row_of[order]
    starts = np.zeros(len(df) + 1, np.int64)
    np.cumsum(np.bincount(token, minlength=len(df)), out=starts[1:])
    own = np.zeros(m + 1, np.int64)
    np.cumsum(np.bincount(row_of, minlength=m), out=own[1:])
    weight = np.zeros(m)
    np.add.at(weight, row_of, df[token])
    turn = np.argsort(-weight / np.maximum(sizes, 1), kind="stable")
    label = np.arange(m)
    hub = turn[0]
    links = []
    for r in turn:
        if r != hub and label[r] == label[hub]:
            continue
        mine = token[own[r]:own[r + 1]]
        lens = starts[mine + 1] - starts[mine]
        total = int(lens.sum())
        if total == 0:
            continue
        shift = np.repeat(starts[mine] - (np.cumsum(lens) - lens), lens)
        count = np.bincount(lists[shift + np.arange(total)], minlength=m)
        linked = count * (bound.num + bound.den) >= bound.num * (sizes + sizes[r])
        linked[r] = False
        for s in np.flatnonzero(linked):
            if label[s] != label[r]:
                links.append((int(sids[r]), int(sids[s])))
                label[label == label[s]] = label[r]
    return links


def _scan_groups(bound: Bound):
    def finish(sids, sets):
        return scan_lists(np.array(sids), sets, bound) if len(sets) > 1 else []

    def run(batches):
        key, sids, sets, out = None, [], [], []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for cluster, i, j, sid, blob in zip(*cols, strict=True):
                if (cluster, i, j) != key:
                    if sets:
                        out += finish(sids, sets)
                    key, sids, sets = (cluster, i, j), [], []
                sids.append(sid)
                sets.append(np.frombuffer(blob, np.uint64))
            if len(out) > 10_000:
                yield _link_batch(out)
                out = []
        if sets:
            out += finish(sids, sets)
        yield _link_batch(out)
    return run


def _link_batch(out):
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()),
                                       pa.array([b for _, b in out], pa.int64())], ["a", "b"])


def heavy_links(store: Store, docs: DataFrame, sets: DataFrame, bound: Bound, x: int, k: int,
                block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) with a set of more than x shingles; enough of them to connect
    what is connected."""
    alive = store.save(surviving(sets, bound, x).join(
        sets.select("sid", "digest", "id", "n"), "sid"), "alive")
    ids = alive.select("id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    whole = store.save(
        texts.mapInArrow(tidied(_whole_sets(k)), "digest binary, shingles binary")
             .join(alive.select("sid", "digest", "n"), "digest")
             .groupBy("sid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")),
        "whole")
    lists = store.save(rare_lists(whole, bound), "lists")
    roots = lists.groupBy("token").agg(F.min("sid").alias("b"), F.max("sid").alias("top")) \
                 .where("b <> top").select("token", "b")
    clusters = store.save(connected_components(
        store, lists.join(roots, "token").select(F.col("sid").alias("a"), "b")), "clusters")
    store.drop(lists)
    members = whole.join(clusters.withColumnRenamed("node", "sid"), "sid")
    width = members.groupBy("label").agg(F.sum("n").alias("total")).select(
        "label", F.ceil(F.col("total") / F.lit(block_shingles)).cast("int").alias("blocks"))
    # A cluster of several blocks meets in every two blocks; links within one
    # block are found along.
    blocks = members.join(width, "label").withColumn(
        "own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
            F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own")))))
    grouped = blocks.select("label", F.least("own", "other").alias("i"),
                            F.greatest("own", "other").alias("j"), "sid", "shingles") \
        .repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    found = store.save(grouped.mapInArrow(tidied(_scan_groups(bound)), "a long, b long"), "links")
    for done in (whole, clusters, alive):
        store.drop(done)
    return found


def ngram_classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100,
                  id_col: str = "doc_id", text_col: str = "text",
                  block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, text_key, n_shingles, class_id, component_id), one row per row of
    ``docs``. ``text_key`` is xxhash64 of the text; ``class_id`` names the component
    within this run (null for the empty set), ``component_id`` is its least id."""
    spark, bound = docs.sparkSession, Bound(num, den)
    store = Store(spark, "ngram-join")
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    read = store.save(docs.select("id", F.xxhash64("text").alias("text_key"), "text")
                          .mapInArrow(tidied(_read_sets(k, bound)), _SETS), "read")
    rows = store.save(read.select("id", "text_key", "digest", "n"), "rows")
    sets = store.save(
        read.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"),
                                                  F.first("head").alias("head"))
            .withColumn("sid", F.monotonically_increasing_id()), "sets")
    store.drop(read)
    small = {r["n"]: r["count"] for r in
             sets.where(F.col("n") <= bound.most(LIGHT_LIMIT + 1)).groupBy("n").count().collect()}
    x = light_boundary(small, bound)
    heavy = heavy_links(store, docs, sets, bound, x, k, block_shingles)
    light = store.save(light_links(sets, bound, x), "light")
    labels = connected_components(store, heavy.unionByName(light)).withColumnRenamed("node", "sid")
    least = sets.select("sid", "id").join(labels, "sid") \
        .groupBy("label").agg(F.min("id").alias("least_id"))
    classes = store.save(
        sets.select("sid", "digest", "id").join(labels, "sid", "left").join(least, "label", "left")
            .select("digest", F.coalesce("label", "sid").alias("class_id"),
                    F.coalesce("least_id", "id").alias("component_id")), "classes")
    # A row of the empty set is a component of its own.
    return rows.join(classes, "digest", "left").select(
        "id", "text_key", F.col("n").alias("n_shingles"), "class_id",
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def ngram_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100,
                     id_col: str = "doc_id", text_col: str = "text",
                     block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id_col, n_shingles, component_id), one row per row of ``docs``."""
    return ngram_classes(docs, k, num, den, id_col, text_col, block_shingles).select(
        F.col("id").alias(id_col), "n_shingles", "component_id")
