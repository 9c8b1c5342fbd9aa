"""Filter interaction audit: what each filter removes at each place of every order.

A row's failures are one bit per filter, so a table is summed up by its mask
cells (two to the power of the filters) per part: rows, and rows of each label.
A Gray-code walk visits all subsets of filters, toggling one filter at a time:
every mask cell counts its failures among the active filters, and a cell whose
counter leaves or reaches zero leaves or joins the running survivors. The
survivors of every subset (32 states for five filters) are stored; what a filter
removes at any step of any order is the difference of two states.

The texts are read once. Rows of equal texts are counted together before they
are shuffled by text; no task holds more of a text than one row per (part,
labels). The walk handles one part of 32 cells at a time, in tasks.

Defined results: a null text counts as empty, null and empty languages are one
part. Rows without a label row are neither good nor toxic; of several label rows
of one id, any with the value 1 counts. "Identical to a smaller id's text": a null
id is larger than every other id; rows of one id and text are not smaller than each other.
An empty table gives no rows. Texts are judged whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.llm.store import Store

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Filters that look at the text alone: too short, repetitive, shouting, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n_words < 100, "B": 100 * n_distinct < 80 * n_words,
            "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(SYMBOLS)}


def failure_mask(failures: list[Column]) -> Column:
    """Bit i is set where filter i fails; a null condition is no failure."""
    mask = F.lit(0)
    for i, fails in enumerate(failures):
        mask = mask + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def document_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "lang") -> DataFrame:
    """(part, mask, rows, good, toxic): the rows of each mask cell of filters A to E."""
    store = Store(docs.sparkSession, "filter-audit")
    text = F.coalesce(F.col(text_col), F.lit(""))
    failures = text_failures(F.col("text"))
    judged = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                         text.alias("text")).select(
        "id", "part", failure_mask(list(failures.values())).alias("mask"),
        F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = labels.select(F.col("doc_id").alias("marked"), (F.col("quality") == 1).alias("q"),
                          (F.col("toxic") == 1).alias("t")).groupBy("marked").agg(
        F.max(F.coalesce("q", F.lit(False))).alias("good"),
        F.max(F.coalesce("t", F.lit(False))).alias("toxic"))
    marked = judged.join(marks, judged["id"] == marks["marked"], "left").select(
        "id", "part", "mask", "digest", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # Equal texts have equal masks. Per text and kind of row: how many, the smallest
    # id and how many rows have it.
    kind = ["digest", "mask", "part", "good", "toxic"]
    ids = marked.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id"))
    kinds = store.save(ids.groupBy(*kind).agg(
        F.sum("n").alias("n"), first.alias("first"),
        F.min_by("n", F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("n_first")), "kinds")
    of_text = kinds.groupBy("digest").agg(F.min("first").alias("least"))
    copies = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(F.lit(0))
    cells = kinds.join(of_text, "digest").select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), copies.alias("n")),
            F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"),
                     (F.col("n") - copies).alias("n")))).alias("cell"))
    n = F.col("cell.n")
    return cells.where("cell.n > 0").groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum(n).alias("rows"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def gray_walk(cells: dict[int, list[int]], n_filters: int) -> list[list[int]]:
    """Survivors (one sum per measure) of every subset of filters, by subset.
    Subset k ^ (k >> 1) differs from the one before by the filter of k's lowest bit."""
    width = len(next(iter(cells.values())))
    failing = dict.fromkeys(cells, 0)
    running = [sum(c[i] for c in cells.values()) for i in range(width)]
    states = [[]] * (1 << n_filters)
    states[0] = list(running)
    for k in range(1, 1 << n_filters):
        subset, bit = k ^ (k >> 1), k & -k
        on = bool(subset & bit)
        for mask, sums in cells.items():
            if not mask & bit:
                continue
            was = failing[mask]
            failing[mask] = was + 1 if on else was - 1
            if was == 0 or failing[mask] == 0:
                for i, x in enumerate(sums):
                    running[i] += -x if on else x
        states[subset] = list(running)
    return states


def walk_states(cells: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """(part, kept, good, toxic): arrays over all subsets of filters, by subset number."""
    packed = cells.groupBy("part").agg(
        F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("cells")).select(
        "part", "cells.mask", "cells.rows", "cells.good", "cells.toxic")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            walked = [gray_walk({int(m): [int(x) for x in sums] for m, *sums in zip(*cells)}, n_filters)
                      for cells in zip(frame["mask"], frame["rows"], frame["good"], frame["toxic"])]
            yield pd.DataFrame({"part": frame["part"]} | {
                name: pd.Series([[s[i] for s in states] for states in walked], dtype=object, index=frame.index)
                for i, name in enumerate(("kept", "good", "toxic"))})

    return packed.mapInPandas(walk, "part string, kept array<long>, good array<long>, toxic array<long>")


def _steps(letters: str) -> Column:
    """All steps of all orders as one array: (filter_order, step, filter, before, after)."""
    out = []
    for order in permutations(letters):
        before = 0
        for i, letter in enumerate(order):
            after = before | 1 << letters.index(letter)
            out.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"),
                                F.lit(letters.index(letter)).alias("filter"),
                                F.lit(before).alias("before"), F.lit(after).alias("after")))
            before = after
    return F.array(*out)


def audit_steps(states: DataFrame, letters: str = FILTERS) -> DataFrame:
    """Every step of every order, from differences of stored states."""
    full = (1 << len(letters)) - 1
    at = lambda array, subset: F.get(array, subset)
    lost = lambda array, a, b: F.get(array, a) - F.get(array, b)
    s = states.withColumn("s", F.explode(_steps(letters))).select("*", "s.*").drop("s")
    alone = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(letters))]), F.col("filter") + 1)
    removed = lost("kept", F.col("before"), F.col("after"))
    steps = s.select(
        "part", "filter_order", "step", "filter", at("kept", F.col("after")).alias("kept"),
        removed.alias("removed"), (lost("kept", F.lit(0), alone) - removed).alias("redundant"),
        lost("kept", full - alone, F.lit(full)).alias("unique_fails"),
        lost("good", F.col("before"), F.col("after")).alias("good_lost"),
        lost("toxic", F.col("before"), F.col("after")).alias("toxic_lost"))
    # A part's filter has as many rows as there are orders.
    whole = steps.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return steps.join(whole, ["part", "filter"]).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) for every part, order of the five filters and step."""
    store = Store(docs.sparkSession, "filter-states")
    cells = document_cells(docs, labels, id_col, text_col, part_col)
    return audit_steps(store.save(walk_states(cells), "states"))
