"""Connected components of a link table, by alternating stars.

Each round points every node's larger neighbours at the smallest node it knows
(large star), then every node's smaller neighbours likewise (small star). The
minimum per node is aggregated before the shuffle and joined back, so a node
with very many links is a skewed join key that can be split, never one group.
Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.store import Store


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) \
        if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(store: Store, links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b: long); label is the
    smallest node of its component. Self links and repeats are harmless; nodes
    without links to others do not appear; an empty table gives an empty one."""
    edges = store.save(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                     F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _fingerprint(edges)
    while seen[0]:
        large = store.save(_star(edges, True), "large-star")
        store.drop(edges)
        edges = store.save(_star(large, False), "small-star")
        store.drop(large)
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    # Stable: every edge leads from a node to the smallest node of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
