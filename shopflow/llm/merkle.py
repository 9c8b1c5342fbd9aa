"""Merkle manifest of a table: levels built once, proofs climbed by a recursive query.

Every row is a leaf: the SHA-256 of its named columns. Within a source, leaves
ascend by id; every three consecutive nodes become the hash of their
concatenation until one, the source's subroot, remains; the subroots, ordered by
source, likewise give the root. A change to any row changes the root, and a row
is verified by its proof alone (the siblings met on the way up).

The built levels are stored as parent-linked node rows. A link leads ``LEVELS``
levels up at once and lists the siblings met on those levels, so a tree of 10^11
leaves is five links high; the last link of a source leads into the tree of the
subroots. A Spark recursive query climbs from every leaf: it appends each link's
siblings to the proof and folds the leaf's (possibly tampered) hash with them.

Leaves are numbered without a window over a source (``plans.ordinal``), blocks of
3^LEVELS nodes are built in one row each, and each link shrinks the tree by that
factor, so a source of any size is spread over tasks. A leaf's own link is read
with the leaf; only the upper nodes (1 in 729 rows and fewer) are joined, by a
broadcast while their measured bytes allow it, else by a shuffled join whose hot
keys adaptive execution splits.

Defined results: null columns are written ``-``; a null source comes first and is
a source of its own, other than the empty one. Null ids come first in a source and
are not tampered with. Rows of one id ascend by their leaf; rows equal in every named column are
interchangeable. A source of one row has its leaf as subroot; a table of one row
has it as root, with an empty proof. An empty table gives no rows. Texts are hashed
whole. Columns not named play no part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.llm.store import Store
from shopflow.plans.joins import counted_broadcast
from shopflow.plans.ordinal import position_within

#: Nodes that become one, levels that a stored link spans, and nodes under one link.
ARITY, LEVELS = 3, 6
BLOCK = ARITY ** LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots; trees of sources are named "" (null) or "=source".
TOP = "top"
ROW_LIMIT_CONF = "spark.sql.cteRecursionRowLimit"


def leaf_hash(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the columns, each as byte count, colon, value."""
    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def fold(path: str, start: str) -> str:
    """SQL: the hash at the upper end of a link, from the one at its lower end."""
    return f"aggregate({path}, {start}, (h, s) -> sha2(concat(s.l, h, s.r), 256))"


def _linked(nodes: DataFrame, several: Column, store: Store, name: str, extra: list[str]) -> DataFrame:
    """Blocks of consecutive nodes (tree, idx, hash, ``extra``), one row each, with the
    levels above them: ``l0`` the nodes' hashes, ``l1`` .. one level each.
    ``several`` tells whether the tree has more than one block (then all levels of a block are built,
    in the last and smaller block too); a tree of one block ends at its first level of one node."""
    blocks = nodes.groupBy("tree", F.expr(f"idx div {BLOCK}").alias("block"), several.alias("several")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "hash", *extra))).alias("nodes"))
    built = blocks.withColumn("l0", F.col("nodes.hash"))
    for k in range(1, LEVELS + 1):
        below = f"l{k - 1}"
        merged = F.expr(f"transform(sequence(0, (size({below}) - 1) div {ARITY}), i -> "
                        f"sha2(array_join(slice({below}, cast(i * {ARITY} + 1 as int), {ARITY}), ''), 256))")
        built = built.withColumn(f"l{k}", F.when(F.col("several") | (F.size(below) > 1), merged)
                                 .otherwise(F.col(below)))
    return store.save(built, name)


def _path() -> str:
    """SQL over a block's row: the siblings left and right of node ``i`` on each level that
    was built (a level of one node in a tree of one block was not)."""
    levels = []
    for k in range(LEVELS):
        own = f"cast(i div {ARITY ** k} as int)"
        left = f"array_join(slice(l{k}, {own} - {own} % {ARITY} + 1, {own} % {ARITY}), '')"
        right = f"array_join(slice(l{k}, {own} + 2, {ARITY - 1} - {own} % {ARITY}), '')"
        levels.append(f"case when several or size(l{k}) > 1 then named_struct('l', {left}, 'r', {right}) end")
    return f"filter(array({', '.join(levels)}), s -> s is not null)"


def _node_rows(blocks: DataFrame, step: int, extra: list[str]) -> DataFrame:
    """A block's nodes as rows (tree, step, idx), with the link to the block's top."""
    kept = "".join(f", '{c}', n.{c}" for c in extra)
    linked = blocks.select("tree", "block", F.explode(F.expr(
        f"transform(nodes, (n, i) -> named_struct('idx', n.idx, 'hash', n.hash, 'path', {_path()}{kept}))"))
        .alias("n"))
    return linked.select(
        "tree", F.lit(step).alias("step"), "n.*", F.col("tree").alias("up_tree"),
        F.lit(step + 1).alias("up_step"), F.col("block").alias("up_idx"),
        F.expr("unhex(array_join(transform(n.path, s -> concat(s.l, s.r)), ''))").alias("siblings"))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id",
             source_col: str = "source", tampered: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) per row.
    ``tampered`` replaces columns before the hash that is folded: the copy of the
    table to verify against the manifest of ``docs``."""
    spark = docs.sparkSession
    store = Store(spark, "merkle")
    changed = tampered or {}
    leaves = store.save(docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("tree"),
        leaf_hash([F.col(c) for c in columns]).alias("hash"),
        leaf_hash([changed.get(c, F.col(c)) for c in columns]).alias("given")), "leaves")
    numbered = position_within(leaves, ["tree"], ["id", "hash", "given"], name="idx") \
        .withColumn("idx", F.col("idx") - 1)
    nodes, step, uppers, bottom = numbered, 0, [], None
    extra = ["id", "given"]
    several = F.col("size") > BLOCK
    sizes = store.save(numbered.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), "sizes")
    most = sizes.agg(F.max("size")).first()[0]
    if most is None:
        return _empty(docs, id_col)
    ends = []
    while True:
        sized = nodes.join(counted_broadcast(sizes), "tree")
        blocks = _linked(sized, several, store, f"blocks-{step}", extra)
        rows = _node_rows(blocks, step, extra)
        if step == 0:
            bottom = rows
        else:
            uppers.append(store.save(rows, f"nodes-{step}"))
        tops = blocks.select("tree", F.col("block").alias("idx"),
                             F.element_at(f"l{LEVELS}", 1).alias("hash"), "several")
        step, extra = step + 1, []
        # Trees of one block are done: this is their subroot.
        ends.append(store.save(tops.where("not several").select(
            "tree", F.lit(step).alias("step"), "hash"), f"subroots-{step}"))
        most = -(-most // BLOCK)
        if most <= 1:
            break
        nodes = store.save(tops.where("several").drop("several"), f"tops-{step}")
        sizes = store.save(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), f"sizes-{step}")
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.unionByName(more)
    top_rows, root, top_step = _top_tree(store, store.save(subroots, "subroots"))
    for rows in uppers:
        top_rows = top_rows.unionByName(rows, True)
    upper = store.save(top_rows.select("tree", "step", "idx", "path", "siblings", "up_tree", "up_step",
                                       "up_idx", "subroot"), "nodes")
    climbed = _climb(store, bottom, upper, top_step)
    return climbed.select(
        F.col("id").alias(id_col), F.col("leaf"), "subroot", F.lit(root).alias("root"),
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"))


def _top_tree(store: Store, subroots: DataFrame) -> tuple[DataFrame, str, int]:
    """Node rows of the subroots and of the tree over them, the root, and its step."""
    nodes = position_within(subroots, [], ["tree"], name="idx").withColumn("idx", F.col("idx") - 1) \
        .select(F.lit(TOP).alias("tree"), "idx", "hash", F.col("tree").alias("own"), F.col("step").alias("own_step"))
    n, step, out, extra = subroots.count(), 0, None, ["own", "own_step"]
    while True:
        blocks = _linked(nodes, F.lit(n > BLOCK), store, f"top-{step}", extra)
        rows = _node_rows(blocks, step, extra)
        # A leaf of this tree is the node that its source's tree ended with.
        out = rows.withColumns({
            "tree": F.col("own"), "step": F.col("own_step"), "idx": F.lit(0).cast("long"),
            "subroot": F.col("hash")}).drop("own", "own_step") if step == 0 else out.unionByName(rows, True)
        tops = blocks.select("tree", F.col("block").alias("idx"), F.element_at(f"l{LEVELS}", 1).alias("hash"))
        n, step, extra = -(-n // BLOCK), step + 1, []
        if n == 1:
            return out, tops.first()["hash"], step
        nodes = tops


def _climb(store: Store, bottom: DataFrame, upper: DataFrame, top_step: int) -> DataFrame:
    """(id, leaf, subroot, folded, proof) at the root, by the recursive query."""
    spark = upper.sparkSession
    leaves = bottom.select("id", F.col("hash").alias("leaf"), F.expr(fold("path", "given")).alias("folded"),
                           F.col("siblings").alias("proof"), "up_tree", "up_step", "up_idx")
    before = spark.conf.get(ROW_LIMIT_CONF, None)
    spark.conf.set(ROW_LIMIT_CONF, "-1")        # a climb has a row per leaf and link
    try:
        climbed = spark.sql(f"""
            WITH RECURSIVE climb(id, leaf, folded, proof, subroot, tree, step, idx) AS (
              SELECT id, leaf, folded, proof, cast(null as string), up_tree, up_step, up_idx FROM {{leaves}}
              UNION ALL
              SELECT c.id, c.leaf, {fold('n.path', 'c.folded')}, concat(c.proof, n.siblings),
                     coalesce(n.subroot, c.subroot), n.up_tree, n.up_step, n.up_idx
              FROM climb c JOIN {{upper}} n ON n.tree = c.tree AND n.step = c.step AND n.idx = c.idx)
            SELECT id, leaf, subroot, folded, proof FROM climb
            WHERE tree = '{TOP}' AND step = {top_step}""", leaves=leaves, upper=counted_broadcast(upper))
        return store.save(climbed, "climbed")
    finally:
        if before is None:
            spark.conf.unset(ROW_LIMIT_CONF)
        else:
            spark.conf.set(ROW_LIMIT_CONF, before)


def _empty(docs: DataFrame, id_col: str) -> DataFrame:
    text = F.lit("")
    return docs.limit(0).select(
        F.col(id_col), text.alias("leaf"), text.alias("subroot"), text.alias("root"),
        text.alias("proof_sha256"), text.alias("folded_root"), F.lit(False).alias("verified"))
