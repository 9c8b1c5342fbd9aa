"""Exact 1-based positions inside groups without a single-task window.

``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task; a group
holding a third of all rows then runs on one core. Here the rows are
range-partitioned on (group, order) instead, so a hot group is spread over many
partitions, and the position is

    rows of the group in earlier partitions  +  index inside this partition.

The per-(group, partition) counts form a small frame (at most partitions +
groups rows); its running sum is a window over that small frame only, and it is
joined back (broadcast by the size check when it fits).

``order_cols`` must make the order total inside a group (add a unique id as
the last column).

The range bounds are sampled anew by every execution of a range exchange, so
partition ids of two branches (or of a recomputation after a lost executor)
need not agree. The numbered frame is therefore checkpointed once to the shared
checkpoint folder and both the counts and the join read that copy; this also
cuts the lineage of the rows being numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.plans.joins import counted_broadcast
from shopflow.sources.storage import shared_dir

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id << 33 | row index


def _num_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, keys: list[str], num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``keys`` and sort inside each partition."""
    n = num_partitions or _num_partitions(df)
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def position_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                    name: str = "position", num_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``name``: the 1-based position of each row inside its group
    (``group_cols``; none = the whole frame) in ``order_cols`` order, equal to
    ``row_number()`` over that window but without a task per group."""
    keys = [*group_cols, *order_cols]
    r = (ranged(df, keys, num_partitions)
         .withColumn("_mid", F.monotonically_increasing_id())
         .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
         .withColumn("_loc", F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)))
    shared_dir(df.sparkSession)
    r = r.checkpoint(eager=True)
    stats = r.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_n"),
                                                F.min("_loc").alias("_first"))
    earlier = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    stats = stats.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols],
                         F.col("_pid").alias("_g_pid"), "_before", "_first")
    # Without groups the frame has one row per partition: bounded by
    # construction. With groups its bytes are measured first (at most partitions
    # + groups rows); computing it again from the checkpointed frame is cheap
    # and gives the same.
    stats = counted_broadcast(stats) if group_cols else F.broadcast(stats)
    cond = F.col("_pid") == F.col("_g_pid")
    for c in group_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = r.join(stats, cond)
    out = out.withColumn(name, F.col("_before") + F.col("_loc") - F.col("_first") + 1)
    return out.drop("_mid", "_pid", "_loc", "_before", "_first", "_g_pid",
                    *[f"_g_{c}" for c in group_cols])


def blocked(df: DataFrame, position: str, block_rows: int, carry: int) -> DataFrame:
    """Assign rows to blocks of ``block_rows`` consecutive positions and copy the
    last ``carry`` rows of each block into the next one (``_carry`` = True).

    A window over (group, block) with a frame of at most ``carry`` preceding
    rows then sees exactly the rows it would see over the whole group, while no
    task holds more than ``block_rows + carry`` rows of one group.
    """
    if carry >= block_rows:
        raise ValueError("carry must be smaller than the block")
    idx = F.col(position) - 1
    block = F.floor(idx / block_rows).cast("long")
    tail = (idx % block_rows) >= (block_rows - carry)
    return df.withColumn("_blocks", F.when(tail, F.array(
        F.struct(block.alias("b"), F.lit(False).alias("c")),
        F.struct((block + 1).alias("b"), F.lit(True).alias("c")))).otherwise(
        F.array(F.struct(block.alias("b"), F.lit(False).alias("c"))))) \
        .withColumn("_blk", F.explode("_blocks")) \
        .withColumn("_block", F.col("_blk.b")).withColumn("_carry", F.col("_blk.c")) \
        .drop("_blocks", "_blk")
