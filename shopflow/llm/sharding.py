"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked there; a row
of rank r among the c rows of its source has the fractional rank (2r+1)/2c.
Sorted by that, the sources interleave in proportion, and cutting the order into
``n_shards`` runs gives shards that all hold the mixture. Law ``rows``: counts
differ by one at most; each source's share of a shard is off by less than two
rows.

Both ranks come from prefix sums over buckets of about ``bucket_rows`` rows plus
a rank inside the bucket, so a source (or a hash range) of any size is spread
over tasks. Only ids, sizes and checksums are shuffled; texts are read once.

Defined results: a null source is a source of its own; null texts have no bytes;
rows equal in every column used are interchangeable; repeated rows each get a
slot. An empty table gives no rows. Equal texts are not kept together: a group
may be larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.store import Store

N_SHARDS = 24
SEED = 42
BUCKET_ROWS = 1_000
#: Bits by which bucket numbers are made coarse for the outer prefix sum.
COARSE_BITS = 12
LAW = "rows"
#: Bytes counted for a row besides its text.
ROW_BYTES = 8


def _prefix(counted: DataFrame, bucket: str, by: list[str]) -> DataFrame:
    """Rows in earlier buckets (of the same ``by`` columns): a running sum over
    4,096 buckets at a time, and one over their totals, so that no task sees more
    than a few rows per million of the table."""
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    fine = counted.withColumn("coarse", F.shiftright(bucket, COARSE_BITS))
    totals = fine.groupBy(*by, "coarse").agg(F.sum("rows").alias("total")).withColumn(
        "skipped", F.coalesce(F.sum("total").over(earlier(by, "coarse")), F.lit(0))).drop("total")
    return fine.withColumn("before", F.coalesce(
        F.sum("rows").over(earlier([*by, "coarse"], bucket)), F.lit(0))) \
        .join(totals, [*by, "coarse"]).withColumn("before", F.col("before") + F.col("skipped")) \
        .drop("coarse", "skipped")


def shard_rows(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, id_col: str = "doc_id",
               source_col: str = "source", text_col: str = "text",
               bucket_rows: int = BUCKET_ROWS, row_col: str | None = None) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot) for every row; slots count from
    0 without gaps in each shard, in the interleaved order. ``row_col``, if given,
    is carried along as ``row``; it has no part in the order."""
    store = Store(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    rows = store.save(docs.select(
        row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32")).withColumn(
        "place", F.xxhash64("id", "text_crc32", "size", F.lit(seed))), "rows")
    total = rows.count()
    bits = max(1, (max(1, total) // bucket_rows).bit_length())
    bucketed = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))) \
        .withColumn("bucket", F.shiftrightunsigned("place", 64 - bits))
    counts = store.save(bucketed.groupBy("source_key", "bucket").agg(
        F.count(F.lit(1)).alias("rows")), "buckets")
    sizes = counts.groupBy("source_key").agg(F.sum("rows").alias("source_rows"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("place", "id", "text_crc32", "size")
    ranked = bucketed.withColumn("inside", F.row_number().over(inside) - 1) \
        .join(_prefix(counts, "bucket", ["source_key"]).join(sizes, "source_key").drop("rows"),
              ["source_key", "bucket"]) \
        .withColumn("share", (2 * (F.col("before") + F.col("inside")) + 1)
                    / (2 * F.col("source_rows")).cast("double")) \
        .select("row", "id", "source", "source_key", "size", "text_crc32", "place", "share",
                F.floor(F.col("share") * (1 << bits)).alias("stretch"))
    ranked = store.save(ranked, "ranked")
    # One row per stretch of the order: the table's rows over bucket_rows.
    stretches = ranked.groupBy("stretch").agg(F.count(F.lit(1)).alias("rows"))
    within = Window.partitionBy("stretch").orderBy("share", "place", "source_key", "id", "text_crc32")
    ordered = ranked.withColumn("within", F.row_number().over(within) - 1) \
        .join(_prefix(stretches, "stretch", []).drop("rows"), "stretch") \
        .withColumn("position", F.col("before") + F.col("within"))
    shard = F.expr(f"(position * {n_shards}) div {max(1, total)}")
    return ordered.withColumn("shard", shard.cast("int")).select(
        F.col("id").alias(id_col), "source", "size", "text_crc32", "shard",
        F.expr(f"position - (shard * {total}L + {n_shards - 1}) div {n_shards}").alias("slot"),
        *(["row"] if row_col else []))


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, seed: int = SEED,
                 id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> None:
    """Writes every column of ``docs`` into folders ``_shard=<n>``, in slot order, with
    a column ``_slot``. Rows are numbered in a written copy, so each finds its own
    place again, however many are alike; the copy is removed."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    store = Store(docs.sparkSession, "write-shards")
    kept = store.save(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    at = {c: f"c{names.index(c)}" for c in (id_col, source_col, text_col)}
    placed = shard_rows(kept, n_shards, seed, at[id_col], at[source_col], at[text_col], row_col="row")
    shard, slot = (_free(c, names) for c in ("_shard", "_slot"))
    out = kept.join(placed.select("row", "shard", "slot"), "row").drop("row") \
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .toDF(*names, shard, slot)
    out.write.partitionBy(shard).parquet(path)
    store.drop(kept)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name
