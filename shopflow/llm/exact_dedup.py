"""Exact duplicates: one row of each group of equal texts stays.

Texts are equal when they are identical after each run of blanks (space, tab to
carriage return) has become one space. Rows are grouped by the first 128 bits of
the SHA-256 of that text; the row with the smallest id stays. Only ids and
hashes are shuffled for that. Texts move for one purpose: inside every hash
group of several rows, the bytes of each member are compared with those of one
member. Rows whose bytes differ (a hash collision) are grouped by the text itself.

A group may hold a third of all rows. Its hash is pre-aggregated before the
shuffle; for the comparison its members are dealt over ``n / SALT_ROWS`` salts,
each of which gets a copy of the one text, so no task compares more than about
``SALT_ROWS`` members of a group.

Defined results: a null text counts as empty, and empty texts are equal to each
other. Null ids come after all others; among rows of equal id, the one with the
smaller hash of the raw text stays, and of rows alike in both any one, so that
exactly one row of a group stays. Very long texts are hashed and compared whole.
An empty table gives no rows. Ids may be of any ordered type; other columns of
the input play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.llm.store import Store

BLANKS = r"[\x20\x09-\x0D]+"
#: Members of one group that meet in one task of the comparison, about.
SALT_ROWS = 256
#: Groups (about 100 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_GROUPS = 250_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def half_sha256(text: Column, digest: Column) -> Column:
    """The first 128 bits of the text's SHA-256 (``digest``, hex)."""
    return F.unhex(F.substring(digest, 1, 32))


def _few(groups: DataFrame, n: int) -> DataFrame:
    return F.broadcast(groups) if n <= BROADCAST_GROUPS else groups


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     content_hash: Callable[[Column, Column], Column] = half_sha256) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).
    ``content_hash`` makes the grouping key from the normalised text and its
    SHA-256 in hex; any deterministic one gives the same result."""
    store = Store(docs.sparkSession, "exact-dedup")
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"),
                        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("raw_key")) \
        .withColumn("digest", F.sha2("norm", 256)) \
        .withColumn("hash", content_hash(F.col("norm"), F.col("digest")))
    # Numbered in what is written: of rows alike in id and text, the number tells one.
    rows = store.save(texts.select("id", "hash", "digest", "raw_key",
                                   F.monotonically_increasing_id().alias("row")), "rows")
    groups = store.save(_grouped(rows, ["hash"]).where("n > 1"), "groups")
    n_groups = groups.count()
    members = store.save(
        texts.join(_few(groups.select("hash", F.ceil(F.col("n") / SALT_ROWS).alias("salts")), n_groups),
                   "hash")
        .select("hash", "id", "raw_key", "digest", "norm", "salts",
                F.monotonically_increasing_id().alias("row")), "members")
    collided = store.save(_unequal_hashes(members, n_groups), "collided")
    n_collided = collided.count()
    result = _decided(rows, groups, n_groups)
    if n_collided:
        # Exact, by the bytes: hashes that hold several texts.
        apart = members.join(_few(collided, n_collided), "hash")
        exact = store.save(apart, "apart")
        by_text = store.save(_grouped(exact, ["hash", "norm"]), "texts")
        clean = rows.join(_few(collided, n_collided), "hash", "left_anti")
        result = _decided(clean, groups, n_groups).unionByName(
            _decided(exact, by_text, BROADCAST_GROUPS + 1, ["hash", "norm"]))
    else:
        store.drop(members)
    return result.withColumnRenamed("id", id_col)


def _grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    """Size and first row of each group; partial sums before the shuffle."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "raw_key", "row")).alias("first")) \
        .select(*by, "n", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"))


def _unequal_hashes(members: DataFrame, n_groups: int) -> DataFrame:
    """Hashes among whose members' texts not all bytes agree."""
    salted = members.withColumn("salt", F.pmod(F.col("row"), F.col("salts")).cast("int"))
    one = members.groupBy("hash").agg(F.min("row").alias("row"))
    models = members.join(_few(one, n_groups), ["hash", "row"]).select(
        "hash", F.col("norm").alias("model"),
        F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"))
    compared = salted.select("hash", "salt", "norm").join(models.hint("merge"), ["hash", "salt"])
    return compared.where(F.col("norm").cast("binary") != F.col("model").cast("binary")) \
        .select("hash").distinct()


def _decided(rows: DataFrame, groups: DataFrame, n_groups: int,
             by: list[str] | None = None) -> DataFrame:
    """Each row with its group's decision; a row without a group is a group of its own."""
    found = rows.join(_few(groups, n_groups), by or ["hash"], "left")
    alone = F.col("n").isNull()
    return found.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("digest").alias("text_sha256"))
