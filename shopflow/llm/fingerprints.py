"""Order MinHash fingerprints: sketches that are sensitive to edit distance.

Words (runs without blanks) are hashed, every ``k`` of them in a row are a k-mer,
and repeats of a k-mer are numbered, so each occurrence counts. A hash of
(k-mer, number) deals the occurrences into ``bins``; of each bin the ``ell``
smallest are selected, put back into the order in which they stand in the text,
and that tuple is hashed. Two texts agree in a bin only if the same k-mers are
smallest and stand in the same order. Likeness is the number of bins that agree
over the number of bins that either text fills.

All of it is Spark's own array functions, one row at a time: no shuffle. Inner
values are bound by ``_let``, so they are computed once.

Defined results: null texts count as empty; a text with fewer words than k is a
single k-mer, the empty text too, so equal texts have equal fingerprints and
likeness 1. K-mers count as equal when 39 bits of their hash are. Texts of any length are
sketched whole; an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.store import Store
from shopflow.plans.ordinal import position_within

K, ELL, BINS = 3, 2, 64
#: Bits of a position within a text (in steps, for longer texts).
_POS_BITS = 24
#: Rows that are neighbours by id and share a task, about; blocks at most.
BLOCK_ROWS, MOST_BLOCKS = 500, 1 << 16


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _from(array: Column, i: Column) -> Column:
    return F.get(array, i.cast("int"))


def order_minhash(text: Column, k: int = K, ell: int = ELL, bins: int = BINS) -> Column:
    """array<long>: for each filled bin, its number and the hash of its tuple."""
    bin_bits = (bins - 1).bit_length()
    if bins != 1 << bin_bits:
        raise ValueError("bins must be a power of two")
    top = 63 - bin_bits
    pos_mask = (1 << _POS_BITS) - 1

    def kmers(words: Column) -> Column:
        hashed = F.transform(words, lambda w: F.xxhash64(w))
        return _let(hashed, lambda h: F.when(
            F.size(h) < k, F.array(F.xxhash64(text))).otherwise(
            F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda _, i: F.xxhash64(
                *[_from(h, i + j) for j in range(k)]))))

    def placed(h: Column) -> Column:
        # [k-mer: 39 bits][position: 24 bits], smallest first: repeats lie together.
        step = F.shiftright(F.size(h), _POS_BITS) + 1
        return F.sort_array(F.transform(h, lambda x, i: F.shiftleft(
            F.shiftrightunsigned(x, 64 - 39), _POS_BITS).bitwiseOR(
            F.floor(i / step))))

    def numbered(s: Column) -> Column:
        """Number of each occurrence among its k-mer's, in the order of ``s``."""
        same = lambda a, b: F.shiftright(a, _POS_BITS) == F.shiftright(b, _POS_BITS)
        first = F.filter(F.transform(s, lambda x, i: F.when(
            (i == 0) | ~same(x, _from(s, i - 1)), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        return _let(first, lambda f: F.when(
            F.size(f) == F.size(s), F.array_repeat(F.lit(0), F.size(s))).otherwise(
            F.flatten(F.transform(f, lambda a, j: F.sequence(
                F.lit(0), F.coalesce(_from(f, j + 1), F.size(s)) - a - 1)))))

    def dealt(s: Column) -> Column:
        # [bin][hash][position], smallest first.
        return F.sort_array(F.zip_with(s, numbered(s), lambda x, n: F.shiftleft(F.shiftrightunsigned(
            F.xxhash64(F.shiftright(x, _POS_BITS), n), 1 + _POS_BITS), _POS_BITS).bitwiseOR(
            x.bitwiseAND(F.lit(pos_mask)))))

    def selected(d: Column) -> Column:
        return F.filter(d, lambda x, i: (i < ell) | (
            F.shiftright(x, top) != F.shiftright(_from(d, i - ell), top)))

    def tuples(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when(
            (i == 0) | (F.shiftright(x, top) != F.shiftright(_from(s, i - 1), top)), i)
            .otherwise(F.lit(-1))), lambda i: i >= 0)
        def one(f, a, j):
            own = F.slice(s, a + 1, F.coalesce(_from(f, j + 1), F.size(s)) - a)
            # Text order: the position leads, then is left out of the hash.
            in_text = F.sort_array(F.transform(own, lambda x: F.shiftleft(
                x.bitwiseAND(F.lit(pos_mask)), 63 - _POS_BITS).bitwiseOR(
                F.shiftright(x, _POS_BITS))))
            seen = F.transform(in_text, lambda x: x.bitwiseAND(F.lit((1 << (63 - _POS_BITS)) - 1)))
            number = F.shiftright(_from(s, a), top)
            return F.shiftleft(number, 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(seen), 32))
        return _let(first, lambda f: F.transform(f, lambda a, j: one(f, a, j)))

    return _let(F.split(text, " "), lambda w: _let(kmers(w), lambda h: _let(
        placed(h), lambda s: _let(dealt(s), lambda d: _let(selected(d), tuples)))))


def as_text(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.lower(F.hex(x))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Bins that agree over bins that either fills."""
    agree = F.size(F.array_intersect(a, b))
    number = lambda p: F.transform(p, lambda x: F.shiftright(x, 32))
    return agree / F.size(F.array_union(number(a), number(b))).cast("double")


def _bounds(ids: DataFrame, block_rows: int) -> tuple[Column, int]:
    """(ascending ids that begin blocks, how many): every ``block_rows``-th id, or every
    so many that there are MOST_BLOCKS of them."""
    known = Store(ids.sparkSession, "neighbours").save(ids.where("id is not null"), "ids")
    step = max(block_rows, -(-known.count() // MOST_BLOCKS))
    placed = position_within(known, [], ["id"], name="place").where((F.col("place") - 1) % step == 0)
    found = [r["id"] for r in placed.orderBy("place").select(F.col("id").cast("string").alias("id")).collect()]
    kind = ids.schema["id"].dataType.simpleString()
    return F.from_json(F.lit(json.dumps(found)), "array<string>").cast(f"array<{kind}>"), len(found)


def _block(bounds: Column, n: int, null_blocks: int) -> Column:
    """How many bounds are not above the id, by binary search. Null ids, which come last,
    are dealt over blocks below 0 by ranges of their text's hash."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]) if n else F.array(F.lit(1))
    found = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(
        (lo + step <= n) & (F.get(bounds, lo + step - 1) <= F.col("id")), lo + step).otherwise(lo))
    part = F.shiftrightunsigned(F.col("text_key").bitwiseXOR(F.lit(-1 << 63)), 33)     # 31 bits, in order
    null_block = (F.lit(-1) - F.shiftright(part * null_blocks, 31)).cast("int")
    return F.when(F.col("id").isNull(), null_block).otherwise(found)


def with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, text, print, next_text, next_print): each row with the next one by
    descending id, then by hash of the text; the first follows the last.

    Ids (of any ordered type) are numbered, and cut into blocks of neighbours at ids found
    that way, so outlying or clustered ids make no large block; the first row of a block
    is also put at the end of the block before. Null ids come last, in blocks of
    their own. Each text is shuffled once. Rows of one id share a block.
    """
    rows = docs.select(F.col("id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds, n = _bounds(rows.select("id"), block_rows)
    nulls = rows.where("id is null").count()
    rows = rows.withColumn("text_key", F.xxhash64("text")) \
        .withColumn("block", _block(bounds, n, max(1, min(MOST_BLOCKS, nulls // block_rows))))
    # A row per block, of which there are at most twice MOST_BLOCKS.
    heads = rows.groupBy("block").agg(F.max(F.struct(
        "id", F.bitwise_not("text_key").alias("not_key"))).alias("h"))
    order = Window.orderBy(F.desc("block"))
    heads = heads.withColumn("last", F.min("block").over(Window.partitionBy())) \
        .withColumn("target", F.coalesce(F.lag("block").over(order), F.col("last"))) \
        .select("target", F.col("h.id").alias("head_id"), F.bitwise_not("h.not_key").alias("head_key"))
    copies = rows.join(F.broadcast(heads), rows["id"].eqNullSafe(heads["head_id"])
                       & (F.col("text_key") == F.col("head_key"))) \
        .dropDuplicates(["target"]) \
        .select("id", "text", F.col("target").alias("block"), "text_key", F.lit(True).alias("copy"))
    both = rows.withColumn("copy", F.lit(False)).unionByName(copies) \
        .withColumn("print", order_minhash(F.col("text")))
    along = Window.partitionBy("block").orderBy("copy", F.desc_nulls_last("id"), "text_key")
    return both.withColumn("next_text", F.lead("text").over(along)) \
        .withColumn("next_print", F.lead("print").over(along)).where(~F.col("copy")) \
        .select("id", "text", "print", "next_text", "next_print")
