"""Stock checks and order acceptance as joins over whole request tables.

The shop asks the inventory once per request; here every request of a batch is
checked by one join. Stock is tested by **equality** on (sku, quantity), as the
shop's repository does, and existence only is asked, so duplicate stock rows
never multiply orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopflow.functions import constants as C
from shopflow.functions.money import line_total
from shopflow.functions.text import uuid_from_key
from shopflow.plans.joins import broadcast_max_bytes, counted_broadcast, side_bytes
from shopflow.plans.ordinal import position_within
from shopflow.sources import fixtures as fx
from shopflow.sources.storage import shared_dir
from shopflow.sources.tables import read_table

STOCK_KEYS = ["sku_code", "quantity"]

ACCEPTED = "ACCEPTED"
OUT_OF_STOCK = "OUT_OF_STOCK"
INVALID = "INVALID"


def stock_predicate(sku_code: str, quantity: int) -> Column:
    """sku equal and quantity equal (not "at least")."""
    return (F.col("sku_code") == F.lit(sku_code)) & (F.col("quantity") == F.lit(quantity))


def stock_keys(inventory: DataFrame) -> DataFrame:
    """Distinct (sku, quantity) pairs held. The partial aggregate collapses a
    hot or duplicated pair map-side before anything is shuffled. Broadcast
    when the inventory's row count (a bound of the pairs) is within the limit."""
    keys = inventory.select(*STOCK_KEYS).where(
        F.col("sku_code").isNotNull() & F.col("quantity").isNotNull()).distinct()
    return counted_broadcast(keys, bound_from=inventory)


def in_stock(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """Requests whose (sku, quantity) is held. Semi join: broadcast when the
    stock side passes the size check, else shuffled with AQE skew splitting."""
    return requests.join(stock_keys(inventory), STOCK_KEYS, "left_semi")


#: Stock pairs that share a 64-bit word of the filter, and a word's row in a hash relation.
PAIRS_PER_WORD, WORD_BYTES = 8, 48


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64(*STOCK_KEYS), F.lit(words).cast("long"))


def _marks() -> Column:
    """Two of a word's bits."""
    one, h = F.lit(1).cast("long"), F.xxhash64(F.lit(1), *STOCK_KEYS)
    bit = lambda places: F.call_function("shiftleft", one, places.bitwiseAND(63).cast("int"))
    return bit(h).bitwiseOR(bit(F.shiftright(h, 6)))


def maybe_in_stock(requests: DataFrame, inventory: DataFrame, also: Column) -> DataFrame:
    """Requests whose (sku, quantity) may be held (all that are, and about one in twenty
    others), and those with ``also``: what is left to join with a stock too large to
    broadcast. A broadcast filter of a byte a pair tells; where the stock itself is small
    enough, or the filter too large, the requests stay as they are."""
    most, kinds = broadcast_max_bytes(requests), [inventory.schema[k].dataType for k in STOCK_KEYS]
    if side_bytes(inventory) <= most or kinds != [requests.schema[k].dataType for k in STOCK_KEYS]:
        return requests                                      # (equal values of two types hash apart)
    words = 1 + inventory.count() // PAIRS_PER_WORD
    if words * WORD_BYTES > most:
        return requests
    held = inventory.select(*STOCK_KEYS).where(F.col("sku_code").isNotNull() & F.col("quantity").isNotNull()) \
        .select(_word(words).alias("_word"), _marks().alias("_marks")) \
        .groupBy("_word").agg(F.bit_or("_marks").alias("_held"))
    asked = requests.withColumn("_word", _word(words)).withColumn("_marks", _marks())
    met = asked.join(F.broadcast(held), "_word", "left")
    return met.where(also | (F.col("_held").bitwiseAND(F.col("_marks")) == F.col("_marks"))) \
        .drop("_word", "_marks", "_held")


def out_of_stock(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """Anti join (null keys never match, unlike NOT IN)."""
    return requests.join(stock_keys(inventory), STOCK_KEYS, "left_anti")


def with_stock_flag(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """The boolean stock answer per request (left join to distinct keys)."""
    keys = stock_keys(inventory).withColumn("_held", F.lit(True))
    return (requests.join(keys, STOCK_KEYS, "left")
            .withColumn("in_stock", F.coalesce(F.col("_held"), F.lit(False))).drop("_held"))


def stock_intervals(history: DataFrame) -> DataFrame:
    """(sku_code, quantity, held_from, held_to): when each pair was held, from whole
    snapshots (snapshot, valid_from, sku_code, quantity). A pair is held from a snapshot that
    has it to the next snapshot that lacks it; ``held_to`` is null while it still is.
    Snapshots that follow each other make one interval, so rows count changes of stock."""
    times = history.groupBy("snapshot").agg(F.min("valid_from").alias("valid_from"))
    # One row per snapshot: a window over them all is a window over few rows.
    order = Window.orderBy("valid_from", "snapshot")
    times = times.select("snapshot", F.row_number().over(order).alias("place"), "valid_from",
                         F.lead("valid_from").over(order).alias("valid_to"))
    # Spread by pair first: a whole history read from a small file would else be made
    # distinct by the one task that reads it. All that follows stays in these partitions,
    # whose number is given, as a few MB of them may be many pairs.
    parts = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = history.where(F.col("sku_code").isNotNull() & F.col("quantity").isNotNull()) \
        .select("snapshot", *STOCK_KEYS).repartition(parts, *STOCK_KEYS).distinct() \
        .join(counted_broadcast(times), "snapshot")
    # Consecutive places have the same distance to their rank within the pair.
    rank = F.row_number().over(Window.partitionBy(*STOCK_KEYS).orderBy("place"))
    return pairs.withColumn("_run", F.col("place") - rank).groupBy(*STOCK_KEYS, "_run").agg(
        F.min("valid_from").alias("held_from"), F.max_by("valid_to", "place").alias("held_to")).drop("_run")


def stock_flag_as_of(requests: DataFrame, history: DataFrame, at: str = "requested_at") -> DataFrame:
    """``in_stock`` by the stock as it was at each request's time ``at``: an as-of
    join, written as an equi-join on the stock keys whose condition picks the interval.
    A pair has disjoint intervals, so a request meets one at most. A request before
    the first snapshot, or without time, SKU or quantity, is not in stock."""
    held = counted_broadcast(stock_intervals(history).withColumn("_held", F.lit(True)))
    r, h = requests.alias("r"), held.alias("h")
    on = ((F.col("r.sku_code") == F.col("h.sku_code")) & (F.col("r.quantity") == F.col("h.quantity"))
          & (F.col(f"r.{at}") >= F.col("h.held_from"))
          & (F.col("h.held_to").isNull() | (F.col(f"r.{at}") < F.col("h.held_to"))))
    return r.join(h, on, "left").select("r.*", F.coalesce("h._held", F.lit(False)).alias("in_stock"))


def stock_fallback(requests: DataFrame, inventory: DataFrame, unanswered: Column) -> DataFrame:
    """P10: a lookup without an answer counts as not in stock, as the client's
    fallback does; ``lookup_failed`` keeps outage apart from out-of-stock. One
    pass: the stock join gives the answers, ``unanswered`` tells which calls
    never got theirs."""
    failed = F.coalesce(unanswered, F.lit(False))
    return (with_stock_flag(requests.withColumn("lookup_failed", failed), inventory)
            .withColumn("in_stock", F.col("in_stock") & ~F.col("lookup_failed")))


def valid_for_order(c_user: str = "user_details") -> Column:
    """the fields the order and its event dereference must be present, the
    key that the order number comes from included."""
    return (F.col("request_id").isNotNull() & F.col("price").isNotNull() & F.col(c_user).isNotNull()
            & F.col(f"{c_user}.email").isNotNull() & F.col(f"{c_user}.first_name").isNotNull()
            & F.col(f"{c_user}.last_name").isNotNull())


def with_outcome(flagged: DataFrame) -> DataFrame:
    """stock first, then the contract; rejects keep a reason."""
    return flagged.withColumn(
        "outcome",
        F.when(~F.col("in_stock"), F.lit(OUT_OF_STOCK))
         .when(~valid_for_order(), F.lit(INVALID)).otherwise(F.lit(ACCEPTED)))


def request_outcomes(lines: DataFrame, inventory: DataFrame, spark: SparkSession,
                     sf_dir: str) -> DataFrame:
    """F02/F03 over whole request tables, shuffling only what needs user data.

    The stock answer comes from the (broadcast or shuffled) join to distinct
    stock keys; only in-stock lines are joined to orders and customers for the
    contract check, the rest is OUT_OF_STOCK as it stands. Columns: the line
    columns + in_stock, user_details (null when out of stock), outcome.
    """
    flagged = with_stock_flag(lines, inventory)
    held = fx.attach_users(flagged.where(F.col("in_stock")), spark, sf_dir) \
        .withColumn("in_stock", F.lit(True))
    rest = flagged.where(~F.col("in_stock")).select(
        "request_id", "sku_code", "price", "quantity",
        F.lit(None).cast(held.schema["user_details"].dataType).alias("user_details"),
        F.lit(None).cast("timestamp_ntz").alias("requested_at"), "order_key", "in_stock")
    return with_outcome(held.unionByName(rest))


def order_response(outcomes: DataFrame) -> DataFrame:
    """201 + fixed text, or the error text carrying the SKU (no blank
    between SKU and "is", as the shop writes it)."""
    ok = F.col("outcome") == ACCEPTED
    return outcomes.select(
        "request_id",
        F.when(ok, F.lit(201)).otherwise(F.lit(500)).alias("status"),
        F.when(ok, F.lit(C.ORDER_PLACED_TEXT))
         .when(F.col("outcome") == OUT_OF_STOCK,
               F.concat(F.lit(C.OUT_OF_STOCK_PREFIX), F.col("sku_code"), F.lit(C.OUT_OF_STOCK_SUFFIX)))
         .otherwise(F.lit(C.SERVER_ERROR_TEXT)).alias("body"))


def accepted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line requests in stock; filtered before any customer column is joined
    and before the request columns are built."""
    keys = fx.line_keys(read_table(spark, sf_dir, "lineitem"))
    return fx.finish_line_requests(in_stock(keys, fx.inventory(spark, sf_dir)))


def accepted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that become orders: in stock and complete."""
    reqs = fx.attach_users(accepted_lines(spark, sf_dir), spark, sf_dir)
    return reqs.where(valid_for_order())


def order_number(request_id: Column) -> Column:
    """UUID-shaped order number derived from the request key."""
    return uuid_from_key(request_id)


def build_orders(accepted: DataFrame, as_of: Column | None = None,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """The order row. ``price`` is the line total; ``order_date`` is
    one value per batch (default: the local time of the batch). ``keep`` names
    columns passed through."""
    stamp = as_of if as_of is not None else F.localtimestamp()
    return accepted.select(
        order_number(F.col("request_id")).alias("order_number"),
        "request_id", "sku_code",
        line_total(F.col("price"), F.col("quantity")).alias("price"),
        "quantity",
        stamp.alias("order_date"), *keep)


def build_events(accepted: DataFrame) -> DataFrame:
    """The order-placed event, the user struct flattened."""
    return accepted.select(
        order_number(F.col("request_id")).alias("order_number"),
        F.col("user_details.email").alias("email"),
        F.col("user_details.first_name").alias("first_name"),
        F.col("user_details.last_name").alias("last_name"))


def surrogate_ids(orders: DataFrame, key: str = "order_number", name: str = "id",
                  after: int = 0, num_partitions: int | None = None) -> DataFrame:
    """Ids ``after`` + 1, 2, ... in key order, without a single-partition
    window. The orders are materialised first: numbering samples its input, and
    the acceptance join should not run twice for that."""
    shared_dir(orders.sparkSession)
    return position_within(orders.checkpoint(eager=True), [], [key], name=name, num_partitions=num_partitions) \
        .withColumn(name, F.col(name) + after)


def last_id(stored: DataFrame | None, name: str = "id") -> int:
    """The largest id stored so far; 0 where nothing is."""
    return 0 if stored is None else stored.agg(F.max(name).alias("m")).first()["m"] or 0


def unique_order_numbers(orders: DataFrame) -> DataFrame:
    """One row per order number; the smallest request id wins, the number
    of copies is kept. Partial aggregation absorbs a hot number map-side."""
    return orders.groupBy("order_number").agg(
        F.min("request_id").alias("request_id"), F.count(F.lit(1)).alias("copies"))


def new_order_numbers(batch: DataFrame, history: DataFrame) -> DataFrame:
    """A03 against history: drop numbers already stored. The history is only
    scanned (one column) against the batch's numbers; what both hold is small."""
    asked = counted_broadcast(batch.select("order_number").distinct())
    known = history.select("order_number").join(asked, "order_number", "left_semi").distinct()
    return batch.join(known, "order_number", "left_anti")
