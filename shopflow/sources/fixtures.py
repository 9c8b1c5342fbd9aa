"""The shop's record types, derived from the source tables.

Each fixture exists twice: as a lazy DataFrame function ``(spark, sf_dir) ->
DataFrame`` and as SQL text (a CTE body) for the DuckDB oracle. Keep the two in
step: the oracle compares them value by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.functions import constants as C
from shopflow.functions.text import uuid_from_key
from shopflow.plans.joins import counted_broadcast
from shopflow.sources.tables import read_table

MONEY = "decimal(18,2)"

# Rules that make the feed as uneven as a real one, by order key (or event id):
NO_PRICE, NO_USER = 53, 59     # multiples: a request without price / user
BROKEN_BODY = 97               # multiples: the body was cut off
UNANSWERED = 29                # multiples: the stock lookup gave no answer
TWICE = 17                     # multiples: the request was delivered twice
STACK_TRACE, BAD_STAMP = 101, 103   # multiples of the event id: odd log lines
CUT = 7                        # characters that a cut-off body lacks


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


# ---------------------------------------------------------------- catalogue --

def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("description"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
    )


PRODUCTS_SQL = f"""
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
       p_brand || ' ' || p_type AS description,
       CAST(p_retailprice AS DECIMAL(18,2)) AS price
FROM part"""


def product_requests_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product creation requests: a key beside the JSON body, one per catalogue row."""
    return products(spark, sf_dir).select(
        F.col("id").alias("request_id"),
        F.to_json(F.struct("name", "description", "price")).alias("value"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("sku_"), F.col("p_partkey").cast("string")).alias("sku_code"),
        F.col("p_size").alias("quantity"),
    )


INVENTORY_SQL = """
SELECT p_partkey AS id, 'sku_' || CAST(p_partkey AS VARCHAR) AS sku_code,
       p_size AS quantity
FROM part"""


#: Years at whose start the stock is counted anew (orders run from 1995 to 2001).
STOCK_YEARS = range(1996, 2001)


def stock_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly snapshots of the whole stock: of three parts, one keeps its quantity, one
    goes up by one every year and one by two (from 50 on, again from 1)."""
    part = read_table(spark, sf_dir, "part")
    counted = part.select(
        F.concat(F.lit("sku_"), F.col("p_partkey").cast("string")).alias("sku_code"), "p_size", "p_partkey",
        F.explode(F.array(*[F.lit(y) for y in STOCK_YEARS])).alias("year"))
    first = STOCK_YEARS[0]
    return counted.select(
        (F.col("year") - first).cast("int").alias("snapshot"),
        F.make_timestamp_ntz(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("valid_from"),
        "sku_code", ((F.col("p_size") - 1 + (F.col("year") - first) * (F.col("p_partkey") % 3)) % 50 + 1)
        .cast("int").alias("quantity"))


STOCK_HISTORY_SQL = f"""
SELECT (y - {STOCK_YEARS[0]})::INT AS snapshot, make_timestamp(y, 1, 1, 0, 0, 0) AS valid_from,
       'sku_' || CAST(p_partkey AS VARCHAR) AS sku_code,
       ((p_size - 1 + (y - {STOCK_YEARS[0]}) * (p_partkey % 3)) % 50 + 1)::INT AS quantity
FROM part, range({STOCK_YEARS[0]}, {STOCK_YEARS[-1] + 1}) AS years(y)"""


# ----------------------------------------------------------------- requests --

def line_keys(lineitem: DataFrame, *keep: str) -> DataFrame:
    """The stock-check keys of a line plus the raw columns the request needs;
    the remaining request columns are built by ``finish_line_requests`` (after
    a selective join, so only surviving rows pay for the string building)."""
    return lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        F.concat(F.lit("sku_"), F.col("l_partkey").cast("string")).alias("sku_code"),
        F.col("l_quantity").cast("int").alias("quantity"), *keep,
    )


def finish_line_requests(keys: DataFrame, *keep: str) -> DataFrame:
    return keys.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
                    ).alias("request_id"),
        "sku_code",
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        "quantity",
        F.col("l_orderkey").alias("order_key"), *keep,
    )


def line_requests(lineitem: DataFrame, *keep: str) -> DataFrame:
    """The per-line part of an order request (no customer columns), and columns passed through."""
    return finish_line_requests(line_keys(lineitem, *keep), *keep)


LINE_REQUESTS_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' ||
       CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS request_id,
       'sku_' || CAST(l_partkey AS VARCHAR) AS sku_code,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
       CAST(l_quantity AS INTEGER) AS quantity,
       l_orderkey AS order_key
FROM lineitem"""


def _customers_of(keyed: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = counted_broadcast(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    return keyed.join(customer, keyed.o_custkey == customer.c_custkey, "left").drop("o_custkey")


def _user_details() -> Column:
    """The user struct of a row with its customer's columns; null without a customer."""
    first = F.substring_index("c_name", "#", 1)
    last = F.substring_index("c_name", "#", -1)
    return F.when(F.col("c_custkey").isNotNull(), F.struct(
        F.lower(F.concat(first, F.lit("."), last, F.lit("@example.com"))).alias("email"),
        first.alias("first_name"), last.alias("last_name")))


def _request_columns(joined: DataFrame, *extra: str) -> DataFrame:
    """The request record of lines that were joined to their order and customer."""
    return joined.select(
        "request_id", "sku_code",
        F.when(F.col("order_key") % NO_PRICE != 0, F.col("price")).alias("price"), "quantity",
        F.when(F.col("order_key") % NO_USER != 0, _user_details()).alias("user_details"),
        F.col("o_orderdate").alias("requested_at"), "order_key", *extra)


ORDER_USERS_SQL = """
SELECT o_orderkey AS order_key, o_orderdate AS requested_at,
       lower(split_part(c_name, '#', 1) || '.' || split_part(c_name, '#', 2) || '@example.com') AS email,
       split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name
FROM orders JOIN customer ON o_custkey = c_custkey"""


def attach_users(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line requests + user details struct (the order request record).

    Lines are joined to orders on the order key first and only then to the
    customer, so orders are shuffled once (by order key) and the customer join
    sees just the requested rows. A line without a known order or customer
    keeps a null struct, which the contract check rejects.
    """
    orders = counted_broadcast(
        read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    keyed = lines.join(orders, lines.order_key == orders.o_orderkey, "left").drop("o_orderkey")
    extra = [c for c in lines.columns if c not in
             ("request_id", "sku_code", "price", "quantity", "order_key")]
    return _request_columns(_customers_of(keyed, spark, sf_dir), *extra)


LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")


def _lines_of(orders: DataFrame, spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Every line with the columns ``keep`` of its order. Lines are shuffled once, as the
    table has them; the request's texts are built behind the join."""
    lines = read_table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")
    return line_requests(joined, *keep)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request record of every line. As all lines are asked for, orders meet their
    customers first: of two shuffles, the one of the many lines is left out."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    users = counted_broadcast(_customers_of(orders, spark, sf_dir), at_least=orders)
    return _request_columns(_lines_of(users, spark, sf_dir, "o_orderdate", "c_custkey", "c_name"))


def dated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, sku_code, quantity, requested_at) of every request."""
    orders = counted_broadcast(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    return _lines_of(orders, spark, sf_dir, "o_orderdate").select(
        "request_id", "sku_code", "quantity", F.col("o_orderdate").alias("requested_at"))


DATED_REQUESTS_SQL = f"""
SELECT request_id, sku_code, quantity, o_orderdate AS requested_at
FROM ({LINE_REQUESTS_SQL}) l LEFT JOIN orders ON l.order_key = o_orderkey"""


def _known_user(column: str) -> str:
    return f"CASE WHEN l.order_key % {NO_USER} <> 0 THEN u.{column} END AS {column}"


REQUESTS_FLAT_SQL = f"""
SELECT l.request_id, l.sku_code, CASE WHEN l.order_key % {NO_PRICE} <> 0 THEN l.price END AS price,
       l.quantity, {_known_user('email')}, {_known_user('first_name')}, {_known_user('last_name')},
       u.requested_at, l.order_key
FROM ({LINE_REQUESTS_SQL}) l JOIN ({ORDER_USERS_SQL}) u ON l.order_key = u.order_key"""


def requests_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order requests as they arrive: a key beside the JSON body, which holds the
    record's own fields only; some bodies are cut off."""
    r = requests(spark, sf_dir)
    body = F.to_json(F.struct(
        F.col("sku_code").alias("skuCode"), "price", "quantity",
        F.when(F.col("user_details").isNotNull(), F.struct(
            F.col("user_details.email").alias("email"),
            F.col("user_details.first_name").alias("firstName"),
            F.col("user_details.last_name").alias("lastName"))).alias("userDetails")))
    return r.select("request_id", "order_key", body.alias("body")).select(
        "request_id", F.when(F.col("order_key") % BROKEN_BODY == 0,
                             F.expr(f"substring(body, 1, length(body) - {CUT})"))
        .otherwise(F.col("body")).alias("value"))


# ----------------------------------------------------------------- calls ----

def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_from_events(read_table(spark, sf_dir, "events"))


def calls_from_events(ev: DataFrame) -> DataFrame:
    """Call outcomes per instance (works on batch and streaming frames)."""
    return ev.select(
        F.concat(F.lit("inst_"), (F.col("user_id") % 5).cast("string")).alias("instance"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("target"),
        "event_id", "ts",
        (F.col("event_type") == "error").alias("error"),
        (F.col("value") / 100).alias("duration_s"),
    )


CALLS_SQL = """
SELECT 'inst_' || CAST(user_id % 5 AS VARCHAR) AS instance,
       'svc-' || CAST(user_id % 4 AS VARCHAR) AS target,
       event_id, ts, event_type = 'error' AS error, value / 100 AS duration_s
FROM events"""


def targets(spark: SparkSession) -> DataFrame:
    """Scrape targets: a fixed five-row dimension."""
    return spark.createDataFrame(C.TARGETS, "target string, application string")


TARGETS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{a}')" for t, a in C.TARGETS) + ") AS t(target, application)"


# ------------------------------------------------------------- access log --

# fixed values: event type -> (method, path) of the request it stands for
ACCESS_MAP = [
    ("purchase", "POST", "/api/order"),
    ("view", "GET", "/api/inventory"),
    ("click", "GET", "/api/product"),
    ("signup", "GET", "/aggregate/order-service/v3/api-docs"),
    ("error", "GET", "/unknown"),
]


def _case(col: Column, pairs: list[tuple[str, str]]) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr


def _case_sql(col: str, pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in pairs) + " END"


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    return ev.select(
        "event_id", "ts",
        _case(et, [(k, m) for k, m, _ in ACCESS_MAP]).alias("method"),
        _case(et, [(k, p) for k, _, p in ACCESS_MAP]).alias("path"),
        (F.col("value") < 200).alias("ok"),
        F.lit(200).alias("status"),
    )


ACCESS_LOG_SQL = f"""
SELECT event_id, ts,
       {_case_sql('event_type', [(k, m) for k, m, _ in ACCESS_MAP])} AS method,
       {_case_sql('event_type', [(k, p) for k, _, p in ACCESS_MAP])} AS path,
       value < 200 AS ok, 200 AS status
FROM events"""


def routes(spark: SparkSession) -> DataFrame:
    """The gateway's seven routes: a fixed dimension."""
    return spark.createDataFrame(
        C.ROUTES, "route_id string, route_path string, route_method string, target_uri string")


ROUTES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}', {}, {})".format(r, p, f"'{m}'" if m else "NULL", f"'{t}'" if t else "NULL")
    for r, p, m, t in C.ROUTES) + ") AS r(route_id, route_path, route_method, target_uri)"


# ------------------------------------------------------ spans and log lines --

def _trace_cols(ev: DataFrame) -> DataFrame:
    return ev.withColumns({
        "trace_id": F.md5(F.concat(F.col("user_id").cast("string"), F.lit("-"),
                                   F.to_date("ts").cast("string"))),
        "span_id": F.substring(F.md5(F.col("event_id").cast("string")), 1, 16),
        "application": F.element_at(F.array(*[F.lit(a) for a in C.APPLICATIONS]),
                                    (F.col("event_id") % 5 + 1).cast("int")),
    })


_TRACE_SQL = f"""
md5(CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS trace_id,
substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS span_id,
({_sql_list(C.APPLICATIONS)})[CAST(event_id % 5 + 1 AS INTEGER)] AS application"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _trace_cols(read_table(spark, sf_dir, "events"))
    return ev.select("event_id", "trace_id", "span_id", "application", "ts",
                     (F.col("value") / 100).alias("duration_s"))


SPANS_SQL = f"""
SELECT event_id, trace_id, span_id, application, ts, duration_s FROM (
  SELECT event_id, ts, value / 100 AS duration_s, {_TRACE_SQL} FROM events)"""


def _log_parts(ev: DataFrame) -> DataFrame:
    blank = (F.col("event_id") % 10) == 0
    return _trace_cols(ev).withColumns({
        "tid": F.when(blank, F.lit("")).otherwise(F.col("trace_id")),
        "sid": F.when(blank, F.lit("")).otherwise(F.col("span_id")),
        "host": F.concat(F.lit("host-"), (F.col("user_id") % 3).cast("string")),
        "level": F.when(F.col("event_type") == "error", "ERROR")
                  .when(F.col("event_type") == "view", "DEBUG").otherwise("INFO"),
        "stamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "message": F.concat(F.col("event_type"), F.lit(" event "), F.col("event_id").cast("string"),
                            F.lit(" by user "), F.col("user_id").cast("string")),
    })


_LOG_PARTS_SQL = f"""
SELECT event_id, application,
       CASE WHEN event_id % 10 = 0 THEN '' ELSE trace_id END AS tid,
       CASE WHEN event_id % 10 = 0 THEN '' ELSE span_id END AS sid,
       'host-' || CAST(user_id % 3 AS VARCHAR) AS host,
       CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'DEBUG'
            ELSE 'INFO' END AS level,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
       event_type || ' event ' || CAST(event_id AS VARCHAR) || ' by user ' ||
         CAST(user_id AS VARCHAR) AS message
FROM (SELECT event_id, user_id, event_type, ts, {_TRACE_SQL} FROM events)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Console lines; some are lines of a stack trace, some have no valid time."""
    p = _log_parts(read_table(spark, sf_dir, "events"))
    stamp = F.when(F.col("event_id") % BAD_STAMP == 0, F.lit("2024-13-45 99:00:00")).otherwise(F.col("stamp"))
    line = F.concat(stamp, F.lit(" [exec-"), (F.col("event_id") % 8).cast("string"),
                    F.lit("] shop."), F.col("application"), F.lit(".Handler ["),
                    F.col("tid"), F.lit(","), F.col("sid"), F.lit("] - "), F.col("message"))
    trace = F.concat(F.lit("\tat shop.Handler.run(Handler.java:"), F.col("event_id").cast("string"), F.lit(")"))
    return p.select(F.when(F.col("event_id") % STACK_TRACE == 0, trace).otherwise(line).alias("line"),
                    "application", "host", "level", "event_id")


LOG_LINES_SQL = f"""
SELECT CASE WHEN event_id % {STACK_TRACE} = 0
            THEN chr(9) || 'at shop.Handler.run(Handler.java:' || CAST(event_id AS VARCHAR) || ')'
            ELSE CASE WHEN event_id % {BAD_STAMP} = 0 THEN '2024-13-45 99:00:00' ELSE stamp END ||
       ' [exec-' || CAST(event_id % 8 AS VARCHAR) || '] shop.' || application ||
       '.Handler [' || tid || ',' || sid || '] - ' || message END AS line,
       application, host, level, event_id
FROM ({_LOG_PARTS_SQL})"""


def log_lines_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _log_parts(read_table(spark, sf_dir, "events"))
    line = F.concat(F.col("stamp"), F.lit(" "), F.col("level"), F.lit(" ["), F.col("application"),
                    F.lit(","), F.col("tid"), F.lit(","), F.col("sid"), F.lit("] - "),
                    F.col("message"))
    return p.select(line.alias("line"), "event_id")


LOG_LINES_TRIPLE_SQL = f"""
SELECT stamp || ' ' || level || ' [' || application || ',' || tid || ',' || sid || '] - ' ||
       message AS line, event_id
FROM ({_LOG_PARTS_SQL})"""


# ----------------------------------------------------------------- events --

def event_json_value(order_number: Column, email: Column, first: Column, last: Column) -> Column:
    """The published event body: JSON with the event schema's field order."""
    return F.to_json(F.struct(order_number.alias("orderNumber"), email.alias("email"),
                              first.alias("firstName"), last.alias("lastName")))


def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order events of accepted requests; order numbers starting with 0 lose
    the last five characters of their body (poison records)."""
    from shopflow.operators.orders import accepted_requests  # orders imports this module
    acc = accepted_requests(spark, sf_dir)
    num = uuid_from_key(F.col("request_id"))
    value = event_json_value(num, F.col("user_details.email"), F.col("user_details.first_name"),
                             F.col("user_details.last_name"))
    return (acc.select(num.alias("order_number"), value.alias("value"))
            .select(F.when(F.col("order_number").startswith("0"),
                           F.expr("substring(value, 1, length(value) - 5)"))
                    .otherwise(F.col("value")).alias("value")))


def events_avro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as registry-framed Avro values, with three kinds of poison
    records: numbers that start with 0 lack their last five bytes, with 1 have a byte too
    many, with 2 another magic byte."""
    from shopflow.operators.decode import encode_events_avro
    from shopflow.operators.orders import accepted_requests, build_events
    first = F.substring("order_number", 1, 1)
    return encode_events_avro(build_events(accepted_requests(spark, sf_dir))).select(
        F.when(first == "0", F.expr("substring(value, 1, length(value) - 5)"))
         .when(first == "1", F.concat(F.col("value"), F.unhex(F.lit("00"))))
         .when(first == "2", F.concat(F.unhex(F.lit("01")), F.expr("substring(value, 2, length(value))")))
         .otherwise(F.col("value")).alias("value"))


def _avro_field_sql(column: str) -> str:
    """Hex text of a string field: zig-zag length in one or two groups, UTF-8 bytes."""
    n = f"strlen({column})"
    return (f"CASE WHEN {n} < 64 THEN format('{{:02X}}', 2 * {n}) ELSE "
            f"format('{{:02X}}{{:02X}}', 128 + (2 * {n}) % 128, (2 * {n}) // 128) END || hex(encode({column}))")


#: Over a relation ``ev`` of order events: the framed values as hex text.
EVENTS_AVRO_SQL = f"""
SELECT *, left(order_number, 1) IN ('0', '1', '2') AS quarantined,
       CASE left(order_number, 1) WHEN '0' THEN left(h, length(h) - 10) WHEN '1' THEN h || '00'
            WHEN '2' THEN '01' || substr(h, 3) ELSE h END AS value
FROM (SELECT *, '0000000001' || {' || '.join(_avro_field_sql(c) for c in (
    'order_number', 'email', 'first_name', 'last_name'))} AS h FROM ev)"""
