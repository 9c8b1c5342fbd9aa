"""Registered queries: one per operator of the blueprint.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL
over the source tables) produce the same columns, with the same names.
Queries read whole tables; none caps, samples or filters rows to stay cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.functions import constants as C
from shopflow.functions.money import line_total, line_total_sql
from shopflow.functions.text import uuid_from_key_sql
from shopflow.operators import catalog as CAT
from shopflow.operators import decode as D
from shopflow.operators import orders as O
from shopflow.operators import telemetry as TL
from shopflow.operators.notify import render_notifications, render_sql
from shopflow.sources import fixtures as fx
from shopflow.sources import sinks
from shopflow.sources.compaction import compact, read_batches
from shopflow.sources.storage import output_dir
from shopflow.sources.tables import read_table
from shopflow.streaming.failure_stream import run_failure_stream
from shopflow.streaming.notify_stream import publish_events, run_notify_stream, run_source_only
from shopflow.streaming.orders_stream import REQUEST_SCHEMA, run_order_stream
from shopflow.streaming.rollup_stream import run_rollup_stream

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# Fixture CTEs for the oracle text.
W_INV = f"inventory AS ({fx.INVENTORY_SQL})"
W_LINES = f"lines AS ({fx.LINE_REQUESTS_SQL})"
W_REQ = f"requests AS ({fx.REQUESTS_FLAT_SQL})"
W_PROD = f"products AS ({fx.PRODUCTS_SQL})"
W_STOCK = "stock AS (SELECT DISTINCT sku_code, quantity FROM inventory)"
W_FLAG = ("flagged AS (SELECT r.*, s.sku_code IS NOT NULL AS in_stock FROM requests r "
          "LEFT JOIN stock s ON r.sku_code = s.sku_code AND r.quantity = s.quantity)")
# Accepted requests of the feed: those whose body arrived whole.
W_FED = f"fed AS (SELECT * FROM accepted WHERE order_key % {fx.BROKEN_BODY} <> 0)"
W_ACC = ("accepted AS (SELECT r.* FROM requests r WHERE EXISTS (SELECT 1 FROM inventory i "
         "WHERE i.sku_code = r.sku_code AND i.quantity = r.quantity) AND r.price IS NOT NULL "
         "AND r.email IS NOT NULL AND r.first_name IS NOT NULL AND r.last_name IS NOT NULL)")
ORDER_NO = uuid_from_key_sql("request_id")
OUTCOME_SQL = ("CASE WHEN NOT in_stock THEN 'OUT_OF_STOCK' WHEN price IS NULL OR email IS NULL "
               "OR first_name IS NULL OR last_name IS NULL THEN 'INVALID' ELSE 'ACCEPTED' END")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.line_requests(read_table(spark, sf_dir, "lineitem"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.request_outcomes(_lines(spark, sf_dir), fx.inventory(spark, sf_dir), spark, sf_dir)


# ------------------------------------------------------------- stock/orders --

@query("orders_in_stock", _with(W_INV, W_LINES) + f"""
SELECT request_id, sku_code, price, quantity, {line_total_sql('price', 'quantity')} AS line_total
FROM lines l WHERE EXISTS (SELECT 1 FROM inventory i
                           WHERE i.sku_code = l.sku_code AND i.quantity = l.quantity)""")
def q_orders_in_stock(spark, sf_dir):
    acc = O.accepted_lines(spark, sf_dir)
    return acc.select("request_id", "sku_code", "price", "quantity",
                      line_total(F.col("price"), F.col("quantity")).alias("line_total"))


@query("orders_out_of_stock", _with(W_INV, W_LINES) + """
SELECT request_id, sku_code, quantity
FROM lines l WHERE NOT EXISTS (SELECT 1 FROM inventory i
                               WHERE i.sku_code = l.sku_code AND i.quantity = l.quantity)""")
def q_orders_out_of_stock(spark, sf_dir):
    return O.out_of_stock(_lines(spark, sf_dir), fx.inventory(spark, sf_dir)).select(
        "request_id", "sku_code", "quantity")


@query("stock_flag", _with(W_INV, W_LINES, W_STOCK) + """
SELECT l.request_id, l.sku_code, l.quantity, s.sku_code IS NOT NULL AS in_stock
FROM lines l LEFT JOIN stock s ON l.sku_code = s.sku_code AND l.quantity = s.quantity""")
def q_stock_flag(spark, sf_dir):
    return O.with_stock_flag(_lines(spark, sf_dir), fx.inventory(spark, sf_dir)).select(
        "request_id", "sku_code", "quantity", "in_stock")


# The (sku, quantity) the single-probe stock predicate asks for (a parameter).
STOCK_PROBE = ("sku_1", 28)


@query("stock_predicate", _with(W_INV) + f"""
SELECT id, sku_code, quantity FROM inventory
WHERE sku_code = '{STOCK_PROBE[0]}' AND quantity = {STOCK_PROBE[1]}""")
def q_stock_predicate(spark, sf_dir):
    return fx.inventory(spark, sf_dir).where(O.stock_predicate(*STOCK_PROBE))


@query("inventory_scan", _with(W_INV) + "SELECT id, sku_code, quantity FROM inventory")
def q_inventory_scan(spark, sf_dir):
    return fx.inventory(spark, sf_dir)


@query("order_line_total", _with(W_LINES) + f"""
SELECT request_id, price, quantity, {line_total_sql('price', 'quantity')} AS line_total FROM lines""")
def q_order_line_total(spark, sf_dir):
    return _lines(spark, sf_dir).select(
        "request_id", "price", "quantity",
        line_total(F.col("price"), F.col("quantity")).alias("line_total"))


@query("order_number_assign", _with(W_INV, W_REQ, W_ACC) + f"""
SELECT request_id, {ORDER_NO} AS order_number FROM accepted""")
def q_order_number_assign(spark, sf_dir):
    acc = O.accepted_requests(spark, sf_dir)
    return acc.select("request_id", O.order_number(F.col("request_id")).alias("order_number"))


AS_OF = "2024-02-01 00:00:00"


@query("order_date_stamp", _with(W_INV, W_REQ, W_ACC) + f"""
SELECT {ORDER_NO} AS order_number, TIMESTAMP '{AS_OF}' AS order_date FROM accepted""")
def q_order_date_stamp(spark, sf_dir):
    acc = O.accepted_requests(spark, sf_dir)
    orders = O.build_orders(acc, as_of=F.lit(AS_OF).cast("timestamp_ntz"))
    return orders.select("order_number", "order_date")


@query("order_surrogate_id", _with(W_INV, W_REQ, W_ACC) + f"""
SELECT row_number() OVER (ORDER BY order_number) AS id, order_number
FROM (SELECT {ORDER_NO} AS order_number FROM accepted)""")
def q_order_surrogate_id(spark, sf_dir):
    acc = O.accepted_requests(spark, sf_dir)
    orders = O.build_orders(acc, as_of=F.lit(AS_OF).cast("timestamp_ntz"))
    return O.surrogate_ids(orders.select("order_number")).select("id", "order_number")


@query("event_projection", _with(W_INV, W_REQ, W_ACC) + f"""
SELECT {ORDER_NO} AS order_number, email, first_name, last_name FROM accepted""")
def q_event_projection(spark, sf_dir):
    return O.build_events(O.accepted_requests(spark, sf_dir))


@query("order_response", _with(W_INV, W_REQ, W_STOCK, W_FLAG) + f"""
SELECT request_id,
       CASE WHEN o = 'ACCEPTED' THEN 201 ELSE 500 END AS status,
       CASE WHEN o = 'ACCEPTED' THEN '{C.ORDER_PLACED_TEXT}'
            WHEN o = 'OUT_OF_STOCK'
            THEN '{C.OUT_OF_STOCK_PREFIX}' || sku_code || '{C.OUT_OF_STOCK_SUFFIX}'
            ELSE '{C.SERVER_ERROR_TEXT}' END AS body
FROM (SELECT request_id, sku_code, {OUTCOME_SQL} AS o FROM flagged)""")
def q_order_response(spark, sf_dir):
    return O.order_response(_outcomes(spark, sf_dir))


@query("order_contract_check", _with(W_INV, W_REQ, W_STOCK, W_FLAG) + f"""
SELECT request_id, {OUTCOME_SQL} AS outcome, ({OUTCOME_SQL}) = 'ACCEPTED' AS accepted FROM flagged""")
def q_order_contract_check(spark, sf_dir):
    return _outcomes(spark, sf_dir).select(
        "request_id", "outcome", (F.col("outcome") == O.ACCEPTED).alias("accepted"))


@query("order_split_counts", _with(W_INV, W_REQ, W_STOCK, W_FLAG) + f"""
SELECT {OUTCOME_SQL} AS outcome, count(*) AS requests FROM flagged GROUP BY 1""")
def q_order_split_counts(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"))


@query("stock_fallback", _with(W_INV, W_LINES, W_STOCK) + f"""
SELECT l.request_id, s.sku_code IS NOT NULL AND order_key % {fx.UNANSWERED} <> 0 AS in_stock,
       order_key % {fx.UNANSWERED} = 0 AS lookup_failed
FROM lines l LEFT JOIN stock s ON l.sku_code = s.sku_code AND l.quantity = s.quantity""")
def q_stock_fallback(spark, sf_dir):
    answered = O.stock_fallback(_lines(spark, sf_dir), fx.inventory(spark, sf_dir),
                                F.col("order_key") % fx.UNANSWERED == 0)
    return answered.select("request_id", "in_stock", "lookup_failed")


@query("stock_as_of", _with(f"dated AS ({fx.DATED_REQUESTS_SQL})", f"history AS ({fx.STOCK_HISTORY_SQL})",
                            "times AS (SELECT DISTINCT snapshot, valid_from FROM history)") + """
SELECT d.request_id, d.sku_code, d.quantity, d.requested_at, h.sku_code IS NOT NULL AS in_stock
FROM dated d ASOF LEFT JOIN times t ON d.requested_at >= t.valid_from
LEFT JOIN history h ON h.snapshot = t.snapshot AND h.sku_code = d.sku_code AND h.quantity = d.quantity""")
def q_stock_as_of(spark, sf_dir):
    return O.stock_flag_as_of(fx.dated_requests(spark, sf_dir), fx.stock_history(spark, sf_dir))


@query("order_number_unique", _with(W_INV, W_REQ, W_ACC) + f"""
SELECT order_number, min(request_id) AS request_id, count(*) AS copies
FROM (SELECT {ORDER_NO} AS order_number, request_id,
             unnest(CASE WHEN order_key % {fx.TWICE} = 0 THEN [1, 2] ELSE [1] END) FROM accepted)
GROUP BY order_number""")
def q_order_number_unique(spark, sf_dir):
    acc = O.accepted_requests(spark, sf_dir)
    delivered = acc.withColumn("_delivery", F.explode(F.when(
        F.col("order_key") % fx.TWICE == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return O.unique_order_numbers(O.build_orders(delivered))


def _if_whole(column: str) -> str:
    return f"CASE WHEN NOT rejected THEN {column} END AS {column}"


@query("order_request_decode", _with(
    f"r AS (SELECT *, order_key % {fx.BROKEN_BODY} = 0 AS rejected FROM ({fx.REQUESTS_FLAT_SQL}))")
    + "SELECT request_id, " + ", ".join(_if_whole(c) for c in (
        "sku_code", "price", "quantity", "email", "first_name", "last_name")) + ", rejected FROM r")
def q_order_request_decode(spark, sf_dir):
    return D.decode_order_requests(fx.requests_json(spark, sf_dir)).select(
        "request_id", "sku_code", "price", "quantity",
        F.col("user_details.email").alias("email"),
        F.col("user_details.first_name").alias("first_name"),
        F.col("user_details.last_name").alias("last_name"), "rejected")


# ---------------------------------------------------------------- catalogue --

PRODUCT_ID = uuid_from_key_sql("'product:' || id")


@query("product_scan", _with(W_PROD) + "SELECT id, name, description, price FROM products")
def q_product_scan(spark, sf_dir):
    return fx.products(spark, sf_dir)


@query("product_response", _with(W_PROD) + "SELECT id, name, description, price FROM products")
def q_product_response(spark, sf_dir):
    return CAT.product_response(fx.products(spark, sf_dir))


@query("product_request_decode", _with(W_PROD) + """
SELECT id AS request_id, name, description, price, false AS rejected FROM products""")
def q_product_request_decode(spark, sf_dir):
    return D.decode_product_requests(fx.product_requests_json(spark, sf_dir)).drop("value")


@query("product_build", _with(W_PROD) + f"""
SELECT {PRODUCT_ID} AS id, name, description, price FROM products""")
def q_product_build(spark, sf_dir):
    return CAT.build_products(D.decode_product_requests(fx.product_requests_json(spark, sf_dir)))


@query("product_append", _with(W_PROD) + f"""
SELECT {PRODUCT_ID} AS id, name, description, price FROM products""")
def q_product_append(spark, sf_dir):
    path = output_dir(spark, "products")
    built = CAT.build_products(D.decode_product_requests(fx.product_requests_json(spark, sf_dir)))
    sinks.append(built, path)
    return sinks.read_sink(spark, path)


@query("order_append", _with(W_INV, W_REQ, W_ACC) + f"""
SELECT row_number() OVER (ORDER BY order_key % 2, {ORDER_NO}) AS id,
       {ORDER_NO} AS order_number, request_id, sku_code,
       {line_total_sql('price', 'quantity')} AS price, quantity, TIMESTAMP '{AS_OF}' AS order_date
FROM accepted""")
def q_order_append(spark, sf_dir):
    """Two appends, of the even and the odd order keys: ids go on from the first."""
    path = output_dir(spark, "orders")
    acc = O.accepted_requests(spark, sf_dir)
    for half in (0, 1):
        orders = O.build_orders(acc.where(F.col("order_key") % 2 == half),
                                as_of=F.lit(AS_OF).cast("timestamp_ntz"))
        stored = sinks.read_sink(spark, path) if half else None
        sinks.append(O.surrogate_ids(orders, after=O.last_id(stored)), path)
    return sinks.read_sink(spark, path)


# ------------------------------------------------------------------ events --

W_EVENTS = ("ev AS (SELECT " + ORDER_NO + " AS order_number, email, first_name, last_name "
            "FROM accepted)")
EVENT_JSON_SQL = ("'{\"orderNumber\":\"' || order_number || '\",\"email\":\"' || email || "
                  "'\",\"firstName\":\"' || first_name || '\",\"lastName\":\"' || last_name || '\"}'")
W_EVJSON = (f"evjson AS (SELECT order_number, email, first_name, last_name, "
            f"CASE WHEN order_number LIKE '0%' THEN substr(j, 1, length(j) - 5) ELSE j END AS value, "
            f"order_number LIKE '0%' AS quarantined "
            f"FROM (SELECT *, {EVENT_JSON_SQL} AS j FROM ev))")


@query("event_publish", _with(W_INV, W_REQ, W_ACC, W_EVENTS) + f"""
SELECT {EVENT_JSON_SQL} AS value FROM ev""")
def q_event_publish(spark, sf_dir):
    topic = output_dir(spark, "topic")
    ev = O.build_events(O.accepted_requests(spark, sf_dir))
    publish_events(ev.select(fx.event_json_value(F.col("order_number"), F.col("email"),
                                                 F.col("first_name"), F.col("last_name"))
                             .alias("value")), topic)
    return sinks.read_sink(spark, topic).select("value")


@query("event_decode_quarantine", _with(W_INV, W_REQ, W_ACC, W_EVENTS, W_EVJSON) + """
SELECT value,
       CASE WHEN quarantined THEN NULL ELSE order_number END AS order_number,
       CASE WHEN quarantined THEN NULL ELSE email END AS email,
       CASE WHEN quarantined THEN NULL ELSE first_name END AS first_name,
       CASE WHEN quarantined THEN NULL ELSE last_name END AS last_name,
       quarantined
FROM evjson""")
def q_event_decode_quarantine(spark, sf_dir):
    return D.decode_events(fx.events_json(spark, sf_dir))


@query("event_avro_decode", _with(W_INV, W_REQ, W_ACC, W_EVENTS, f"avro AS ({fx.EVENTS_AVRO_SQL})") + """
SELECT value,
       CASE WHEN quarantined THEN NULL ELSE order_number END AS order_number,
       CASE WHEN quarantined THEN NULL ELSE email END AS email,
       CASE WHEN quarantined THEN NULL ELSE first_name END AS first_name,
       CASE WHEN quarantined THEN NULL ELSE last_name END AS last_name,
       quarantined
FROM avro""")
def q_event_avro_decode(spark, sf_dir):
    """Written and read; the bytes themselves are compared too (as hex text)."""
    return D.decode_events_avro(fx.events_avro(spark, sf_dir)).withColumn("value", F.hex("value"))


@query("notification_render", _with(W_INV, W_REQ, W_ACC, W_EVENTS) + render_sql("ev"))
def q_notification_render(spark, sf_dir):
    return render_notifications(O.build_events(O.accepted_requests(spark, sf_dir)))


@query("event_stream_source", _with(W_INV, W_REQ, W_ACC, W_EVENTS, W_EVJSON) + """
SELECT value FROM evjson""")
def q_event_stream_source(spark, sf_dir):
    base = output_dir(spark, "event-source")
    publish_events(fx.events_json(spark, sf_dir), f"{base}/topic")
    run_source_only(spark, f"{base}/topic", f"{base}/out", f"{base}/_checkpoint")
    return sinks.read_sink(spark, f"{base}/out", "value string")


@query("notification_outbox", _with(W_INV, W_REQ, W_ACC, W_EVENTS, W_EVJSON) + render_sql(
    "(SELECT * FROM evjson WHERE NOT quarantined)"))
def q_notification_outbox(spark, sf_dir):
    paths = _notified(spark, sf_dir)
    return sinks.read_sink(spark, paths.outbox).drop("batch_id")


def _notified(spark, sf_dir):
    topic = output_dir(spark, "notify-topic")
    publish_events(fx.events_json(spark, sf_dir), topic)
    return run_notify_stream(spark, topic)


@query("notification_dead_letters", _with(W_INV, W_REQ, W_ACC, W_EVENTS, W_EVJSON) + """
SELECT value FROM evjson WHERE quarantined""")
def q_notification_dead_letters(spark, sf_dir):
    return sinks.read_sink(spark, _notified(spark, sf_dir).dead_letters).select("value")


# ------------------------------------------------------------------ streams --

#: Deliveries in which the input of some streams arrives.
DELIVERIES = 4


def _ordered(spark, sf_dir, codec="json"):
    """The request bodies of the whole table, published and run through the stream."""
    topic = output_dir(spark, "request-topic")
    sinks.append(fx.requests_json(spark, sf_dir), topic)
    return run_order_stream(spark, topic, lambda: fx.inventory(spark, sf_dir), codec=codec)


W_ONCE = "once AS (SELECT DISTINCT * FROM fed)"


@query("orders_in_stock_stream", _with(W_INV, W_REQ, W_ACC, W_FED, W_ONCE) + f"""
SELECT row_number() OVER (ORDER BY {ORDER_NO}) AS id, {ORDER_NO} AS order_number, request_id, sku_code,
       {line_total_sql('price', 'quantity')} AS price, quantity FROM once""")
def q_orders_in_stock_stream(spark, sf_dir):
    paths = _ordered(spark, sf_dir)
    return sinks.read_sink(spark, paths.orders).select(
        "id", "order_number", "request_id", "sku_code", "price", "quantity")


@query("order_and_event_sinks", _with(W_INV, W_REQ, W_ACC, W_FED, W_ONCE) + f"""
SELECT 'orders' AS sink, {ORDER_NO} AS item FROM once
UNION ALL
SELECT 'events' AS sink, {ORDER_NO} AS item FROM once
UNION ALL
SELECT 'rejects' AS sink, request_id AS item
FROM (SELECT DISTINCT request_id FROM requests WHERE order_key % {fx.BROKEN_BODY} = 0)""")
def q_order_and_event_sinks(spark, sf_dir):
    paths = _ordered(spark, sf_dir)
    orders = sinks.read_sink(spark, paths.orders).select(F.lit("orders").alias("sink"),
                                                        F.col("order_number").alias("item"))
    events = sinks.read_sink(spark, paths.events).select(F.lit("events").alias("sink"),
                                                        F.col("order_number").alias("item"))
    rejects = sinks.read_sink(spark, paths.rejects).select(F.lit("rejects").alias("sink"),
                                                          F.col("request_id").alias("item"))
    return orders.unionByName(events).unionByName(rejects)


@query("order_to_notification", _with(W_INV, W_REQ, W_ACC, W_FED, W_ONCE, f"""
ev AS (SELECT {ORDER_NO} AS order_number, email, first_name, last_name FROM once)""") + render_sql("ev"))
def q_order_to_notification(spark, sf_dir):
    """Order stream and notification stream in one: the event sink is the topic."""
    notified = run_notify_stream(spark, _ordered(spark, sf_dir).events)
    return sinks.read_sink(spark, notified.outbox).drop("batch_id")


@query("order_to_notification_avro", ORACLE["order_to_notification"])
def q_order_to_notification_avro(spark, sf_dir):
    """The same with Avro events: what the one stream writes the other reads."""
    notified = run_notify_stream(spark, _ordered(spark, sf_dir, codec="avro").events, codec="avro")
    return sinks.read_sink(spark, notified.outbox).drop("batch_id")


#: A window that is over when the next run begins.
NO_WINDOW = "0 seconds"


ORDER_SCHEMA = ("id long, order_number string, request_id string, sku_code string, "
                "price decimal(29,2), quantity int, order_date timestamp_ntz")


def _deliver(rows: DataFrame, topic: str, deliveries: int) -> int:
    """Append ``rows`` to a topic, as files of a task's share each; the number of files that
    make one of (at least) so many deliveries."""
    spark = rows.sparkSession
    sinks.append(rows.repartition(max(deliveries, int(spark.conf.get("spark.sql.shuffle.partitions")))), topic)
    return max(1, len(spark.read.schema(rows.schema).parquet(topic).inputFiles()) // deliveries)


@query("order_compaction", _with(W_INV, W_REQ, W_ACC, W_FED, W_ONCE) + f"""
SELECT {ORDER_NO} AS order_number, request_id, sku_code,
       {line_total_sql('price', 'quantity')} AS price, quantity FROM once""")
def q_order_compaction(spark, sf_dir):
    """Orders of several batches, packed into spans, the last batch loose."""
    topic = output_dir(spark, "request-topic")
    paths = run_order_stream(spark, topic, lambda: fx.inventory(spark, sf_dir), options={
        "maxFilesPerTrigger": str(_deliver(fx.requests_json(spark, sf_dir), topic, DELIVERIES))})
    compact(spark, paths.orders, ORDER_SCHEMA)
    return read_batches(spark, paths.orders, ORDER_SCHEMA).select(
        "order_number", "request_id", "sku_code", "price", "quantity")


@query("order_redelivery", ORACLE["orders_in_stock_stream"])
def q_order_redelivery(spark, sf_dir):
    """All requests delivered again after the window: no number is stored twice."""
    topic, requests = output_dir(spark, "request-topic"), fx.requests_json(spark, sf_dir)
    paths = None
    for _ in range(2):
        sinks.append(requests, topic)
        paths = run_order_stream(spark, topic, lambda: fx.inventory(spark, sf_dir), paths,
                                 redelivery_window=NO_WINDOW)
        requests = spark.read.schema(REQUEST_SCHEMA).parquet(topic)      # the bodies that came, once more
    return sinks.read_sink(spark, paths.orders).select(
        "id", "order_number", "request_id", "sku_code", "price", "quantity")


@query("notification_redelivery", ORACLE["notification_outbox"])
def q_notification_redelivery(spark, sf_dir):
    """All events delivered again after the window: the outbox stays as it is."""
    topic = output_dir(spark, "notify-topic")
    paths = None
    for _ in range(2):
        publish_events(fx.events_json(spark, sf_dir), topic)
        paths = run_notify_stream(spark, topic, paths, redelivery_window=NO_WINDOW)
    return sinks.read_sink(spark, paths.outbox).drop("batch_id")


# ---------------------------------------------------------------- telemetry --

W_ACCESS = f"access AS ({fx.ACCESS_LOG_SQL})"
W_ROUTES = f"routes AS ({fx.ROUTES_SQL})"
W_ROUTED = ("routed AS (SELECT a.*, r.route_id, r.target_uri FROM access a LEFT JOIN routes r "
            "ON a.path = r.route_path AND (r.route_method IS NULL OR r.route_method = a.method))")
W_CALLS = f"calls AS ({fx.CALLS_SQL})"
W_TARGETS = f"targets AS ({fx.TARGETS_SQL})"
W_SPANS = f"spans AS ({fx.SPANS_SQL})"
W_LOGS = f"logs AS ({fx.LOG_LINES_SQL})"
W_TRIPLE = f"triple AS ({fx.LOG_LINES_TRIPLE_SQL})"
_PAT = C.LOG_LINE_PATTERN


def _log_part(i: int) -> str:
    return f"CASE WHEN ts IS NOT NULL THEN NULLIF(regexp_extract(line, '{_PAT}', {i}), '') END"


W_PARSED = (f"parsed AS (SELECT event_id, application, host, level, line, ts, "
            f"{_log_part(2)} AS thread, {_log_part(3)} AS logger, {_log_part(4)} AS trace_id, "
            f"{_log_part(5)} AS span_id, {_log_part(6)} AS message, ts IS NOT NULL AS parsed "
            f"FROM (SELECT *, try_strptime(regexp_extract(line, '{_PAT}', 1), '%Y-%m-%d %H:%M:%S') AS ts "
            f"FROM logs))")


def _routed(spark, sf_dir):
    return TL.classify_routes(fx.access_log(spark, sf_dir), fx.routes(spark))


@query("route_classify", _with(W_ACCESS, W_ROUTES, W_ROUTED) + """
SELECT event_id, method, path, route_id, target_uri FROM routed""")
def q_route_classify(spark, sf_dir):
    return _routed(spark, sf_dir).select("event_id", "method", "path", "route_id", "target_uri")


@query("path_rewrite", _with(W_ACCESS, W_ROUTES, W_ROUTED) + f"""
SELECT event_id, route_id,
       CASE WHEN route_id IS NULL THEN NULL WHEN route_id LIKE '%{C.SWAGGER_ROUTE_SUFFIX}'
            THEN '{C.DOCS_PATH}' ELSE path END AS forward_path
FROM routed""")
def q_path_rewrite(spark, sf_dir):
    return TL.rewrite_path(_routed(spark, sf_dir)).select("event_id", "route_id", "forward_path")


@query("fallback_response", _with(W_ACCESS, W_ROUTES, W_ROUTED) + f"""
SELECT event_id, route_id,
       CASE WHEN route_id IS NULL THEN 404 WHEN ok THEN status WHEN method = 'GET' THEN 503
            ELSE 404 END AS status,
       CASE WHEN route_id IS NOT NULL AND NOT ok AND method = 'GET'
            THEN '{C.SERVICE_UNAVAILABLE_TEXT}' END AS body
FROM routed""")
def q_fallback_response(spark, sf_dir):
    return TL.fallback_response(_routed(spark, sf_dir)).select("event_id", "route_id", "status", "body")


def _calls_failed(spark, sf_dir, time_limit):
    c = fx.calls(spark, sf_dir)
    return c.withColumn("failed", TL.failed_call(F.col("error"), F.col("duration_s"), time_limit))


@query("call_outcome", _with(W_CALLS) + f"""
SELECT event_id, instance,
       coalesce(error, false) OR coalesce(duration_s > {C.CALL_TIME_LIMIT_S}, false) AS failed
FROM calls""")
def q_call_outcome(spark, sf_dir):
    return _calls_failed(spark, sf_dir, C.CALL_TIME_LIMIT_S).select("event_id", "instance", "failed")


def _failure_rate_sql(n: int, failed_sql: str) -> str:
    return _with(W_CALLS) + f"""
SELECT event_id, instance, n_calls, n_failed,
       CAST(n_failed AS DOUBLE) / n_calls AS failure_rate,
       n_calls >= {C.MIN_CALLS} AND CAST(n_failed AS DOUBLE) / n_calls >= {C.FAILURE_RATE_THRESHOLD} AS flagged
FROM (SELECT event_id, instance,
             count(*) OVER w AS n_calls,
             CAST(sum(CAST({failed_sql} AS BIGINT)) OVER w AS BIGINT) AS n_failed
      FROM calls
      WINDOW w AS (PARTITION BY instance ORDER BY ts, event_id
                   ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"""


# Inventory client: no time limiter is applied to its calls -> errors only.
@query("failure_rate_5", _failure_rate_sql(C.INVENTORY_WINDOW, "coalesce(error, false)"))
def q_failure_rate_5(spark, sf_dir):
    c = _calls_failed(spark, sf_dir, None)
    return TL.failure_rate(c, C.INVENTORY_WINDOW).select(
        "event_id", "instance", "n_calls", "n_failed", "failure_rate", "flagged")


BLOCK_CALLS = 256


# Gateway default: its 3 s time limiter turns slow calls into failures.
@query("failure_rate_10", _failure_rate_sql(
    C.GATEWAY_WINDOW, f"(coalesce(error, false) OR coalesce(duration_s > {C.CALL_TIME_LIMIT_S}, false))"))
def q_failure_rate_10(spark, sf_dir):
    c = _calls_failed(spark, sf_dir, C.CALL_TIME_LIMIT_S)
    # Small blocks: every instance spans several, so the carried calls count.
    return TL.failure_rate(c, C.GATEWAY_WINDOW, block_rows=BLOCK_CALLS).select(
        "event_id", "instance", "n_calls", "n_failed", "failure_rate", "flagged")


@query("failure_rate_stream", ORACLE["failure_rate_5"])
def q_failure_rate_stream(spark, sf_dir):
    """The calls arrive in four deliveries, by time; windows reach back over them."""
    topic, paths = output_dir(spark, "call-topic"), None
    calls = fx.calls(spark, sf_dir)
    at = F.col("ts").cast("timestamp").cast("double")
    cuts = calls.select(F.percentile_approx(at, [k / DELIVERIES for k in range(1, DELIVERIES)])).first()[0] or []
    part = F.lit(0)
    for cut in cuts:
        part = part + (at > cut).cast("int")
    for n in range(DELIVERIES):
        sinks.append(calls.where(part == n), topic)
        paths = run_failure_stream(spark, topic, paths, C.INVENTORY_WINDOW, block_rows=BLOCK_CALLS,
                                   options={"maxFilesPerTrigger": "1000000"})
    return sinks.read_sink(spark, paths.rates).select(
        "event_id", "instance", "n_calls", "n_failed", "failure_rate", "flagged")


@query("failure_flag_changes", "WITH rated AS (" + _failure_rate_sql(
    C.INVENTORY_WINDOW, "coalesce(error, false)") + "), " + W_CALLS + """,
placed AS (SELECT c.instance, c.event_id, c.ts, r.flagged,
                  row_number() OVER w AS position, coalesce(lag(r.flagged) OVER w, false) AS before
           FROM calls c JOIN rated r ON r.event_id = c.event_id
           WINDOW w AS (PARTITION BY c.instance ORDER BY c.ts, c.event_id))
SELECT instance, event_id, ts, position, NOT before AS healthy_before, NOT flagged AS healthy
FROM placed WHERE flagged <> before""")
def q_failure_flag_changes(spark, sf_dir):
    rated = TL.failure_rate(_calls_failed(spark, sf_dir, None), C.INVENTORY_WINDOW)
    return TL.flag_changes(rated, block_rows=BLOCK_CALLS)


@query("target_labels", _with(W_CALLS, W_TARGETS) + """
SELECT t.target, t.application, c.event_id FROM targets t LEFT JOIN calls c ON t.target = c.target""")
def q_target_labels(spark, sf_dir):
    return TL.targets_with_samples(fx.calls(spark, sf_dir), fx.targets(spark)).select(
        "target", "application", "event_id")


def _rollup_sql(interval_sql: str, closed_before: str | None = None) -> str:
    where = f"WHERE window_end <= {closed_before}" if closed_before else ""
    return _with(W_CALLS, W_TARGETS) + f"""
SELECT * FROM (
  SELECT time_bucket(INTERVAL '{interval_sql}', c.ts) AS window_start,
         time_bucket(INTERVAL '{interval_sql}', c.ts) + INTERVAL '{interval_sql}' AS window_end,
         t.application, count(*) AS samples,
         CAST(sum(CAST(c.duration_s AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS total_duration_s,
         max(c.duration_s) AS max_duration_s
  FROM calls c JOIN targets t ON c.target = t.target
  GROUP BY 1, 2, 3) {where}"""


@query("interval_rollup", _rollup_sql(C.SCRAPE_INTERVAL))
def q_interval_rollup(spark, sf_dir):
    return TL.rollup(TL.label_samples(fx.calls(spark, sf_dir), fx.targets(spark)), C.SCRAPE_INTERVAL)


#: Coarser grains, each built from the rows of the one before.
GRAINS = ["1 hour", "1 day"]


@query("rollup_grains", "\nUNION ALL\n".join(
    f"SELECT '{g}' AS grain, * FROM ({_rollup_sql(g)})" for g in GRAINS))
def q_rollup_grains(spark, sf_dir):
    partials = TL.rollup(TL.label_samples(fx.calls(spark, sf_dir), fx.targets(spark)), C.SCRAPE_INTERVAL)
    out = None
    for grain in GRAINS:
        partials = TL.coarser_rollup(partials, grain)
        rows = partials.select(F.lit(grain).alias("grain"), *partials.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


STREAM_DELAY = "10 seconds"


@query("interval_rollup_stream", _rollup_sql(
    C.SCRAPE_INTERVAL, f"(SELECT max(ts) FROM events) - INTERVAL '{STREAM_DELAY}'"))
def q_interval_rollup_stream(spark, sf_dir):
    out = run_rollup_stream(spark, sf_dir, C.SCRAPE_INTERVAL, STREAM_DELAY)
    return sinks.read_sink(spark, out)


BOUNDS_SQL = TL.bucket_bound_sql("duration_s", TL.DEFAULT_BOUNDS)


@query("duration_histogram", _with(W_SPANS) + f"""
, filled AS (
  SELECT application, {BOUNDS_SQL} AS le, count(*) AS samples,
         CAST(sum(CAST(duration_s AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS sum_s,
         max(duration_s) AS max_s, arg_max(trace_id, row(ts, event_id)) AS exemplar_trace_id
  FROM spans GROUP BY 1, 2),
every_bucket AS (
  SELECT application, unnest({[*sorted(TL.DEFAULT_BOUNDS), float('inf')]!r}::DOUBLE[]) AS le
  FROM (SELECT DISTINCT application FROM spans))
SELECT e.application, e.le, coalesce(samples, 0) AS samples,
       coalesce(sum_s, 0)::DECIMAL(38,4) AS sum_s, max_s, exemplar_trace_id,
       CAST(sum(coalesce(samples, 0)) OVER (PARTITION BY e.application ORDER BY e.le
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative,
       CAST(sum(coalesce(samples, 0)) OVER (PARTITION BY e.application) AS BIGINT) AS total_samples,
       CAST(sum(sum_s) OVER (PARTITION BY e.application) AS DECIMAL(38,4)) AS total_s
FROM every_bucket e LEFT JOIN filled f ON f.application = e.application AND f.le = e.le""".replace(
    "inf]", "'inf'::DOUBLE]"))
def q_duration_histogram(spark, sf_dir):
    return TL.duration_histogram(fx.spans(spark, sf_dir))


SAMPLED = 0.25


@query("trace_sample", _with(W_SPANS) + "SELECT event_id, trace_id FROM ("
       + TL.trace_sample_sql("spans", SAMPLED) + ")")
def q_trace_sample(spark, sf_dir):
    return TL.trace_sample(fx.spans(spark, sf_dir), SAMPLED).select("event_id", "trace_id")


@query("log_parse", _with(W_LOGS, W_PARSED) + """
SELECT event_id, ts, thread, logger, trace_id, span_id, message, parsed FROM parsed""")
def q_log_parse(spark, sf_dir):
    return TL.parse_log_lines(fx.log_lines(spark, sf_dir)).select(
        "event_id", "ts", "thread", "logger", "trace_id", "span_id", "message", "parsed")


@query("log_trace_id", _with(W_TRIPLE) + f"""
SELECT event_id, NULLIF(regexp_extract(line, '{C.TRACE_ID_MATCHER}', 1), '') AS trace_id FROM triple""")
def q_log_trace_id(spark, sf_dir):
    return TL.extract_trace_id(fx.log_lines_triple(spark, sf_dir)).select("event_id", "trace_id")


@query("log_labels", _with(W_LOGS) + """
SELECT event_id, labels,
       regexp_extract(labels, '(?:^|,)application=([^,]*)', 1) AS label_application,
       regexp_extract(labels, '(?:^|,)host=([^,]*)', 1) AS label_host,
       regexp_extract(labels, '(?:^|,)level=([^,]*)', 1) AS label_level
FROM (SELECT event_id, 'application=' || application || ',host=' || host || ',level=' || level AS labels
      FROM logs)""")
def q_log_labels(spark, sf_dir):
    logs = fx.log_lines(spark, sf_dir)
    labelled = logs.withColumn("labels", TL.label_string(logs))
    m = TL.parse_labels(F.col("labels"))
    return labelled.select("event_id", "labels",
                           m["application"].alias("label_application"),
                           m["host"].alias("label_host"), m["level"].alias("label_level"))


@query("log_level_filter", _with(W_LOGS) + """
SELECT event_id, application, level FROM logs WHERE level IN ('INFO', 'WARN', 'ERROR')""")
def q_log_level_filter(spark, sf_dir):
    logs = fx.log_lines(spark, sf_dir)
    return logs.where(TL.level_at_least(F.col("level"))).select("event_id", "application", "level")


@query("log_sort_by_time", _with(W_LOGS, W_PARSED) + """
SELECT event_id, application, host, level, ts,
       row_number() OVER (PARTITION BY application, host, level ORDER BY ts NULLS FIRST, event_id) AS position
FROM parsed""")
def q_log_sort_by_time(spark, sf_dir):
    parsed = TL.parse_log_lines(fx.log_lines(spark, sf_dir)).select(
        "event_id", "application", "host", "level", "ts")
    return TL.position_in_label_set(parsed)


@query("trace_log_join", _with(W_SPANS, W_LOGS) + f"""
SELECT p.trace_id, p.event_id, s.n_spans, s.trace_start
FROM (SELECT event_id, regexp_extract(line, '{C.LOG_TRACE_ID_PATTERN}', 1) AS trace_id FROM logs) p
JOIN (SELECT trace_id, count(*) AS n_spans, min(ts) AS trace_start FROM spans
      WHERE trace_id IS NOT NULL AND trace_id <> '' GROUP BY trace_id) s
  ON p.trace_id = s.trace_id""")
def q_trace_log_join(spark, sf_dir):
    logs = fx.log_lines(spark, sf_dir).select(
        "event_id", TL.line_trace_id(F.col("line")).alias("trace_id"))
    return TL.traces_to_logs(fx.spans(spark, sf_dir), logs).select(
        "trace_id", "event_id", "n_spans", "trace_start")
