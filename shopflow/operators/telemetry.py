"""Jobs over access logs, log lines, spans and call outcomes.

The gateway's routing, the resilience settings, the log layout and the metric
scraping are re-expressed as jobs over their records: joins to small fixed
dimensions (broadcast: their size is fixed), regexp parsing, partial-aggregated
group-bys and count-based windows that never put a whole hot group into one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.functions import constants as C
from shopflow.plans.ordinal import blocked, position_within

# ------------------------------------------------------------------ gateway --


def classify_routes(access: DataFrame, routes: DataFrame) -> DataFrame:
    """The route of each request by exact path (and method where the
    route names one); no match leaves the route null. ``routes`` is the fixed
    seven-row dimension, broadcast."""
    r = F.broadcast(routes)
    cond = (access["path"] == r["route_path"]) & (
        r["route_method"].isNull() | (r["route_method"] == access["method"]))
    return access.join(r, cond, "left").drop("route_path", "route_method")


def rewrite_path(routed: DataFrame) -> DataFrame:
    """Documentation routes forward to the fixed docs path."""
    return routed.withColumn(
        "forward_path",
        F.when(F.col("route_id").isNull(), F.lit(None).cast("string"))
         .when(F.col("route_id").endswith(C.SWAGGER_ROUTE_SUFFIX), F.lit(C.DOCS_PATH))
         .otherwise(F.col("path")))


FALLBACK_METHOD = next(method for name, _, method, _ in C.ROUTES if name == "fallbackRoute")


def fallback_response(routed: DataFrame) -> DataFrame:
    """A failed downstream call is forwarded to the fallback route with its
    own method. That route serves GET: it answers 503 with the fixed text. For
    any other method it is a path without a route, and that answers 404."""
    routed_ok = F.col("route_id").isNotNull()
    served = F.col("method") == FALLBACK_METHOD
    return routed.withColumns({
        "status": F.when(~routed_ok, F.lit(404)).when(F.col("ok"), F.col("status"))
                   .when(served, F.lit(503)).otherwise(F.lit(404)),
        "body": F.when(routed_ok & ~F.col("ok") & served, F.lit(C.SERVICE_UNAVAILABLE_TEXT)),
    })


# ------------------------------------------------------------ call outcomes --

def failed_call(error: Column | str, duration_s: Column | str,
                time_limit_s: float | None = C.CALL_TIME_LIMIT_S) -> Column:
    """an error, or (where a time limiter applies) a call above the limit."""
    error = F.col(error) if isinstance(error, str) else error
    duration_s = F.col(duration_s) if isinstance(duration_s, str) else duration_s
    failed = F.coalesce(error, F.lit(False))
    if time_limit_s is not None:
        failed = failed | F.coalesce(duration_s > F.lit(time_limit_s), F.lit(False))
    return failed


def failure_rate(calls: DataFrame, window_calls: int, min_calls: int = C.MIN_CALLS,
                 threshold: float = C.FAILURE_RATE_THRESHOLD, failed: str = "failed",
                 block_rows: int = 1 << 20, num_partitions: int | None = None,
                 order: tuple[str, ...] = ("ts", "event_id"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Failure rate over the last ``window_calls`` calls of each instance (in
    the order of the columns ``order``), flagged at >= threshold once ``min_calls``
    calls are in the window. ``keep`` names columns passed through.

    Calls are numbered per instance (range-partitioned, see plans.ordinal), cut
    into blocks of ``block_rows`` calls, and each block gets a copy of the
    previous block's last ``window_calls - 1`` calls; the window then runs per
    (instance, block), so a hot instance is spread over many tasks.
    """
    slim = calls.select("instance", *order, *keep, F.col(failed).alias("_failed"))
    pos = position_within(slim, ["instance"], list(order), num_partitions=num_partitions)
    b = blocked(pos, "position", block_rows, window_calls - 1)
    w = (Window.partitionBy("instance", "_block").orderBy("position")
         .rowsBetween(-(window_calls - 1), 0))
    out = (b.withColumn("n_calls", F.count(F.lit(1)).over(w))
            .withColumn("n_failed", F.sum(F.col("_failed").cast("long")).over(w))
            .where(~F.col("_carry")).drop("_block", "_carry", "_failed"))
    rate = F.col("n_failed").cast("double") / F.col("n_calls")
    return out.withColumns({
        "failure_rate": rate,
        "flagged": (F.col("n_calls") >= min_calls) & (rate >= threshold),
    })


def flag_changes(rated: DataFrame, block_rows: int = 1 << 20) -> DataFrame:
    """The calls at which an instance's W01 flag turns on or off, in order
    (``position`` within the instance, ``healthy`` before and after). An instance
    starts healthy. Blocks carry one call over, so no task holds an instance."""
    b = blocked(rated, "position", block_rows, 1)
    before = F.coalesce(F.lag("flagged").over(
        Window.partitionBy("instance", "_block").orderBy("position")), F.lit(False))
    return (b.withColumn("_before", before).where(~F.col("_carry"))
            .where(F.col("flagged") != F.col("_before"))
            .select("instance", "event_id", "ts", "position", (~F.col("_before")).alias("healthy_before"),
                    (~F.col("flagged")).alias("healthy")))


# ------------------------------------------------------------------ metrics --

def label_samples(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """J05, inner part: samples with their target's application (the target
    dimension is the fixed scrape list, broadcast)."""
    return samples.join(F.broadcast(targets), "target")


def targets_with_samples(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Every target keeps a row, those without samples with null sample
    columns. Written as broadcast inner join + anti join on the distinct
    targets seen, so the large side is never shuffled by its five keys."""
    labelled = label_samples(samples, targets)
    seen = samples.select("target").distinct()
    idle = targets.join(seen, "target", "left_anti")
    return labelled.unionByName(idle, allowMissingColumns=True)


def rollup(samples: DataFrame, interval: str) -> DataFrame:
    """Samples per interval and application (batch or streaming)."""
    return (samples.groupBy(F.window("ts", interval).alias("w"), "application")
            .agg(F.count(F.lit(1)).alias("samples"),
                 F.sum(F.col("duration_s").cast("decimal(18,4)")).cast("decimal(38,4)")
                  .alias("total_duration_s"),
                 F.max("duration_s").alias("max_duration_s"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "application", "samples", "total_duration_s", "max_duration_s"))


def coarser_rollup(partials: DataFrame, interval: str) -> DataFrame:
    """A02 at a coarser grain, from the rows of a finer rollup: counts and sums add up
    and maxima meet, so no sample is read again. The interval must be a multiple of the
    finer one. Rows of one window (late batches of a stream) may come several times."""
    return (partials.groupBy(F.window("window_start", interval).alias("w"), "application")
            .agg(F.sum("samples").alias("samples"),
                 F.sum("total_duration_s").cast("decimal(38,4)").alias("total_duration_s"),
                 F.max("max_duration_s").alias("max_duration_s"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "application", "samples", "total_duration_s", "max_duration_s"))


def bucket_bound(duration_s: Column, bounds: list[float]) -> Column:
    """The smallest upper bound holding the value (+inf above the last)."""
    expr = None
    for b in sorted(bounds):
        cond = duration_s <= F.lit(float(b))
        expr = F.when(cond, F.lit(float(b))) if expr is None else expr.when(cond, F.lit(float(b)))
    return expr.otherwise(F.lit(float("inf")))


def bucket_bound_sql(col: str, bounds: list[float]) -> str:
    return ("CASE " + " ".join(f"WHEN {col} <= {float(b)!r} THEN {float(b)!r}" for b in sorted(bounds))
            + " ELSE 'inf'::DOUBLE END")


# Request-duration bucket bounds in seconds (a parameter of the histogram).
DEFAULT_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def duration_histogram(spans: DataFrame, bounds: list[float] = DEFAULT_BOUNDS) -> DataFrame:
    """Per application and bucket (every bound and +inf, empty ones too):
    count, exact sum, max, an exemplar trace id (of the latest sample), the
    cumulative count up to the bucket, and the application's total count and sum. A
    span without a duration counts in the +inf bucket, so totals count all spans."""
    agg = (spans.withColumn("le", bucket_bound(F.col("duration_s"), bounds))
           .groupBy("application", "le")
           .agg(F.count(F.lit(1)).alias("samples"),
                F.sum(F.col("duration_s").cast("decimal(18,4)")).cast("decimal(38,4)").alias("sum_s"),
                F.max("duration_s").alias("max_s"),
                F.max_by("trace_id", F.struct("ts", "event_id")).alias("exemplar_trace_id")))
    # Empty buckets: an application's filled ones (at most one row per bound) become a
    # map, from which every bucket is looked up. The spans are aggregated once.
    values = ["samples", "sum_s", "max_s", "exemplar_trace_id"]
    filled = agg.groupBy("application").agg(F.map_from_entries(F.collect_list(
        F.struct("le", F.struct(*values)))).alias("filled"))
    every = F.array(*[F.lit(float(x)) for x in [*sorted(bounds), float("inf")]])
    full = filled.select("application", "filled", F.explode(every).alias("le")) \
        .withColumn("b", F.try_element_at("filled", F.col("le"))).select(
        "application", "le", F.coalesce("b.samples", F.lit(0)).cast("long").alias("samples"),
        F.coalesce("b.sum_s", F.lit(0)).cast("decimal(38,4)").alias("sum_s"), "b.max_s",
        "b.exemplar_trace_id")
    whole = Window.partitionBy("application")
    running = whole.orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumns({
        "cumulative": F.sum("samples").over(running),
        "total_samples": F.sum("samples").over(whole),
        "total_s": F.sum("sum_s").over(whole).cast("decimal(38,4)")})


_SAMPLE_DIGITS = 15   # hexadecimal digits of the hash that decide


def _sample_limit(probability: float) -> str:
    """The decisive digits from which on a trace is left out; "g" sorts after all."""
    n = int(probability * 16 ** _SAMPLE_DIGITS)
    return "g" if n >= 16 ** _SAMPLE_DIGITS else format(max(0, n), f"0{_SAMPLE_DIGITS}x")


def trace_sample(spans: DataFrame, probability: float = C.TRACE_SAMPLING_PROBABILITY) -> DataFrame:
    """keep a share of traces, decided per trace id (60 bits of its hash), so
    a trace is kept or dropped whole and any engine decides alike. Spans without
    a trace id belong to no trace and are dropped at any probability."""
    return spans.where(F.substring(F.md5(F.col("trace_id")), 1, _SAMPLE_DIGITS)
                       < F.lit(_sample_limit(probability)))


def trace_sample_sql(source: str, probability: float = C.TRACE_SAMPLING_PROBABILITY) -> str:
    return (f"SELECT * FROM {source} WHERE substr(md5(trace_id), 1, {_SAMPLE_DIGITS}) "
            f"< '{_sample_limit(probability)}'")


# --------------------------------------------------------------------- logs --

_PARTS, _MARK = 6, "\x01"


def parse_log_lines(logs: DataFrame, col: str = "line") -> DataFrame:
    """Split a console line into time, thread, logger, trace id, span id
    and message; empty ids become null. ``parsed`` is false, and the parts null,
    for lines of another layout (stack traces) or without a valid time.

    The pattern runs once a line: it rewrites the line into its parts with a mark
    between, and the rest splits at the mark. (A line that holds the mark itself,
    a control character, counts as not parsed.)"""
    line = F.col(col)
    marked = F.regexp_replace(line, C.LOG_LINE_PATTERN, _MARK.join(f"${i + 1}" for i in range(_PARTS)))
    parts = F.when(F.instr(line, _MARK) == 0, F.split(marked, _MARK))
    split = logs.withColumn("_parts", parts).withColumn(
        "_ts", F.when(F.size("_parts") == _PARTS, F.try_to_timestamp(
            F.get("_parts", F.lit(0)), F.lit(C.LOG_TIME_FORMAT)).cast("timestamp_ntz")))
    good = F.col("_ts").isNotNull()
    part = lambda i: F.when(good, F.get("_parts", F.lit(i)))
    return split.withColumns({
        "ts": F.col("_ts"), "thread": part(1), "logger": part(2),
        "trace_id": F.nullif(part(3), F.lit("")), "span_id": F.nullif(part(4), F.lit("")),
        "message": part(5), "parsed": good}).drop("_parts", "_ts")


def line_trace_id(line: Column) -> Column:
    """The trace id of a console line alone; blank where there is none."""
    return F.coalesce(F.regexp_extract(line, C.LOG_TRACE_ID_PATTERN, 1), F.lit(""))


def extract_trace_id(logs: DataFrame, col: str = "line") -> DataFrame:
    """The log store's trace-id matcher (greedy prefix, lazy group)."""
    return logs.withColumn("trace_id", F.nullif(
        F.regexp_extract(F.col(col), C.TRACE_ID_MATCHER, 1), F.lit("")))


LABEL_KEYS = ["application", "host", "level"]


def label_string(df: DataFrame) -> Column:
    """X11: ``application=..,host=..,level=..``."""
    parts = []
    for i, k in enumerate(LABEL_KEYS):
        parts += [F.lit(("," if i else "") + k + "="), F.col(k)]
    return F.concat(*parts)


def parse_labels(labels: Column) -> Column:
    return F.str_to_map(labels, F.lit(","), F.lit("="))


def level_at_least(level: Column, minimum: str = C.MIN_LOG_LEVEL) -> Column:
    """rank by the fixed level order; unknown levels are dropped."""
    rank = F.array_position(F.array(*[F.lit(x) for x in C.LOG_LEVELS]), level)
    return rank >= F.lit(C.LOG_LEVELS.index(minimum) + 1)


def sort_by_time(logs: DataFrame, labels: list[str] = LABEL_KEYS,
                 num_partitions: int | None = None) -> DataFrame:
    """Each label set's records in time order. Range partitioning on
    (labels, ts, event_id) keeps partitions sorted and splits a hot label set."""
    from shopflow.plans.ordinal import ranged
    return ranged(logs, [*labels, "ts", "event_id"], num_partitions)


def position_in_label_set(logs: DataFrame, labels: list[str] = LABEL_KEYS) -> DataFrame:
    """O01, checkable form: the 1-based position of a record in its label set."""
    return position_within(logs, labels, ["ts", "event_id"])


def traces_to_logs(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """The log lines of each trace. Spans are first reduced to one row
    per trace, so the join emits one row per log line, never span x log pairs.
    Blank ids find no partner; a hot trace is a skewed key that AQE splits. (A
    blank span id becomes null rather than being compared: a comparison would be
    inferred for the log side too, and repeat the extraction there.)"""
    per_trace = (spans.withColumn("trace_id", F.nullif(F.col("trace_id"), F.lit("")))
                 .where(F.col("trace_id").isNotNull()).groupBy("trace_id").agg(
                     F.count(F.lit(1)).alias("n_spans"), F.min("ts").alias("trace_start")))
    return logs.join(per_trace, "trace_id")
