"""Broadcasts with a proven size bound.

File-size estimates of compressed columnar data can be far below the in-memory
size (sequential keys compress to almost nothing), so the session does not
broadcast on estimates (``autoBroadcastJoinThreshold = -1``). A data-dependent
side is broadcast only after its bytes were measured on its source: rows times
the width of the fixed columns, plus the real lengths of the texts. Above the
limit the join stays a shuffled join, with AQE skew splitting. Fixed dimensions
are broadcast directly where they are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES_CONF = "shopflow.broadcast.maxBytes"
DEFAULT_MAX_BYTES = 64 << 20
#: A row's overhead in a hash relation, and a fixed-size column's share.
ROW_BYTES, COLUMN_BYTES = 32, 8


def broadcast_max_bytes(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_BYTES_CONF, str(DEFAULT_MAX_BYTES)))


def side_bytes(side: DataFrame) -> int:
    """Bytes that the rows of ``side`` take in memory, about."""
    fixed = ROW_BYTES
    texts = []
    for f in side.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            texts.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)))
            fixed += 2 * COLUMN_BYTES
        else:
            fixed += COLUMN_BYTES
    width = F.lit(fixed).cast("long")
    for t in texts:
        width = width + t
    return side.agg(F.sum(width).alias("b")).first()["b"] or 0


def counted_broadcast(side: DataFrame, bound_from: DataFrame | None = None,
                      at_least: DataFrame | None = None) -> DataFrame:
    """``side`` marked for broadcast when ``bound_from`` (default: ``side``), whose
    rows are at least the side's, measures at most the limit. ``at_least``: a cheap part
    of the side; where that is over the limit already, the side itself is not measured."""
    if at_least is not None and side_bytes(at_least) > broadcast_max_bytes(side):
        return side
    n = side_bytes(bound_from if bound_from is not None else side)
    return F.broadcast(side) if n <= broadcast_max_bytes(side) else side
