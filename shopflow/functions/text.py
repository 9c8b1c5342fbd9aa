"""Column expressions for keys, texts and markup (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopflow.functions.constants import HTML_ENTITIES


def uuid_from_key(key: Column) -> Column:
    """UUID-shaped text (8-4-4-4-12 hex) from the md5 of a key.

    Deterministic, so a replayed batch, a re-planned query and both sinks of
    one batch get the same order number for the same request. A null key has no
    number (null), so keyless requests never share one.
    """
    h = F.md5(key)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    out = parts[0]
    for part in parts[1:]:
        out = F.concat(out, F.lit("-"), part)
    return out


def uuid_from_key_sql(key: str) -> str:
    h = f"md5({key})"
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4)"
            f" || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")


def html_escape(c: Column) -> Column:
    """Escape text for an HTML body; '&' is replaced first."""
    out = c
    for raw, entity in HTML_ENTITIES:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def html_escape_sql(expr: str) -> str:
    out = expr
    for raw, entity in HTML_ENTITIES:
        raw_sql = raw.replace("'", "''")
        out = f"replace({out}, '{raw_sql}', '{entity}')"
    return out
