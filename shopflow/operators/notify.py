"""Order-placed event -> notification message (recipient, subject, HTML body)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.functions import constants as C
from shopflow.functions.text import html_escape, html_escape_sql

# The message of our own wording, with three escaped slots in between.
BODY_PARTS = [
    "<html><body><h2>We have your order</h2><p>Dear ",
    " ",
    ",</p><p>your order reached us and is now being prepared.</p><p>Its number is <b>",
    "</b>. Please quote it when you write to us.</p></body></html>",
]
SENDER = "orders@shop.example.com"


def render_notifications(events: DataFrame, sender: str = SENDER) -> DataFrame:
    """One message per event; the three variables are HTML-escaped."""
    first, last, number = (html_escape(F.col(c)) for c in ("first_name", "last_name", "order_number"))
    body = F.concat(F.lit(BODY_PARTS[0]), first, F.lit(BODY_PARTS[1]), last,
                    F.lit(BODY_PARTS[2]), number, F.lit(BODY_PARTS[3]))
    return events.select(
        "order_number",
        F.lit(sender).alias("from_email"), F.col("email").alias("to_email"),
        F.concat(F.lit(C.SUBJECT_PREFIX), F.col("order_number")).alias("subject"),
        body.alias("html_body"))


def render_sql(source: str) -> str:
    first, last, number = (html_escape_sql(c) for c in ("first_name", "last_name", "order_number"))
    parts = [p.replace("'", "''") for p in BODY_PARTS]
    body = (f"'{parts[0]}' || {first} || '{parts[1]}' || {last} || '{parts[2]}' || {number}"
            f" || '{parts[3]}'")
    return (f"SELECT order_number, '{SENDER}' AS from_email, email AS to_email, "
            f"'{C.SUBJECT_PREFIX}' || order_number AS subject, {body} AS html_body FROM {source}")
