"""Product catalogue: full scan, response projection, build from requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.functions.text import uuid_from_key

PRODUCT_COLUMNS = ["id", "name", "description", "price"]


def product_response(products: DataFrame) -> DataFrame:
    """The four response fields (the scan is pruned to them)."""
    return products.select(*PRODUCT_COLUMNS)


def product_id(request_id) -> F.Column:
    """The store-assigned id: UUID-shaped, derived from the request key so a
    replayed batch assigns the same ids."""
    return uuid_from_key(F.concat(F.lit("product:"), request_id))


def build_products(decoded: DataFrame) -> DataFrame:
    """Request -> product; a client-side id is never taken over. Bodies that
    did not parse and requests without a key make no product."""
    usable = ~F.col("rejected") & F.col("request_id").isNotNull()
    return decoded.where(usable).select(product_id(F.col("request_id")).alias("id"),
                          "name", "description", "price")
