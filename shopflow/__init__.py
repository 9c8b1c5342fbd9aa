"""shopflow: the shop's order, catalogue, notification and telemetry jobs as
Spark DataFrame / Structured Streaming plans.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a streaming
query that writes through ``foreachBatch``); nothing is collected to the driver.
"""

__version__ = "0.1.0"
