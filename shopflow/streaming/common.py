"""What the streaming jobs share: state store, batch bounds, triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
# Commits upload what changed; counting all keys on every write is left out. All stores of an
# executor share one bound: else each keeps up to 64 MB of written keys off the heap, so that
# an executor's memory grows with its partitions and keys.
ROCKSDB_CONF = {
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A micro-batch takes files of so many bytes or so many topic records at most, unless the
#: reader options say otherwise; history is read batch by batch. (Every batch opens and
#: commits all state partitions: a bound by files would make their number grow with both.)
BYTES_PER_BATCH, RECORDS_PER_BATCH = str(16 << 30), "5000000"
ALL_SO_FAR = {"availableNow": True}


def bounded(fmt: str, options: dict[str, str] | None) -> dict[str, str]:
    """Reader options with a finite batch."""
    options = options or {}
    if fmt == "kafka":
        return {"maxOffsetsPerTrigger": RECORDS_PER_BATCH} | options
    if any(o.lower() in ("maxfilespertrigger", "maxbytespertrigger") for o in options):
        return options                                       # a reader takes one of the two
    return {"maxBytesPerTrigger": BYTES_PER_BATCH} | options


def topic_reader(spark: SparkSession, path: str, schema: str, fmt: str,
                 options: dict[str, str] | None) -> DataFrame:
    """A topic: Kafka (``options`` name servers and subscription) or a folder of
    files with the given columns."""
    reader = spark.readStream.format(fmt).options(**bounded(fmt, options))
    return reader.load() if fmt == "kafka" else reader.schema(schema).load(path)


def once(feed: DataFrame, key: str, arrived: str, window: str | None) -> DataFrame:
    """The first delivery of each key, across micro-batches. The state forgets a key
    after ``window``; None keeps all keys (RocksDB, spread by the key's hash)."""
    if window is None:
        return feed.dropDuplicates([key]).drop(key, arrived)
    return feed.withWatermark(arrived, window).dropDuplicatesWithinWatermark([key]).drop(key, arrived)


def start(writer: DataStreamWriter, checkpoint: str, trigger: dict | None = None,
          ) -> StreamingQuery:
    """Starts the query; with the default trigger it is waited for, with another
    one (``{"processingTime": "1 second"}``) it keeps running and is returned."""
    trigger = trigger or ALL_SO_FAR
    query = writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if trigger == ALL_SO_FAR:
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return query


def use_rocksdb(spark: SparkSession) -> None:
    """State off the heap, unless the session chose another store itself. (Asked without a
    default of ours, a session that names none answers with Spark's, which is on the heap.)"""
    if spark.conf.get(STATE_STORE_CONF).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE_CONF, ROCKSDB)
    for key, value in ROCKSDB_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
