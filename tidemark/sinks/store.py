"""Event store: an order and all its lines in one commit, a no-op on replay."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.session import LONG_JOB, settings, written_for

EVENT_COLUMNS = ("order_id", "external_order_ref", "source_system", "store_id", "region", "customer_ref", "channel",
                 "status", "reservation_id", "total_amount_minor", "currency", "correlation_id", "topic", "partition",
                 "offset", "timestamp", "value", "lines")


#: Buckets of the key index; a batch reads those of its own keys.
KEY_BUCKETS = 32

#: Columns of the key index, stated because a batch without keys leaves a folder without files.
KEY_INDEX = "source_system string, external_order_ref string, stream string, batch_id string, bucket string"


def table_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A Parquet table, or None if nothing was written there yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored_events(spark: SparkSession, path: str) -> DataFrame | None:
    """Committed events (an order with its lines per row), or None before the first commit."""
    return table_or_none(spark, path)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that owns a checkpoint: made with the checkpoint, and lost with it."""
    path = f"{checkpoint}/stream_id"
    known = table_or_none(spark, path)
    if known is None:
        spark.createDataFrame([(uuid.uuid4().hex,)], "id string").coalesce(1).write.parquet(path)
        known = spark.read.parquet(path)
    return known.first().id


def routed_messages(records: DataFrame) -> DataFrame:
    """Messages parsed, routed and numbered, for a scratch table; only those that may be stored keep their text."""
    routed = ingest.routed(ingest.parse_events(records))
    text = F.when(F.col("route") == "OK", F.col("value"))
    return routed.select(*EVENT_COLUMNS, "reason", "route").withColumn("value", text).withColumn(
        "message_no", F.monotonically_increasing_id())


def store_batch(records: DataFrame, path: str, batch_id: int, stream: str = "batch") -> None:
    """Parse, route and store one batch of messages of a stream.

    The unit of commit is one row per order with its lines nested, so both appear together. Batches are
    kept by stream and number: a batch that is retried replaces its own partition and ignores its own
    earlier attempt, and a stream with a new checkpoint, which counts from 0 again, touches no other's.
    The keys of the store are an index in hash buckets, of which only those of the batch are read. Messages are parsed
    once, into a scratch table that is emptied when the batch is committed, so that no batch has to fit into memory.
    Records that already lie in such a table (`routed_messages`) are not parsed again. What the store does not hold yet is
    found by keys and message numbers alone; only those messages are joined to their fields.
    Outcomes count STORED and REPLAY messages besides POISON and TOMBSTONE.
    """
    if "route" not in records.columns:
        with written_for(routed_messages(records), "routed") as routed:
            return store_batch(routed, path, batch_id, stream)
    spark = records.sparkSession
    own = (F.col("stream") == stream) & (F.col("batch_id") == str(batch_id))
    keys = list(ingest.BUSINESS_KEY)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("string")
    with settings(spark, LONG_JOB):
        good = records.where("route = 'OK'")
        index = table_or_none(spark, f"{path}/keys", KEY_INDEX)
        if index is None:
            _commit(ingest.first_events(good).select(*EVENT_COLUMNS), f"{path}/events", stream, batch_id)
        else:
            # at most KEY_BUCKETS values, which prune the folders of the index
            mine = [r[0] for r in good.select(bucket.alias("bucket")).distinct().collect()]
            firsts = ingest.first_events(good.select(*keys, *ingest.ARRIVAL, "message_no"))
            new = ingest.not_stored(firsts, index.where(F.col("bucket").isin(mine) & ~own).select(*keys))
            # written first, so that the join knows how few they are
            with written_for(new.select("message_no"), "new") as numbers:
                fresh = good.join(numbers, "message_no", "left_semi")
                _commit(fresh.select(*EVENT_COLUMNS), f"{path}/events", stream, batch_id)
        events = spark.read.parquet(f"{path}/events").where(own)
        _commit(events.select(*keys, bucket.alias("bucket")), f"{path}/keys", stream, batch_id, "bucket")
        poison = records.where("route = 'POISON'").select("topic", "partition", "offset", "reason")
        _commit(poison, f"{path}/poison", stream, batch_id)
        stored = events.agg(F.count(F.lit(1)).alias("n")).select(F.lit(ingest.STORED).alias("route"), "n")
        routes = records.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
        # messages that parse and are not stored are replays
        replays = routes.where("route = 'OK'").select("n").unionByName(stored.select((-F.col("n")).alias("n"))).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(ingest.REPLAY).alias("route"), "n")
        _commit(routes.where("route <> 'OK'").unionByName(stored).unionByName(replays), f"{path}/outcomes", stream,
                batch_id)


def _commit(df: DataFrame, path: str, stream: str, batch_id: int, *parts: str) -> None:
    """Replace the folder of one batch of one stream, split by `parts`; an empty result replaces it too."""
    (df.repartition(*parts) if parts else df).write.mode("overwrite").option("compression", "zstd").option(
        "partitionOverwriteMode", "static").partitionBy(*parts).parquet(f"{path}/stream={stream}/batch_id={batch_id}")


def oms_order(spark: SparkSession, path: str) -> DataFrame:
    """`oms_order` as a view of the committed events."""
    return ingest.order_rows(stored_events(spark, f"{path}/events"))


def oms_order_line(spark: SparkSession, path: str) -> DataFrame:
    """`oms_order_line` as a view of the committed events."""
    return ingest.line_rows(stored_events(spark, f"{path}/events"))
