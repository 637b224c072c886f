"""Streams: order-event ingest, bronze landing, freshness, window counts.

Each takes a streaming frame in the message shape (topic, partition, offset, timestamp, value), so the
source can be a topic or files. A checkpoint folder keeps the offsets; a failed write fails its batch,
which is then repeated.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.functions.dates import freshness_seconds
from tidemark.operators import freshness, landing
from tidemark.sinks.store import store_batch, stream_id
from tidemark.sinks.objects import land_objects
from tidemark.sinks.tables import append_metric, land


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def ingest_orders(messages: DataFrame, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Order events into the event store: at least once, stored once per business key."""
    owner = stream_id(messages.sparkSession, checkpoint)
    return _start(messages.writeStream.foreachBatch(lambda df, i: store_batch(df, store, i, owner)), checkpoint, once)


def land_bronze(messages: DataFrame, root: str, checkpoint: str, allowed=None, strict: bool = True,
                objects: bool = False, once: bool = False) -> StreamingQuery:
    """Change messages into bronze by region, table and commit day.

    There is no watermark: a late record lands under the day of its own commit. In strict mode a
    record that may not land stops the stream; otherwise it is for `keep_rejects` to take. Every batch is a landing of
    its own, named by stream and number, so a retried batch counts once and batch landings stay visible beside it.
    `objects` lands JSON-lines objects instead of Parquet.
    """
    routed = landing.route(messages, *([allowed] if allowed else []))
    clean = landing.strict(routed) if strict else routed.where("reject is null").drop("reject")
    rows, owner = landing.bronze_rows(clean, "stream"), stream_id(messages.sparkSession, checkpoint)
    sink = land_objects if objects else land
    return _start(rows.writeStream.foreachBatch(lambda df, i: sink(df, root, f"{owner}-{i}")), checkpoint, once)


def keep_rejects(messages: DataFrame, path: str, checkpoint: str, allowed=None, once: bool = False) -> StreamingQuery:
    """The messages that `land_bronze` leaves out when not strict, with the reason; tombstones too.

    It reads the same source with its own offsets, so each message ends in bronze or here, exactly once.
    """
    rows = landing.not_landing(messages, *([allowed] if allowed else []))
    return _start(rows.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint, once)


def freshness_metrics(messages: DataFrame, metrics: str, checkpoint: str, clock_ms: Callable[[], int] | None = None,
                      once: bool = False) -> StreamingQuery:
    """One freshness line per batch: the age of its newest commit when the batch is published."""
    clock = clock_ms or (lambda: int(time.time() * 1000))
    routed = landing.route(messages).select("r_ts_ms")

    def emit(batch: DataFrame, _batch_id: int) -> None:
        newest = batch.agg(F.max("r_ts_ms").alias("ts")).where("ts is not null")
        append_metric(newest.select(
            F.lit(freshness.METRIC).alias("metric"),
            freshness_seconds(F.col("ts"), F.lit(clock()).cast("bigint")).alias("value"),
            F.lit(freshness.PIPELINE).alias("pipeline")), metrics)

    return _start(routed.writeStream.foreachBatch(emit), checkpoint, once)


class IdleHeartbeat(StreamingQueryListener):
    """While the source is silent, report the growing age of the last published commit.

    `last_ts_ms` is asked for the newest published commit time and `emit` gets the age in seconds.
    Nothing is reported before the first publication.
    """

    def __init__(self, last_ts_ms: Callable[[], int | None], emit: Callable[[int], None],
                 clock_ms: Callable[[], int] | None = None, every_ms: int = freshness.HEARTBEAT_S * 1000):
        self._last, self._emit = last_ts_ms, emit
        self._clock = clock_ms or (lambda: int(time.time() * 1000))
        self._every, self._sent = every_ms, None

    def beat(self) -> None:
        now, last = self._clock(), self._last()
        if last is None or (self._sent is not None and now - self._sent < self._every):
            return
        self._sent = now
        self._emit(max(0, (now - last) // 1000))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._sent = None

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.beat()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def window_counts(log: DataFrame, out: str, checkpoint: str, length: str, every: str | None = None,
                  name: str = "n", once: bool = False) -> StreamingQuery:
    """Counts per tumbling or sliding window, kept up to date without state or watermark; see `window_parts`."""
    return window_parts(log, out, checkpoint, length, every, name, once=once)


def window_parts(log: DataFrame, out: str, checkpoint: str, length: str, every: str | None = None, name: str = "n",
                 value: str | None = None, once: bool = False) -> StreamingQuery:
    """Parts of window measures that can be merged: counts, or with `value` the count of every value of that column.

    Every batch writes the parts of its own rows under its stream and number, so a repeated batch replaces itself. The
    stream's id lives with its checkpoint; a stream that starts anew reads its source from the beginning, so it takes the
    place of the stream before it: `current_windows` and `window_values` read the stream that started last. A row may
    come as late as it likes.
    """
    spark = log.sparkSession
    owner = stream_id(spark, checkpoint)
    take_over(spark, out, owner)
    columns = [F.col(value)] if value else []

    def write(batch: DataFrame, batch_id: int) -> None:
        frame = F.window(F.col("ts").cast("timestamp"), length, every or length).alias("w")
        counts = batch.groupBy(frame, *columns).agg(F.count(F.lit(1)).alias(name))
        counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *columns, name).write.mode(
            "overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/parts/stream={owner}/batch_id={batch_id}")

    return _start(log.writeStream.foreachBatch(write), checkpoint, once)


def take_over(spark: SparkSession, out: str, owner: str) -> None:
    """Note that a stream writes here from now on, unless it did so last."""
    try:
        started = spark.read.schema("stream string, n bigint").json(f"{out}/streams")
        last = started.orderBy(F.desc("n")).first()
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None or last.stream != owner:
        row = spark.createDataFrame([(owner, (last.n if last else 0) + 1)], "stream string, n bigint")
        row.coalesce(1).write.mode("append").json(f"{out}/streams")


def _parts(spark: SparkSession, out: str) -> DataFrame:
    owner = spark.read.schema("stream string, n bigint").json(f"{out}/streams").orderBy(F.desc("n")).first().stream
    return spark.read.option("basePath", f"{out}/parts").parquet(f"{out}/parts/stream={owner}").drop("stream", "batch_id")


def current_windows(spark: SparkSession, out: str) -> DataFrame:
    """The count of every window written by `window_counts`: the sum over the batches of the current stream."""
    parts = _parts(spark, out)
    values = [c for c in parts.columns if c not in ("window_start", "window_end")]
    return parts.groupBy("window_start", "window_end").agg(*[F.sum(c).alias(c) for c in values])


def window_values(spark: SparkSession, out: str, value: str, name: str = "n") -> DataFrame:
    """How often every value came in every window, from the parts of `window_parts` with that `value`."""
    return _parts(spark, out).groupBy("window_start", "window_end", value).agg(F.sum(name).alias(name))
