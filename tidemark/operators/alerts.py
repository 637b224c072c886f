"""Dashboard series per minute and alert windows; the same plans serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.percentiles import exact_percentiles

# Alert thresholds and the look-back of dashboard series in seconds.
DLQ_DEPTH, P95_MS, DENIED_COUNT, TAMPER_COUNT = 100, 300, 10, 1
HOUR_S, DAY_S = 3_600, 86_400


def minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts.cast("timestamp"))


def look_back(log: DataFrame, as_of: str, seconds: int) -> DataFrame:
    """Rows of the `seconds` up to and including `as_of`: a plain range on `ts`, so that the scan can prune by it."""
    end = F.lit(as_of).cast(log.schema["ts"].dataType)
    start = end - F.make_dt_interval(secs=F.lit(seconds))
    return log.where((F.col("ts") > start) & (F.col("ts") <= end))


def p95_per_minute(log: DataFrame) -> DataFrame:
    """p95 of the request time per minute, oldest minutes first."""
    return exact_percentiles(log.withColumn("t", minute(F.col("ts"))), ["t"], "time_ms", {"p95": 0.95}).select(
        "t", "n", "p95").orderBy("t")


def count_per_minute(log: DataFrame, name: str) -> DataFrame:
    """Messages per minute, oldest minutes first."""
    return log.groupBy(minute(F.col("ts")).alias("t")).agg(F.count(F.lit(1)).alias(name)).orderBy("t")


def freshness_per_minute(metrics: DataFrame) -> DataFrame:
    """Largest freshness per minute, oldest minutes first."""
    return metrics.where("metric = 'cdc_freshness_seconds'").groupBy(minute(F.col("ts")).alias("t")).agg(
        F.max("value").alias("freshness_s")).orderBy("t")


def windowed(log: DataFrame, length: str, every: str | None, measure: Column, name: str) -> DataFrame:
    """A measure per sliding or tumbling window."""
    frame = F.window(F.col("ts").cast("timestamp"), length, every or length)
    return log.groupBy(frame.alias("w")).agg(measure.alias(name)).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), name)


def dlq_alert(log: DataFrame, length: str = "10 minutes", every: str = "5 minutes", limit: int = DLQ_DEPTH) -> DataFrame:
    """Messages in the last 10 minutes, looked at every 5; fires above the limit."""
    return windowed(log, length, every, F.count(F.lit(1)), "dlq_depth").withColumn(
        "fires", F.col("dlq_depth") > limit)


def p95_alert(log: DataFrame, length: str = "5 minutes", limit: int = P95_MS) -> DataFrame:
    """p95 per window; fires above the limit."""
    frame = F.window(F.col("ts").cast("timestamp"), length)
    rows = log.select(frame["start"].alias("window_start"), frame["end"].alias("window_end"), "time_ms")
    return exact_percentiles(rows, ["window_start", "window_end"], "time_ms", {"p95_ms": 0.95}).select(
        "window_start", "window_end", "p95_ms", (F.col("p95_ms") > limit).alias("fires"))


def p95_of_counts(values: DataFrame, value: str = "time_ms", n: str = "n", limit: int = P95_MS) -> DataFrame:
    """The same per window from counts of every value, as the window parts of a stream give them."""
    windows = ["window_start", "window_end"]
    return exact_percentiles(values, windows, value, {"p95_ms": 0.95}, weight=n).select(
        *windows, "p95_ms", (F.col("p95_ms") > limit).alias("fires"))


def denied_alert(audit: DataFrame, length: str = "5 minutes", limit: int = DENIED_COUNT) -> DataFrame:
    """Refused actions per window; fires above the limit."""
    return windowed(audit.where("error_code is not null"), length, None, F.count(F.lit(1)), "denied_count").withColumn(
        "fires", F.col("denied_count") > limit)


def tamper_alert(audit: DataFrame, names: tuple[str, ...], length: str = "5 minutes",
                 limit: int = TAMPER_COUNT) -> DataFrame:
    """Attempts to silence the audit trail per window; a single one fires."""
    return windowed(audit.where(F.col("event_name").isin(*names)), length, None, F.count(F.lit(1)),
                    "tripwire").withColumn("fires", F.col("tripwire") >= limit)
