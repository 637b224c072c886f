"""An append-only landing with a commit log: its state as of a time, and what came between two times."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sinks.store import table_or_none

BATCH = ("stream", "batch_id")


def commit_batch(rows: DataFrame, root: str, stream: str, batch_id: int, at: dt.datetime | None = None) -> bool:
    """Land a batch of a stream and log it; returns whether it was new.

    The rows come first and count from the moment the log names them. A batch that is tried again before that replaces
    its own rows; one that is already logged is left alone with its time, so that a snapshot never changes afterwards.
    `at` is UTC, the current time by default.
    """
    spark = rows.sparkSession
    part = f"stream={stream}/batch_id={batch_id}"
    if table_or_none(spark, f"{root}/log/{part}") is not None:
        return False
    writer = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer(rows.drop(*BATCH)).parquet(f"{root}/data/{part}")
    stamp = (at or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%d %H:%M:%S.%f")
    counted = spark.read.parquet(f"{root}/data/{part}").agg(F.count(F.lit(1)).alias("rows"))
    writer(counted.withColumn("committed_at", F.lit(stamp).cast("timestamp"))).parquet(f"{root}/log/{part}")
    return True


def _instant(at: dt.datetime) -> Column:
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The log: stream, batch_id, committed_at and rows of every batch that counts."""
    return spark.read.parquet(f"{root}/log")


def _rows_of(spark: SparkSession, root: str, which: Column) -> DataFrame:
    """Rows of the logged batches that a condition on the log picks; the scan opens only their folders."""
    picked = commits(spark, root).where(which).select(*BATCH)
    return spark.read.parquet(f"{root}/data").join(picked, list(BATCH), "left_semi")


def as_of(spark: SparkSession, root: str, at: dt.datetime) -> DataFrame:
    """The rows committed up to and including a time."""
    return _rows_of(spark, root, F.col("committed_at") <= _instant(at))


def between(spark: SparkSession, root: str, after: dt.datetime, until: dt.datetime) -> DataFrame:
    """The rows by which the landing grew: committed later than `after` and up to `until`."""
    return _rows_of(spark, root, (F.col("committed_at") > _instant(after)) & (F.col("committed_at") <= _instant(until)))


def growth(spark: SparkSession, root: str, after: dt.datetime, until: dt.datetime, groups: tuple[str, ...],
           complete: Column) -> DataFrame:
    """Per group: rows before, rows after, their difference, and how many of the new rows are `complete`.

    One scan of the batches up to `until`, summed in every task. A group that is only in one snapshot counts as 0 in
    the other.
    """
    stamped = spark.read.parquet(f"{root}/data").join(
        commits(spark, root).where(F.col("committed_at") <= _instant(until)).select(*BATCH, "committed_at"), list(BATCH))
    new = F.col("committed_at") > _instant(after)
    return stamped.groupBy(*groups).agg(
        F.count_if(~new).alias("before"), F.count(F.lit(1)).alias("after"), F.count_if(new).alias("grown"),
        F.count_if(new & complete).alias("grown_complete"))
