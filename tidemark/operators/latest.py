"""Latest row per key, delete-aware, in two formulations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Total order of changes of one key: commit time, then message coordinates, then line in the object.
CHANGE_ORDER = ("source_ts_ms", "partition", "offset", "position")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = CHANGE_ORDER,
                   deleted: Column | None = None) -> DataFrame:
    """Keep the last row of each key by `order`, then drop keys whose last row is a delete.

    `row_number() = 1` lets the optimizer prune to one row per key and task before the shuffle, so a
    key that holds most of the rows sends at most one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    out = df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return out if deleted is None else out.where(~deleted)


def latest_per_key_by_max(df: DataFrame, keys: Sequence[str], order: Sequence[str] = CHANGE_ORDER,
                          deleted: Column | None = None) -> DataFrame:
    """The same result as an aggregate (`max_by`) with partial aggregation before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[F.col(c) for c in order])
    out = df.groupBy(*keys).agg(F.max_by(row, rank).alias("_row")).select("_row.*")
    return out if deleted is None else out.where(~deleted)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key by `order` (first wins)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
