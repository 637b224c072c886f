"""Exact percentiles that stay small: the values are counted before they meet, and no task sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_path

_SLOT_BITS = 33


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, wanted: dict[str, float],
                      weight: str | None = None) -> DataFrame:
    """Interpolated percentiles of `value` per group, with n and max. A row counts once, or `weight` times.

    Equal values are counted first, spread by (group, value). The counts are then range-partitioned by
    (group, value) and written with their partition, so that later reads see the same partitions even
    when executors are lost. Sums per partition tell the rank at which each begins; a running sum within
    a partition places every value, and only the values at the wanted ranks are picked.
    """
    path = scratch_path(df.sparkSession, "percentiles")
    group = F.struct(*groups).alias("_group")
    counted = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_value")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    counted.repartitionByRange("_group", "_value").sortWithinPartitions("_group", "_value").withColumn(
        "_part", F.shiftright(F.monotonically_increasing_id(), _SLOT_BITS)).write.parquet(path)
    placed = df.sparkSession.read.parquet(path)

    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_group", "_part").agg(F.sum("_n").alias("_in")).select(
        "_group", "_part", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_in").over(Window.partitionBy("_group")).alias("_total"))
    inside = Window.partitionBy("_part", "_group").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_within", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        parts, ["_group", "_part"]).withColumn("_start", F.col("_before") + F.col("_within"))

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_n")), F.col("_value")))

    picked = []
    for name, p in wanted.items():
        place = (F.col("_total") - 1) * F.lit(p)
        picked += [at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}")]
    found = ranked.groupBy("_group").agg(
        F.max("_total").alias("n"), F.max("_value").alias("max_value"), *picked)
    share = lambda p: (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
    return found.select("_group.*", "n", "max_value", *[
        (F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * share(p)).cast("double").alias(name)
        for name, p in wanted.items()])
