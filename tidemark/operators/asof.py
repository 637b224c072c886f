"""As-of join: every fact with the version of its key that was valid at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

VERSION = "version"


def as_of_join(facts: DataFrame, versions: DataFrame, keys: tuple[str, ...], at: str, since: str, until: str,
               label: str = VERSION) -> DataFrame:
    """The facts with a struct `label` of the version (its columns but the keys) that holds at `at`, or null.

    A version holds from `since`, or ever since if that is null, to before `until`, or for good if that is null. Versions
    of a key should not overlap; where they do, the one that began last decides, and of those that began together the
    greatest. A fact with a null key or time has no version. Facts are kept as they are, repeated ones too.

    Facts and versions are merged in the order of key and time: range partitions cut also the facts of a hot key, the
    last version of each partition is carried into the later ones, and only these, one row per key and partition,
    are looked at together. No key is joined, so a key with a third of all facts is as good as any other.
    """
    others = [c for c in versions.columns if c not in keys]
    known = F.col(at).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    row = F.struct(*facts.columns)
    asked = facts.where(known).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(at).alias("_at"), F.lit(1).alias("_kind"),
        row.alias("_row"), F.xxhash64(*facts.columns).alias("_tie"))
    told = versions.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(since).alias("_at"), F.lit(0).alias("_kind"),
        F.struct(F.col(since).alias("began"), F.struct(*others).alias("of")).alias("_version"), F.lit(0).cast("bigint").alias("_tie"))
    k = [f"_k{i}" for i in range(len(keys))]
    merged = asked.unionByName(told, allowMissingColumns=True)
    # equal keys of the sort stay together, so the facts of one moment are told apart by their hash
    placed = written(merged.repartitionByRange(*k, "_at", "_kind", "_tie").withColumn("_part", F.spark_partition_id()),
                     "as-of")
    before = Window.partitionBy("_part", *k).orderBy("_at", "_kind", "_version").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    here = placed.withColumn("_here", F.last("_version", ignorenulls=True).over(before)).where("_kind = 1")
    # partitions of a key, in order, with the last version of those before
    ends = placed.groupBy("_part", *k).agg(F.max("_version").alias("_last"))
    earlier = Window.partitionBy(*k).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).where(
        "_carried is not null").drop("_last")
    found = here.join(carried, ["_part", *k], "left").withColumn("_of", F.coalesce("_here", "_carried")["of"])
    holds = F.col(f"_of.{until}").isNull() | (F.col("_at") < F.col(f"_of.{until}"))
    matched = found.select("_row.*", F.when(holds, F.col("_of")).alias(label))
    none = matched.schema[label].dataType
    return matched.unionByName(facts.where(~known).withColumn(label, F.lit(None).cast(none)))
