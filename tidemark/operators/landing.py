"""Change messages to bronze: tombstones, routing rejects, object keys, landing summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.envelopes import OBJECT_KEY_PATTERN, object_key, routing_columns
from tidemark.functions.regions import REGIONS

TOMBSTONE = "tombstone"
BRONZE_COLUMNS = ("topic", "partition", "offset", "position", "value", "object_key", "region", "table", "dt")


def route(messages: DataFrame, allowed: Sequence[str] = REGIONS) -> DataFrame:
    """Messages without tombstones, with routing columns and `reject`, the reason they may not land."""
    live = routing_columns(messages.where(F.col("value").isNotNull()))
    missing = (F.trim("r_region") == "") | (F.trim("r_table") == "") | F.col("r_ts_ms").isNull()
    reject = (F.when(missing, "missing routing fields (region/table/sourceTsMs)")
              .when(~F.col("r_region").isin(*allowed),
                    F.concat(F.lit("region="), F.col("r_region"), F.lit(" is not in the allowed set"))))
    return live.withColumn("reject", reject)


def not_landing(messages: DataFrame, allowed: Sequence[str] = REGIONS) -> DataFrame:
    """Every message that does not land, with its reason: rejects, and tombstones (null values)."""
    tombstones = messages.where(F.col("value").isNull()).withColumn("reject", F.lit(TOMBSTONE))
    rejects = route(messages, allowed).where("reject is not null")
    columns = ("topic", "partition", "offset", "value", "reject")
    return rejects.select(*columns).unionByName(tombstones.select(*columns))


def strict(routed: DataFrame) -> DataFrame:
    """Fail the job on the first record that may not land; otherwise pass the rows on."""
    text = F.concat(F.lit("BRONZE-REJECT "), F.col("reject"), F.lit(" topic="), F.col("topic"), F.lit(" partition="),
                    F.col("partition").cast("string"), F.lit(" offset="), F.col("offset").cast("string"))
    checked = F.when(F.col("reject").isNotNull(), F.raise_error(text)).otherwise(F.col("value"))
    return routed.withColumn("value", checked).drop("reject")


def bronze_rows(routed: DataFrame, attempt: str) -> DataFrame:
    """Landing rows: the raw value verbatim, message coordinates, object key and partition columns."""
    position = F.col("position") if "position" in routed.columns else F.lit(0)
    key = object_key(F.col("r_region"), F.col("r_table"), F.col("r_dt"), F.col("topic"), F.col("partition"),
                     F.col("offset"), attempt)
    return routed.select(
        "topic", "partition", "offset", position.cast("int").alias("position"), "value", key.alias("object_key"),
        F.col("r_region").alias("region"), F.col("r_table").alias("table"), F.col("r_dt").alias("dt"))


def landing_summary(bronze: DataFrame, ts_ms: str = "ts_ms") -> DataFrame:
    """Records and first and last commit time per region, table and dt."""
    return bronze.groupBy("region", "table", "dt").agg(
        F.count(F.lit(1)).alias("records"), F.min(ts_ms).alias("first_ts_ms"), F.max(ts_ms).alias("last_ts_ms"))


def is_object_key(key: Column) -> Column:
    """Whether an object's name keeps the naming contract."""
    return key.rlike(OBJECT_KEY_PATTERN)


def bad_object_keys(bronze: DataFrame, key: str = "object_key") -> DataFrame:
    """Records whose object breaks the naming contract. A scan's `object_key` is the name of the file it read."""
    return bronze.where(~is_object_key(F.col(key)))


def duplicate_offsets(bronze: DataFrame) -> DataFrame:
    """Message positions that landed more than once."""
    return bronze.groupBy("topic", "partition", "offset").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def residency_violations(bronze: DataFrame) -> DataFrame:
    """Per region: records, records with a clear CN reference, and CN records with a masked one."""
    value = F.col("value")
    return bronze.groupBy("region").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(value.contains("cust-cn-")).alias("plaintext"),
        F.count_if((F.col("region") == "CN") & value.contains('"customer_ref":"msk-')).alias("masked"))
