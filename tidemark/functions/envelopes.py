"""Change-event envelopes: decode, validity, routing, object keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import dt_utc

# Fixed values.
OPS = ("c", "r", "u", "d")
OBJECT_KEY_PATTERN = (
    r"^region=[A-Z][A-Z]/table=oms_order(_line)?/dt=[0-9]{8}/"
    r"[A-Za-z0-9._]+-[0-9]+-[0-9]+-[0-9a-f-]{36}\.jsonl$"
)


def _parsed(df: DataFrame, value: str, schema: str) -> DataFrame:
    """The fields op, source, after and before of a message, prefixed by `_`.

    `inline` over a one-element array parses a message exactly once; as plain projected columns the
    parse would be repeated in every filter that is pushed below the projection.
    """
    parsed = F.from_json(F.col(value), schema)
    return df.select("*", F.inline(F.array(parsed)).alias("_op", "_source", "_after", "_before"))


def decode_header(df: DataFrame, value: str = "value") -> DataFrame:
    """Add op, table_name, source_ts_ms, after_json and before_json; images stay JSON text.

    One `from_json` reads the five fields in a single pass over the text. A field that does not
    parse is null, never an error.
    """
    schema = "op string, source struct<table:string,ts_ms:string>, after string, before string"
    return _parsed(df, value, schema).select(
        *df.columns,
        F.col("_op").alias("op"),
        F.col("_source.table").alias("table_name"),
        F.expr("try_cast(_source.ts_ms as bigint)").alias("source_ts_ms"),
        F.col("_after").alias("after_json"),
        F.col("_before").alias("before_json"),
    )


def decode_images(df: DataFrame, fields: Sequence[str], value: str = "value",
                  before: Sequence[str] | None = None) -> DataFrame:
    """Add op, table_name, source_ts_ms and the `after` and `before` images as structs of text.

    Only the named image fields are read, so the JSON is parsed once and nothing else is kept. `before` names those of
    the image before the change, if they are others.
    """
    image = lambda names: ",".join(f"{name}:string" for name in names)
    schema = (f"op string, source struct<table:string,ts_ms:string>, after struct<{image(fields)}>, "
              f"before struct<{image(before or fields)}>")
    return _parsed(df, value, schema).select(
        *[c for c in df.columns if c != value],
        F.col("_op").alias("op"),
        F.col("_source.table").alias("table_name"),
        F.expr("try_cast(_source.ts_ms as bigint)").alias("source_ts_ms"),
        F.col("_after").alias("after"),
        F.col("_before").alias("before"),
    )


def is_valid(after: Column, before: Column) -> Column:
    """A usable change: known op, at least one image, commit time and table present."""
    return (
        F.col("op").isin(*OPS)
        & (after.isNotNull() | before.isNotNull())
        & F.col("source_ts_ms").isNotNull()
        & F.col("table_name").isNotNull()
    )


def routing_columns(df: DataFrame, value: str = "value") -> DataFrame:
    """Add region (after image, then before image, then ''), table, source_ts_ms and dt for landing.

    The names are prefixed by `r_` so that they never hide a column of the record.
    """
    image = "struct<region:string>"
    schema = f"op string, source struct<table:string,ts_ms:string>, after {image}, before {image}"
    ts = F.expr("try_cast(_source.ts_ms as bigint)")
    blank_to_null = lambda c: F.when(c != "", c)
    return _parsed(df, value, schema).select(
        *df.columns,
        F.coalesce(blank_to_null(F.col("_after.region")), F.col("_before.region"), F.lit("")).alias("r_region"),
        F.coalesce(F.col("_source.table"), F.lit("")).alias("r_table"),
        F.col("_op").alias("r_op"),
        ts.alias("r_ts_ms"),
        dt_utc(ts).alias("r_dt"),
    )


def object_key(region: Column, table: Column, dt: Column, topic: Column, partition: Column, offset: Column,
               attempt: str) -> Column:
    """`region=…/table=…/dt=…/<topic>-<partition>-<offset>-<uuid>.jsonl`.

    The uuid is derived from the record position and the landing attempt, so a retried task writes
    the same key and a new landing attempt writes a new one.
    """
    position = F.concat_ws("-", topic, partition.cast("string"), offset.cast("string"))
    digest = F.md5(F.concat(position, F.lit("#" + attempt)))
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4),
                       F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    return F.concat(F.lit("region="), region, F.lit("/table="), table, F.lit("/dt="), dt, F.lit("/"),
                    position, F.lit("-"), uuid, F.lit(".jsonl"))
