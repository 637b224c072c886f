"""Who did what: the audit questions over columns and over JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
HOME_REGION = "ap-southeast-1"
RETENTION_DAYS = {"app": 30, "events": 30, "metrics": 30, "audit": 180}
TAMPER_EVENTS = ("StopLogging", "DeleteTrail")

JSON_FIELDS = {
    "event_id": "eventId", "event_source": "eventSource", "event_name": "eventName", "resource_name": "resourceName",
    "region": "acsRegion", "source_ip": "sourceIpAddress", "error_code": "errorCode",
}


def key_actions(audit: DataFrame, start: str, end: str) -> DataFrame:
    """Q1: who touched keys in a window, oldest first."""
    when = F.col("event_time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return audit.where(F.col("event_source").like("%kms%") & when).select(
        "event_time", "identity_type", "identity_name", "event_name", "resource_name", "source_ip"
    ).orderBy("event_time")


def denied(audit: DataFrame) -> DataFrame:
    """Q2: refused actions, newest first."""
    return audit.where(F.col("error_code").isNotNull()).select(
        "event_time", "identity_name", "event_name", "source_ip", "user_agent", "error_code"
    ).orderBy(F.col("event_time").desc())


def policy_changes(audit: DataFrame) -> DataFrame:
    """Q3: bucket-policy changes, newest first."""
    return audit.where(F.col("event_name").like("%BucketPolicy%")).select(
        "event_time", "identity_name", "event_name", "resource_name", "request_params"
    ).orderBy(F.col("event_time").desc())


def by_identity(audit: DataFrame, name: str) -> DataFrame:
    """Q4: everything one identity did, newest first."""
    return audit.where(F.col("identity_name") == name).select(
        "event_time", "event_name", "resource_type", "resource_name", "source_ip", "error_code"
    ).orderBy(F.col("event_time").desc())


def other_region(audit: DataFrame, home: str = HOME_REGION) -> DataFrame:
    """Q5: actions outside the home region, newest first."""
    return audit.where(F.col("region") != home).select(
        "event_time", "identity_name", "event_name", "region", "source_ip").orderBy(F.col("event_time").desc())


def as_json(audit: DataFrame) -> DataFrame:
    """Audit rows as (event_time, event) with the payload as one JSON text."""
    body = F.struct(
        *[F.col(c).alias(f) for c, f in JSON_FIELDS.items()],
        F.struct(F.col("identity_type").alias("type"), F.col("identity_name").alias("userName")).alias("userIdentity"))
    return audit.select("event_time", F.to_json(body).alias("event"))


def json_query(payloads: DataFrame, condition, fields: dict[str, str], limit: int | None = None) -> DataFrame:
    """Any of the questions over payloads: extract fields by path, newest first; all rows unless a limit is given."""
    out = payloads.where(condition).select(
        "event_time", *[F.get_json_object("event", path).alias(name) for name, path in fields.items()])
    out = out.orderBy(F.col("event_time").desc(), *[F.col(c) for c in fields])
    return out if limit is None else out.limit(limit)


def path(field: str):
    """A field of the payload by its JSON path."""
    return F.get_json_object("event", f"$.{field}")


def retained(logs: DataFrame, as_of: str, days: dict[str, int] = RETENTION_DAYS) -> DataFrame:
    """Rows (store, event_time, …) inside the retention of their store; a store without one keeps all."""
    keep = F.lit(None).cast("int")
    for store, n in days.items():
        keep = F.when(F.col("store") == store, n).otherwise(keep)
    oldest = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(keep)
    return logs.where(keep.isNull() | (F.col("event_time") >= oldest))
