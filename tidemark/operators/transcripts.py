"""Probe transcripts: replay pairing, violations, histograms, fault windows, recovery."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.percentiles import exact_percentiles

# Fixed values.
HANG_MS = 30_000
DUPLICATE = "DUPLICATE"
BAD_DAY_SHARE = 10


@dataclass(frozen=True)
class Window:
    """A declared fault window; both ends belong to it."""

    start: str
    end: str
    name: str = "affected"


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def inside(ts: Column, windows: Sequence[Window]) -> Column:
    """True inside any of the declared windows (a short list from the command line, so literals)."""
    out = F.lit(False)
    for w in windows:
        out = out | ts.between(_ts(w.start), _ts(w.end))
    return out


def window_tag(ts: Column, window: Window) -> Column:
    """before, affected or after."""
    return F.when(ts < _ts(window.start), "before").when(ts > _ts(window.end), "after").otherwise(window.name)


def tag_by_table(rows: DataFrame, windows: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with the name of every declared window (name, start, end) they fall into, null outside.

    For many windows: both sides meet on the day, so this is an equi-join with a range filter.
    """
    days = F.sequence(F.to_date("start"), F.to_date("end"))
    spread = windows.select("name", "start", "end", F.explode(days).alias("_day"))
    on = (F.to_date(F.col(ts)) == F.col("_day")) & F.col(ts).between(F.col("start"), F.col("end"))
    return rows.join(spread, on, "left").drop("start", "end", "_day")


def paired_replays(transcript: DataFrame) -> DataFrame:
    """Replays with the status and order id of the first original probe of the same reference."""
    first = transcript.where("kind = 'probe'").groupBy("ref").agg(
        F.min_by(F.struct("status", "order_id"), F.struct("ts", "n")).alias("_o"))
    originals = first.select("ref", F.col("_o.status").alias("o_status"), F.col("_o.order_id").alias("o_order_id"),
                             F.lit(True).alias("paired"))
    return transcript.where("kind = 'replay'").join(originals, "ref", "left").withColumn(
        "paired", F.coalesce("paired", F.lit(False)))


def replay_class() -> Column:
    """Outcome of a paired replay: duplicate_commit, id_mismatch, ok_409, guard_422, re_executed, other, unpaired."""
    status, original = F.col("status"), F.col("o_status")
    mismatch = (
        (F.col("error_code") == DUPLICATE) & (original == 201) & F.col("order_id").isNotNull()
        & F.col("o_order_id").isNotNull() & (F.col("order_id") != F.col("o_order_id"))
    )
    return (
        F.when(~F.col("paired"), "unpaired")
        .when((status == 201) & (original == 201), "duplicate_commit")
        .when(status == 201, "re_executed")
        .when((status == 409) & F.coalesce(mismatch, F.lit(False)), "id_mismatch")
        .when(status == 409, "ok_409")
        .when(status == 422, "guard_422")
        .otherwise("other")
    )


def replay_outcomes(transcript: DataFrame) -> DataFrame:
    """Replays per outcome class."""
    return paired_replays(transcript).groupBy(replay_class().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def violations(transcript: DataFrame, allowed: Sequence[Window] = (), hang_ms: int = HANG_MS) -> DataFrame:
    """One row per violation: HANG, STATUS-0 outside a declared window, and broken replays."""
    columns = ("rule", "ts", "n", "kind", "ref")
    hangs = transcript.where(F.col("time_ms") > hang_ms).withColumn("rule", F.lit("HANG"))
    network = transcript.where((F.col("status") == 0) & ~inside(F.col("ts"), allowed)).withColumn(
        "rule", F.lit("STATUS-0"))
    broken = {"duplicate_commit": "DUPLICATE-COMMIT", "id_mismatch": "ID-MISMATCH", "unpaired": "UNPAIRED-REPLAY"}
    replays = paired_replays(transcript).withColumn("_c", replay_class()).where(F.col("_c").isin(*broken))
    rule = F.lit(None).cast("string")
    for name, label in broken.items():
        rule = F.when(F.col("_c") == name, label).otherwise(rule)
    replays = replays.withColumn("rule", rule)
    return hangs.select(*columns).unionByName(network.select(*columns)).unionByName(replays.select(*columns))


RULES = ("HANG", "STATUS-0", "DUPLICATE-COMMIT", "ID-MISMATCH", "UNPAIRED-REPLAY", "MALFORMED")


def verdict(parsed: DataFrame, allowed: Sequence[Window] = (), hang_ms: int = HANG_MS) -> DataFrame:
    """One row for a whole transcript: lines, the violations of each rule, lines that do not parse among them, passed."""
    good = parsed.where("NOT malformed").drop("malformed")
    rows = violations(good, allowed, hang_ms).select("rule", F.lit(0).alias("line")).unionByName(
        parsed.select(F.when(F.col("malformed"), "MALFORMED").alias("rule"), F.lit(1).alias("line")))
    name = lambda rule: rule.lower().replace("-", "_")
    counted = rows.agg(F.coalesce(F.sum("line"), F.lit(0)).cast("bigint").alias("lines"),
                       *[F.count_if(F.col("rule") == r).alias(name(r)) for r in RULES])
    return counted.withColumn("passed", sum(F.col(name(r)) for r in RULES) == 0)


def status_histogram(transcript: DataFrame) -> DataFrame:
    return transcript.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def error_histogram(transcript: DataFrame) -> DataFrame:
    return transcript.where("error_code is not null").groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


def durations(transcript: DataFrame) -> DataFrame:
    """n, max and exact median of all requests and of the 201 responses."""
    views = F.explode(F.when(F.col("status") == 201, F.array(F.lit("all"), F.lit("201-only")))
                      .otherwise(F.array(F.lit("all"))))
    return exact_percentiles(transcript.select(views.alias("view"), "time_ms"), ["view"], "time_ms", {"median": 0.5})


def window_split(transcript: DataFrame, window: Window) -> DataFrame:
    """Status histogram before, inside and after a fault window."""
    return transcript.groupBy(window_tag(F.col("ts"), window).alias("segment"), "status").agg(
        F.count(F.lit(1)).alias("n"))


def recovery(transcript: DataFrame, healed: str) -> DataFrame:
    """First 201 probe after the heal and the whole seconds it took; nulls when there is none."""
    ok = (F.col("kind") == "probe") & (F.col("status") == 201) & (F.col("ts") > _ts(healed))
    first = transcript.where(ok).agg(F.min("ts").alias("first_ok"))
    seconds = F.unix_timestamp(F.col("first_ok").cast("timestamp")) - F.unix_timestamp(
        F.lit(healed).cast("timestamp"))
    return first.withColumn("recovery_s", seconds)


def day_summary(transcript: DataFrame) -> DataFrame:
    """Posted, 201 and other requests per UTC day; a day is bad when more than a tenth was refused."""
    per_day = transcript.groupBy(F.date_format("ts", "yyyyMMdd").alias("dt")).agg(
        F.count(F.lit(1)).alias("posted"), F.count_if(F.col("status") == 201).alias("ok201"))
    other = F.col("posted") - F.col("ok201")
    return per_day.select("dt", "posted", "ok201", other.alias("non201"),
                          (other > F.floor(F.col("posted") / BAD_DAY_SHARE)).alias("bad"))


def malformed_count(parsed: DataFrame) -> DataFrame:
    """Lines and lines that do not parse."""
    return parsed.agg(F.count(F.lit(1)).alias("lines"), F.count_if("malformed").alias("malformed"))
