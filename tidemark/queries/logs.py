"""Log queries: transcripts, load runs, audit, dashboard, alerts, freshness, landing checks, calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, outcomes
from tidemark.operators import alerts, audit, freshness, landing, loadreport, sequence, transcripts
from tidemark.operators.transcripts import Window
from tidemark.queries import sql as q
from tidemark.queries.registry import query
from tidemark.sources.adapters import Tables
from tidemark.sources.lake import parse_transcript

FAULT = Window("2024-01-10 00:00:00", "2024-01-12 12:00:00")
RUN = loadreport.Profile("2024-01-01 00:00:00", step_s=432_000, ramp_s=86_400)
ONE = "one AS (SELECT 1)"


def stamp(column: str):
    """A timestamp as text with milliseconds cut to seconds."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


# ----------------------------------------------------------------------------------- transcripts

@query("transcript_status_hist", q.with_(
    "SELECT status, CAST(count(*) AS BIGINT) AS n FROM transcript GROUP BY status", q.TRANSCRIPT))
def transcript_status_hist(t: Tables) -> DataFrame:
    return transcripts.status_histogram(t.transcript())


@query("transcript_error_hist", q.with_(
    "SELECT error_code, CAST(count(*) AS BIGINT) AS n FROM transcript WHERE error_code IS NOT NULL GROUP BY ALL",
    q.TRANSCRIPT))
def transcript_error_hist(t: Tables) -> DataFrame:
    return transcripts.error_histogram(t.transcript())


@query("transcript_durations", q.with_("""
SELECT 'all' AS view, CAST(count(*) AS BIGINT) AS n, max(time_ms) AS max_value,
       CAST(median(time_ms) AS DOUBLE) AS median FROM transcript
UNION ALL SELECT '201-only', CAST(count(*) AS BIGINT), max(time_ms), CAST(median(time_ms) AS DOUBLE)
FROM transcript WHERE status = 201""", q.TRANSCRIPT))
def transcript_durations(t: Tables) -> DataFrame:
    return transcripts.durations(t.transcript())


_PAIRED = """
first_probe AS (SELECT * FROM (SELECT ref, status AS o_status, order_id AS o_order_id,
                  row_number() OVER (PARTITION BY ref ORDER BY ts, n) AS rn FROM transcript WHERE kind = 'probe')
                WHERE rn = 1),
paired AS (
  SELECT t.*, o_status, o_order_id, CASE
      WHEN o_status IS NULL THEN 'unpaired'
      WHEN status = 201 AND o_status = 201 THEN 'duplicate_commit'
      WHEN status = 201 THEN 're_executed'
      WHEN status = 409 AND error_code = 'DUPLICATE' AND o_status = 201 AND order_id <> o_order_id THEN 'id_mismatch'
      WHEN status = 409 THEN 'ok_409' WHEN status = 422 THEN 'guard_422' ELSE 'other' END AS outcome
  FROM transcript t LEFT JOIN first_probe f ON f.ref = t.ref WHERE t.kind = 'replay')"""


@query("transcript_replay_outcomes", q.with_(
    "SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM paired GROUP BY outcome", q.TRANSCRIPT, _PAIRED))
def transcript_replay_outcomes(t: Tables) -> DataFrame:
    return transcripts.replay_outcomes(t.transcript())


@query("transcript_violations", q.with_(f"""
SELECT 'HANG' AS rule, n, kind, ref FROM transcript WHERE time_ms > 30000
UNION ALL SELECT 'STATUS-0', n, kind, ref FROM transcript
WHERE status = 0 AND NOT (ts BETWEEN TIMESTAMP '{FAULT.start}' AND TIMESTAMP '{FAULT.end}')
UNION ALL SELECT CASE outcome WHEN 'duplicate_commit' THEN 'DUPLICATE-COMMIT' WHEN 'id_mismatch' THEN 'ID-MISMATCH'
                              ELSE 'UNPAIRED-REPLAY' END, n, kind, ref
FROM paired WHERE outcome IN ('duplicate_commit', 'id_mismatch', 'unpaired')""", q.TRANSCRIPT, _PAIRED))
def transcript_violations(t: Tables) -> DataFrame:
    return transcripts.violations(t.transcript(), [FAULT]).drop("ts")


_SEGMENT = (f"CASE WHEN ts < TIMESTAMP '{FAULT.start}' THEN 'before' WHEN ts > TIMESTAMP '{FAULT.end}' THEN 'after' "
            f"ELSE 'affected' END")


@query("transcript_window_split", q.with_(
    f"SELECT {_SEGMENT} AS segment, status, CAST(count(*) AS BIGINT) AS n FROM transcript GROUP BY ALL", q.TRANSCRIPT))
def transcript_window_split(t: Tables) -> DataFrame:
    return transcripts.window_split(t.transcript(), FAULT)


@query("transcript_window_join", q.with_("""
SELECT w.name, t.status, CAST(count(*) AS BIGINT) AS n
FROM transcript t LEFT JOIN (SELECT 'w-' || strftime(d, '%Y%m%d') AS name, d AS s, d + INTERVAL 6 HOUR AS e
                             FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events WHERE event_type = 'error')) w
  ON t.ts BETWEEN w.s AND w.e GROUP BY ALL""", q.TRANSCRIPT))
def transcript_window_join(t: Tables) -> DataFrame:
    """Records tagged by a table of fault windows: the first six hours of every day with an error."""
    day = F.to_date("ts")
    windows = t.table("events").where("event_type = 'error'").select(day.alias("d")).distinct().select(
        F.concat(F.lit("w-"), F.date_format("d", "yyyyMMdd")).alias("name"),
        F.col("d").cast("timestamp_ntz").alias("start"),
        (F.col("d").cast("timestamp_ntz") + F.expr("interval 6 hours")).alias("end"))
    return transcripts.tag_by_table(t.transcript(), windows).groupBy("name", "status").agg(
        F.count(F.lit(1)).alias("n"))


@query("transcript_recovery", q.with_(f"""
SELECT {_stamp('first_ok')} AS first_ok,
       CAST(epoch(date_trunc('second', first_ok)) - epoch(TIMESTAMP '{FAULT.end}') AS BIGINT) AS recovery_s
FROM (SELECT min(ts) AS first_ok FROM transcript
      WHERE kind = 'probe' AND status = 201 AND ts > TIMESTAMP '{FAULT.end}')""", q.TRANSCRIPT))
def transcript_recovery(t: Tables) -> DataFrame:
    return transcripts.recovery(t.transcript(), FAULT.end).withColumn("first_ok", stamp("first_ok"))


@query("transcript_malformed", q.with_("""
SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(CASE WHEN n % 37 = 0 OR n % 41 = 0 THEN 1 ELSE 0 END) AS BIGINT)
       AS malformed FROM transcript""", q.TRANSCRIPT))
def transcript_malformed(t: Tables) -> DataFrame:
    """Transcript lines with some cut short and some that are not JSON at all."""
    body = F.to_json(F.struct("n", "kind", "ref", "status"))
    line = F.when(F.col("n") % 37 == 0, F.expr("substr(line, 1, length(line) - 4)")).when(
        F.col("n") % 41 == 0, F.lit("<html>")).otherwise(F.col("line"))
    lines = t.transcript().withColumn("line", body).select(line.alias("value"))
    return transcripts.malformed_count(parse_transcript(lines))


@query("transcript_verdict", q.with_(f"""
SELECT *, hang + status_0 + duplicate_commit + id_mismatch + unpaired_replay + malformed = 0 AS passed FROM (
  SELECT (SELECT count(*) FROM all_lines) AS lines,
         (SELECT count(*) FROM transcript WHERE time_ms > 30000) AS hang,
         (SELECT count(*) FROM transcript WHERE status = 0
          AND NOT (ts BETWEEN TIMESTAMP '{FAULT.start}' AND TIMESTAMP '{FAULT.end}')) AS status_0,
         (SELECT count(*) FROM paired WHERE outcome = 'duplicate_commit') AS duplicate_commit,
         (SELECT count(*) FROM paired WHERE outcome = 'id_mismatch') AS id_mismatch,
         (SELECT count(*) FROM paired WHERE outcome = 'unpaired') AS unpaired_replay,
         (SELECT count(*) FROM all_lines WHERE n % 37 = 0 OR n % 41 = 0) AS malformed)""",
    q.TRANSCRIPT.replace("transcript AS (", "all_lines AS (", 1),
    "transcript AS (SELECT * FROM all_lines WHERE n % 37 <> 0 AND n % 41 <> 0)", _PAIRED))
def transcript_verdict(t: Tables) -> DataFrame:
    """The whole analysis of a transcript file in which some lines are cut short or no JSON."""
    log = t.transcript()
    kept = ("n", "kind", "ref", "status", "time_ms", "error_code", "order_id")
    body = F.to_json(F.struct(F.col("ts").cast("string").alias("ts"), *kept))
    line = F.when(F.col("n") % 37 == 0, F.expr("substr(line, 1, length(line) - 4)")).when(
        F.col("n") % 41 == 0, F.lit("<html>")).otherwise(F.col("line"))
    parsed = parse_transcript(log.withColumn("line", body).select(line.alias("value")))
    return transcripts.verdict(parsed.withColumn("ts", F.col("ts").cast(log.schema["ts"].dataType)), [FAULT])


@query("day_outcome_summary", q.with_("""
SELECT *, non201 > posted // 10 AS bad FROM (
  SELECT strftime(ts, '%Y%m%d') AS dt, CAST(count(*) AS BIGINT) AS posted,
         CAST(sum(CASE WHEN status = 201 THEN 1 ELSE 0 END) AS BIGINT) AS ok201,
         CAST(sum(CASE WHEN status <> 201 THEN 1 ELSE 0 END) AS BIGINT) AS non201 FROM transcript GROUP BY 1)""",
                                      q.TRANSCRIPT))
def day_outcome_summary(t: Tables) -> DataFrame:
    return transcripts.day_summary(t.transcript())


@query("outcome_classes", q.with_("""
SELECT CASE WHEN status = 201 THEN 'SUCCESS' WHEN status IN (400, 409) THEN 'SENDER' WHEN status = 422 THEN 'BUSINESS'
            WHEN status IN (500, 503) THEN 'RECEIVER' WHEN status = 0 THEN 'NETWORK' ELSE 'OTHER' END AS outcome,
       CASE WHEN error_code IS NULL THEN NULL WHEN error_code = 'ORD-DUP-REF' THEN 'BUSINESS' ELSE 'INFRA' END AS fault,
       CASE WHEN error_code = 'ORD-DUP-REF' THEN 'ORDERS' END AS subsystem, CAST(count(*) AS BIGINT) AS n
FROM transcript GROUP BY ALL""", q.TRANSCRIPT))
def outcome_classes(t: Tables) -> DataFrame:
    code = F.col("error_code")
    return t.transcript().groupBy(
        outcomes.outcome_class(F.col("status")).alias("outcome"), outcomes.fault_class(code).alias("fault"),
        outcomes.fault_subsystem(code).alias("subsystem")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------ load runs

_STEPPED = f"""
stepped AS (SELECT *, CAST(floor((epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '{RUN.start}')) / {RUN.step_s}) + 1
                           AS INTEGER) AS step FROM transcript),
counted AS (
  SELECT step, CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (status = 201) AS BIGINT) AS n201,
         CAST(count(*) FILTER (status = 422) AS BIGINT) AS n422, CAST(count(*) FILTER (status = 409) AS BIGINT) AS n409,
         CAST(count(*) FILTER (status = 503) AS BIGINT) AS n503, CAST(count(*) FILTER (status >= 500) AS BIGINT) AS n5xx,
         CAST(count(*) FILTER (status = 0) AS BIGINT) AS network,
         CAST(count(*) FILTER (status NOT IN (0, 201, 409, 422) AND status < 500) AS BIGINT) AS other,
         quantile_cont(time_ms, 0.95) FILTER (status = 201) AS p95,
         quantile_cont(time_ms, 0.99) FILTER (status = 201) AS p99
  FROM stepped GROUP BY step),
steps AS (SELECT *, (n5xx + network) * 100 > requests * 35 OR coalesce(p95 > 27000, false) AS breached FROM counted)"""


def load_steps(t: Tables) -> DataFrame:
    return loadreport.report(loadreport.tag_steps(t.transcript(), RUN), budget_ms=27_000, infra_percent=35)


@query("load_step_percentiles", q.with_("SELECT * FROM steps", q.TRANSCRIPT, _STEPPED))
def load_step_percentiles(t: Tables) -> DataFrame:
    return load_steps(t)


@query("load_breaking_point", q.with_("""
SELECT min(CASE WHEN breached THEN step END) AS breaking_step, CAST(count(*) AS BIGINT) AS steps FROM steps""",
                                      q.TRANSCRIPT, _STEPPED))
def load_breaking_point(t: Tables) -> DataFrame:
    return loadreport.breaking_point(load_steps(t))


@query("load_phase_counts", q.with_(f"""
SELECT step, CASE WHEN (epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '{RUN.start}')) % {RUN.step_s} < {RUN.ramp_s}
                  THEN 'ramp' ELSE 'hold' END AS phase, CAST(count(*) AS BIGINT) AS n
FROM stepped GROUP BY ALL""", q.TRANSCRIPT, _STEPPED))
def load_phase_counts(t: Tables) -> DataFrame:
    return loadreport.tag_steps(t.transcript(), RUN).groupBy("step", "phase").agg(F.count(F.lit(1)).alias("n"))


@query("rolling_failure_rate", q.with_("""
SELECT n, row_no, calls, failures, calls >= 6 AND failures * 2 >= calls AS tripped FROM (
  SELECT n, CAST(row_number() OVER (ORDER BY ts, n) AS BIGINT) AS row_no, CAST(count(*) OVER w AS BIGINT) AS calls,
         CAST(sum(CASE WHEN status IN (0, 503) THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failures
  FROM transcript WINDOW w AS (ORDER BY ts, n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""", q.TRANSCRIPT))
def rolling_failure_rate(t: Tables) -> DataFrame:
    numbered = sequence.number_rows(t.transcript().select("ts", "n", "status"), ("ts", "n"))
    return sequence.rolling_rate(numbered, "row_no", F.col("status").isin(0, 503), chunk=1000).select(
        "n", "row_no", "calls", "failures", "tripped")


# ----------------------------------------------------------------------------------------- audit

def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", stamp("event_time"))


def _audit_sql(columns: str, where: str) -> str:
    return q.with_(f"SELECT {_stamp('event_time')} AS event_time, {columns} FROM audit WHERE {where}", q.AUDIT)


@query("audit_q1", _audit_sql("identity_type, identity_name, event_name, resource_name, source_ip",
                              "event_source LIKE '%kms%' AND event_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' "
                              "AND TIMESTAMP '2024-01-20 23:59:59'"))
def audit_q1(t: Tables) -> DataFrame:
    return timed(audit.key_actions(t.audit_events(), "2024-01-05 00:00:00", "2024-01-20 23:59:59"))


@query("audit_q2", _audit_sql("identity_name, event_name, source_ip, user_agent, error_code", "error_code IS NOT NULL"))
def audit_q2(t: Tables) -> DataFrame:
    return timed(audit.denied(t.audit_events()))


@query("audit_q3", _audit_sql("identity_name, event_name, resource_name, request_params",
                              "event_name LIKE '%BucketPolicy%'"))
def audit_q3(t: Tables) -> DataFrame:
    return timed(audit.policy_changes(t.audit_events()))


@query("audit_q4", _audit_sql("event_name, resource_type, resource_name, source_ip, error_code",
                              "identity_name = 'user-7'"))
def audit_q4(t: Tables) -> DataFrame:
    return timed(audit.by_identity(t.audit_events(), "user-7"))


@query("audit_q5", _audit_sql("identity_name, event_name, region, source_ip", "region <> 'ap-southeast-1'"))
def audit_q5(t: Tables) -> DataFrame:
    return timed(audit.other_region(t.audit_events()))


@query("audit_json_denied", _audit_sql(
    "identity_name AS actor, event_name AS op, source_ip AS src, error_code AS err", "error_code IS NOT NULL"
))
def audit_json_denied(t: Tables) -> DataFrame:
    """Q2 over JSON payloads: all refused actions."""
    fields = {"actor": "$.userIdentity.userName", "op": "$.eventName", "src": "$.sourceIpAddress",
              "err": "$.errorCode"}
    return timed(audit.json_query(audit.as_json(t.audit_events()), audit.path("errorCode").isNotNull(), fields))


@query("audit_json_policy_changes", _audit_sql(
    "identity_name AS actor, event_name AS op, resource_name AS bucket", "event_name LIKE '%BucketPolicy%'"))
def audit_json_policy_changes(t: Tables) -> DataFrame:
    """Bucket-policy changes over JSON payloads, all of them."""
    fields = {"actor": "$.userIdentity.userName", "op": "$.eventName", "bucket": "$.resourceName"}
    return timed(audit.json_query(audit.as_json(t.audit_events()), audit.path("eventName").like("%BucketPolicy%"),
                                  fields))


@query("audit_json_key_actions", _audit_sql(
    "identity_name AS actor, event_name AS op, resource_name AS resource, source_ip AS src",
    "event_source LIKE '%kms%'"))
def audit_json_key_actions(t: Tables) -> DataFrame:
    """Q1 over JSON payloads: who touched keys."""
    fields = {"actor": "$.userIdentity.userName", "op": "$.eventName", "resource": "$.resourceName",
              "src": "$.sourceIpAddress"}
    return timed(audit.json_query(audit.as_json(t.audit_events()), audit.path("eventSource").like("%kms%"), fields))


@query("audit_json_by_identity", _audit_sql(
    "event_name AS op, resource_name AS resource, source_ip AS src, error_code AS err", "identity_name = 'user-7'"))
def audit_json_by_identity(t: Tables) -> DataFrame:
    """Q4 over JSON payloads: everything one identity did."""
    fields = {"op": "$.eventName", "resource": "$.resourceName", "src": "$.sourceIpAddress", "err": "$.errorCode"}
    return timed(audit.json_query(
        audit.as_json(t.audit_events()), audit.path("userIdentity.userName") == "user-7", fields))


@query("audit_json_other_region", _audit_sql(
    "identity_name AS actor, event_name AS op, region, source_ip AS src", "region <> 'ap-southeast-1'"))
def audit_json_other_region(t: Tables) -> DataFrame:
    """Q5 over JSON payloads: actions outside the home region."""
    fields = {"actor": "$.userIdentity.userName", "op": "$.eventName", "region": "$.acsRegion",
              "src": "$.sourceIpAddress"}
    return timed(audit.json_query(
        audit.as_json(t.audit_events()), audit.path("acsRegion") != audit.HOME_REGION, fields))


@query("retention_filter", """
SELECT store, CAST(count(*) AS BIGINT) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest
FROM (SELECT ts, CASE event_type WHEN 'view' THEN 'metrics' WHEN 'error' THEN 'audit' WHEN 'click' THEN 'app'
                                 WHEN 'signup' THEN 'events' ELSE 'other' END AS store FROM events)
WHERE store = 'other' OR ts >= TIMESTAMP '2024-02-10 12:00:00'
      - CASE store WHEN 'audit' THEN INTERVAL 180 DAY ELSE INTERVAL 30 DAY END
GROUP BY store""")
def retention_filter(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    logs = t.table("events").select(
        F.col("ts").alias("event_time"), F.when(kind == "view", "metrics").when(kind == "error", "audit")
        .when(kind == "click", "app").when(kind == "signup", "events").otherwise("other").alias("store"))
    kept = audit.retained(logs, "2024-02-10 12:00:00")
    return kept.groupBy("store").agg(F.count(F.lit(1)).alias("n"), stamp(F.min("event_time")).alias("oldest"))


# -------------------------------------------------------------------------- dashboard and alerts

def minutes(df: DataFrame, *columns: str) -> DataFrame:
    out = df
    for c in columns:
        out = out.withColumn(c, stamp(c))
    return out


AS_OF = "2024-01-20 00:00:00"
_LAST_DAY = f"ts > TIMESTAMP '{AS_OF}' - INTERVAL {alerts.DAY_S} SECOND AND ts <= TIMESTAMP '{AS_OF}'"


def last_day(log: DataFrame) -> DataFrame:
    return alerts.look_back(log, AS_OF, alerts.DAY_S)


@query("dashboard_p95_minute", q.with_(f"""
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS t, CAST(count(*) AS BIGINT) AS n,
       quantile_cont(time_ms, 0.95) AS p95 FROM transcript WHERE {_LAST_DAY} GROUP BY 1""", q.TRANSCRIPT))
def dashboard_p95_minute(t: Tables) -> DataFrame:
    """Every minute of the look-back."""
    return minutes(alerts.p95_per_minute(last_day(t.transcript())), "t")


@query("dashboard_p95_minute_full", q.with_("""
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS t, CAST(count(*) AS BIGINT) AS n,
       quantile_cont(time_ms, 0.95) AS p95 FROM transcript GROUP BY 1""", q.TRANSCRIPT))
def dashboard_p95_minute_full(t: Tables) -> DataFrame:
    """The whole series."""
    return minutes(alerts.p95_per_minute(t.transcript()), "t")


@query("dashboard_dlq_minute", q.with_(f"""
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS t, CAST(count(*) AS BIGINT) AS dlq_depth
FROM transcript WHERE status IN (0, 503) AND {_LAST_DAY} GROUP BY 1""", q.TRANSCRIPT))
def dashboard_dlq_minute(t: Tables) -> DataFrame:
    return minutes(alerts.count_per_minute(last_day(t.transcript()).where("status in (0, 503)"), "dlq_depth"), "t")


@query("dashboard_freshness_minute", f"""
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS t, max({q.minor('value')} // 100) AS freshness_s
FROM events WHERE event_type = 'view' AND {_LAST_DAY} GROUP BY 1""")
def dashboard_freshness_minute(t: Tables) -> DataFrame:
    return minutes(alerts.freshness_per_minute(last_day(t.metric_events())), "t")


def _tumbling(length_s: int, rel: str, measure: str, name: str, fires: str) -> str:
    return f"""
SELECT strftime(make_timestamp(b * {length_s} * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(make_timestamp((b + 1) * {length_s} * 1000000), '%Y-%m-%d %H:%M:%S') AS window_end,
       {name}, {name} {fires} AS fires
FROM (SELECT CAST(floor(epoch(ts) / {length_s}) AS BIGINT) AS b, {measure} AS {name} FROM {rel} GROUP BY 1)"""


@query("alert_dlq_sliding", q.with_("""
SELECT strftime(make_timestamp(b * 300000000), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(make_timestamp((b + 2) * 300000000), '%Y-%m-%d %H:%M:%S') AS window_end, dlq_depth, dlq_depth > 2 AS fires
FROM (SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) - k AS b, CAST(count(*) AS BIGINT) AS dlq_depth
      FROM transcript, range(0, 2) r(k) WHERE status IN (0, 503) GROUP BY 1)""", q.TRANSCRIPT))
def alert_dlq_sliding(t: Tables) -> DataFrame:
    return minutes(alerts.dlq_alert(t.transcript().where("status in (0, 503)"), limit=2), "window_start", "window_end")


@query("alert_p95", q.with_(_tumbling(300, "transcript", "quantile_cont(time_ms, 0.95)", "p95_ms", "> 20000"),
                            q.TRANSCRIPT))
def alert_p95(t: Tables) -> DataFrame:
    return minutes(alerts.p95_alert(t.transcript(), limit=20_000), "window_start", "window_end")


@query("alert_denied", q.with_(_tumbling(
    300, "(SELECT event_time AS ts FROM audit WHERE error_code IS NOT NULL)", "CAST(count(*) AS BIGINT)",
    "denied_count", "> 1"), q.AUDIT))
def alert_denied(t: Tables) -> DataFrame:
    log = t.audit_events().withColumnRenamed("event_time", "ts")
    return minutes(alerts.denied_alert(log, limit=1), "window_start", "window_end")


@query("alert_tamper", q.with_(_tumbling(
    300, "(SELECT event_time AS ts FROM audit WHERE event_name IN ('StopLogging', 'DeleteTrail'))",
    "CAST(count(*) AS BIGINT)", "tripwire", ">= 1"), q.AUDIT))
def alert_tamper(t: Tables) -> DataFrame:
    log = t.audit_events().withColumnRenamed("event_time", "ts")
    return minutes(alerts.tamper_alert(log, audit.TAMPER_EVENTS), "window_start", "window_end")


# ------------------------------------------------------------------------- freshness and metrics

_BATCHES = f"""
batches AS (
  SELECT part AS source, hour_ms, max(ts_ms) AS max_source_ts_ms, max(hour_ms + 3605000) AS published_ms
  FROM (SELECT *, CAST(epoch_ms(date_trunc('hour', e.ts)) AS BIGINT) AS hour_ms
        FROM event_changes c JOIN (SELECT event_id, ts FROM events) e USING (event_id))
  WHERE NOT tombstone AND ts_ms IS NOT NULL GROUP BY ALL)"""


def publish_batches(t: Tables) -> DataFrame:
    """Hourly published batches per message partition, published 5 seconds after the hour."""
    routed = landing.route(t.event_changes())
    hour = dates.epoch_ms(F.date_trunc("hour", "timestamp"))
    batches = routed.select(F.col("partition").alias("source"), hour.alias("hour_ms"), "r_ts_ms")
    return freshness.per_batch(batches, ["source", "hour_ms"], "r_ts_ms", F.col("hour_ms") + 3_605_000)


@query("freshness_per_batch", q.with_("""
SELECT source, hour_ms, max_source_ts_ms, published_ms,
       greatest(0, (published_ms - max_source_ts_ms) // 1000) AS value FROM batches""", q.EVENT_CHANGES, _BATCHES))
def freshness_per_batch(t: Tables) -> DataFrame:
    return publish_batches(t)


@query("freshness_heartbeat", q.with_("""
SELECT source, max_source_ts_ms, now_ms, greatest(0, (now_ms - max_source_ts_ms) // 1000) AS value
FROM (SELECT source, max_source_ts_ms, unnest(range(published_ms + 600000, until, 600000)) AS now_ms
      FROM (SELECT *, coalesce(lead(published_ms) OVER (PARTITION BY source ORDER BY published_ms), 1706745600000)
              AS until FROM batches))""", q.EVENT_CHANGES, _BATCHES))
def freshness_heartbeat(t: Tables) -> DataFrame:
    return freshness.heartbeats(publish_batches(t), ["source"], 1_706_745_600_000, every_s=600)


@query("metric_lines", f"""
SELECT '{{"metric":"cdc_freshness_seconds","value":' || v || ',"pipeline":"cdc"}}' AS line, CAST(count(*) AS BIGINT) AS n
FROM (SELECT {q.minor('value')} // 100 AS v FROM events WHERE event_type = 'view') GROUP BY v""")
def metric_lines(t: Tables) -> DataFrame:
    line = freshness.metric_json(F.col("metric"), F.col("value"), F.col("pipeline"))
    return t.metric_events().groupBy(line.alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("metric_is_measured", f"""
SELECT 'cdc_freshness_seconds' AS metric, CAST(count(*) AS BIGINT) AS lines,
       CAST(count(DISTINCT {q.minor('value')} // 100) AS BIGINT) AS distinct_values,
       count(*) >= 2 AND count(DISTINCT {q.minor('value')} // 100) >= 2 AS measured
FROM events WHERE event_type = 'view'""")
def metric_is_measured(t: Tables) -> DataFrame:
    return freshness.measured(t.metric_events())


# ---------------------------------------------------------------------------------------- bronze

_ROUTED = """
live AS (SELECT * FROM event_changes WHERE NOT tombstone),
landed AS (SELECT * FROM live WHERE ts_ms IS NOT NULL AND region <> 'EU')"""


_BALANCE = """
balance AS (SELECT tombstone, ts_ms IS NOT NULL AND region <> 'EU' AS landed FROM event_changes)"""


@query("bronze_inventory", q.with_("""
SELECT region, tbl AS "table", dt, CAST(count(*) AS BIGINT) AS records, min(ts_ms) AS first_ts_ms,
       max(ts_ms) AS last_ts_ms FROM landed GROUP BY ALL""", q.EVENT_CHANGES, _ROUTED))
def bronze_inventory(t: Tables) -> DataFrame:
    good = landing.route(t.event_changes()).where("reject is null")
    rows = good.select(F.col("r_region").alias("region"), F.col("r_table").alias("table"), F.col("r_dt").alias("dt"),
                       F.col("r_ts_ms").alias("ts_ms"))
    return landing.landing_summary(rows)


@query("bronze_reject_regions", q.with_("""
SELECT CASE WHEN ts_ms IS NULL THEN 'missing routing fields (region/table/sourceTsMs)'
            WHEN region NOT IN ('CA', 'SG') THEN 'region=' || region || ' is not in the allowed set' END AS reject,
       CAST(count(*) AS BIGINT) AS n FROM live GROUP BY 1""", q.EVENT_CHANGES, _ROUTED))
def bronze_reject_regions(t: Tables) -> DataFrame:
    return landing.route(t.event_changes(), ("CA", "SG")).groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


def landed_rows(t: Tables) -> DataFrame:
    return landing.bronze_rows(landing.route(t.event_changes()).where("reject is null"), "attempt-1")


@query("residency_scan", q.with_("""
SELECT region, CAST(count(*) AS BIGINT) AS records,
       CAST(count(*) FILTER (region = 'CN' AND off % 89 = 0) AS BIGINT) AS plaintext,
       CAST(count(*) FILTER (region = 'CN' AND off % 89 <> 0) AS BIGINT) AS masked FROM landed GROUP BY region""",
                                 q.EVENT_CHANGES, _ROUTED))
def residency_scan(t: Tables) -> DataFrame:
    """The residency scan over landed values, a clear reference leaked into every 89th record."""
    leak = F.when(F.col("offset") % 89 == 0, F.regexp_replace("value", '"msk-', '"cust-cn-')).otherwise(F.col("value"))
    return landing.residency_violations(landed_rows(t).withColumn("value", leak))


@query("object_key_contract", q.with_("""
SELECT region, CAST(count(*) AS BIGINT) AS bad_keys FROM landed WHERE off % 91 = 0 GROUP BY region""",
                                      q.EVENT_CHANGES, _ROUTED))
def object_key_contract(t: Tables) -> DataFrame:
    """Object keys against the naming contract, with every 91st topic misnamed."""
    topic = F.when(F.col("offset") % 91 == 0, "oms cdc").otherwise(F.col("topic"))
    routed = landing.route(t.event_changes().withColumn("topic", topic)).where("reject is null")
    bad = landing.bad_object_keys(landing.bronze_rows(routed, "attempt-1"))
    return bad.groupBy("region").agg(F.count(F.lit(1)).alias("bad_keys"))


@query("duplicate_offsets", q.with_("""
SELECT topic, part AS "partition", off AS "offset", CAST(2 AS BIGINT) AS copies FROM landed WHERE off % 83 = 0""",
                                    q.EVENT_CHANGES, _ROUTED))
def duplicate_offsets(t: Tables) -> DataFrame:
    """Message positions landed twice: every 83rd record is replayed by a second landing."""
    twice = F.explode(F.when(F.col("offset") % 83 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return landing.duplicate_offsets(landed_rows(t).withColumn("landing", twice))


# -------------------------------------------------------------------------------------- calendar

@query("date_keys", """
SELECT strftime(ts, '%Y%m%d') AS dt, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key,
       strftime(ts + INTERVAL 8 HOUR - INTERVAL 1 DAY, '%Y-%m-%d') AS business_date,
       CAST(isodow(ts) AS INTEGER) AS day_of_week, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def date_keys(t: Tables) -> DataFrame:
    ms = dates.epoch_ms(F.col("ts"))
    day = dates.utc_date(ms)
    return t.table("events").groupBy(
        dates.dt_utc(ms).alias("dt"), dates.date_key(day).alias("date_key"),
        F.date_format(dates.business_date(ms), "yyyy-MM-dd").alias("business_date"),
        dates.iso_day_of_week(day).alias("day_of_week")).agg(F.count(F.lit(1)).alias("n"))


@query("batch_window_verdict", """
SELECT business_date, CAST(count(*) AS BIGINT) AS runs,
       CAST(count(*) FILTER (within) AS BIGINT) AS within, CAST(count(*) FILTER (strict) AS BIGINT) AS strict,
       min('BATCH-WINDOW businessDate=' || business_date || ' completedAtSGT=' || strftime(sgt, '%Y-%m-%dT%H:%M:%S')
           || ' Asia/Singapore windowEndSGT=06:00 withinWindow=' || within) AS first_line
FROM (SELECT *, CAST(CAST(date_trunc('millisecond', sgt) AS TIME) <= TIME '06:00:00' AS BOOLEAN) AS within,
             day <= bd OR (day = bd + 1 AND CAST(date_trunc('millisecond', sgt) AS TIME) <= TIME '06:00:00') AS strict
      FROM (SELECT ts + INTERVAL 8 HOUR AS sgt, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day,
                   CAST(ts + INTERVAL 8 HOUR AS DATE) - 1 - CAST(event_id % 3 AS INTEGER) AS bd,
                   strftime(CAST(ts + INTERVAL 8 HOUR AS DATE) - 1 - CAST(event_id % 3 AS INTEGER), '%Y-%m-%d')
                     AS business_date FROM events))
GROUP BY business_date""")
def batch_window_verdict(t: Tables) -> DataFrame:
    """Verdicts of runs that complete at event times, on time or one or two days late."""
    runs = t.table("events").select(dates.epoch_ms(F.col("ts")).alias("done_ms"), F.col("event_id"))
    dated = runs.withColumn("bd", F.date_sub(dates.business_date(F.col("done_ms")),
                                             (F.col("event_id") % 3).cast("int")))
    return dated.groupBy(F.date_format("bd", "yyyy-MM-dd").alias("business_date")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(dates.within_window(F.col("done_ms"))).alias("within"),
        F.count_if(dates.within_window_strict(F.col("done_ms"), F.col("bd"))).alias("strict"),
        F.min(dates.window_line(F.col("bd"), F.col("done_ms"))).alias("first_line"))
