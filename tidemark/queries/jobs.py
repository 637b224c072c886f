"""Jobs end to end: landing, daily batch, event store, streams. Each writes to the scratch folder first."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Lake
from tidemark.operators import alerts, audit, events, freshness, gold, landing
from tidemark.plans import daily
from tidemark.queries import lake as lq
from tidemark.queries import logs as lg
from tidemark.queries import orders as oq
from tidemark.queries import sql as q
from tidemark.queries.registry import ORACLES, query
from tidemark.session import LONG_JOB, scratch_path, settings, written, written_for
from tidemark.sinks import snapshots, store, tables
from tidemark.sinks.objects import land_objects, object_counts
from tidemark.sources.adapters import REPLAY_DATE, REPLAY_DT, Tables
from tidemark.sources.bronze import bronze_scan, object_scan
from tidemark.sources.lake import lake_table, metric_lines
from tidemark.streaming import claims, jobs


class StreamTables(Tables):
    """The given tables with some of them read as streams."""

    def __init__(self, base: Tables, *streamed: str):
        super().__init__(base.spark, base.folder)
        self._streamed = streamed

    def table(self, name: str) -> DataFrame:
        if name not in self._streamed:
            return super().table(name)
        schema = super().table(name).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


# ------------------------------------------------------------------------------- lake round trips

_LANDED = ("SELECT region, tbl AS \"table\", dt, CAST(count(*) AS BIGINT) AS records, CAST(sum(off) AS BIGINT) AS offsets,"
           " min(off) AS first_offset, max(off) AS last_offset FROM landed GROUP BY ALL")


def landed_profile(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("region", "table", "dt").agg(
        F.count(F.lit(1)).alias("records"), F.sum("offset").alias("offsets"), F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"))


@query("bronze_roundtrip", q.with_(_LANDED, q.EVENT_CHANGES, lg._ROUTED))
def bronze_roundtrip(t: Tables) -> DataFrame:
    """Land the change stream, then scan it back."""
    root = scratch_path(t.spark, "bronze")
    tables.land(lg.landed_rows(t), root)
    return landed_profile(bronze_scan(t.spark, root))


@query("silver_gold_roundtrip", q.with_(f"""
SELECT d.dt, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(line_total_minor) AS BIGINT) AS total_minor
FROM silver_lines, (VALUES ('{REPLAY_DT}'), ('20260913')) d(dt) GROUP BY d.dt
UNION ALL SELECT '20260914', CAST(0 AS BIGINT), CAST(NULL AS BIGINT)""", *q.LINES, q.SILVER_LINES))
def silver_gold_roundtrip(t: Tables) -> DataFrame:
    """Write one day twice, another once, and rerun a third without rows: one copy each, and none of the third."""
    path = scratch_path(t.spark, "gold")
    lines = written(oq.live_lines(t).withColumn(
        "line_total_minor", F.col("quantity").cast("bigint") * F.col("unit_price_minor")).select(
        *gold.FACT_LINE_COLUMNS), "live-lines")
    for day in (REPLAY_DATE, REPLAY_DATE, dt.date(2026, 9, 13), dt.date(2026, 9, 14)):
        tables.replace_day(gold.fact_order_lines(lines, day), path, f"{day:%Y%m%d}")
    tables.replace_day(gold.fact_order_lines(lines.where("false"), day), path, f"{day:%Y%m%d}")
    back = [lake_table(t.spark, path, d) for d in (REPLAY_DT, "20260913")]
    emptied = t.spark.read.parquet(f"{path}/dt=20260914").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("line_total_minor").alias("total_minor"))
    return back[0].unionByName(back[1]).groupBy("dt").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("line_total_minor").alias("total_minor")).unionByName(
        emptied.select(F.lit("20260914").alias("dt"), "n_lines", "total_minor"))


def landed_lake(t: Tables) -> Lake:
    """A lake whose bronze holds the order and line changes of the replayed day, packed."""
    lake = Lake(scratch_path(t.spark, "lake"))
    changes = t.order_changes().unionByName(t.line_changes())
    land_objects(landing.bronze_rows(landing.strict(landing.route(changes)), "attempt-1"), lake.bronze, "replay", packed=True)
    return lake


def source_system(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.oms_orders().select("order_id", "total_amount_minor", "currency", "ingested_at"), lq.oms_lines_of(t)


@query("daily_batch_full", q.with_(lq._REC, *lq.recon_sql(False)))
def daily_batch_full(t: Tables) -> DataFrame:
    """The flagship: land changes, build silver, check, build gold, reconcile, book everything."""
    return daily.run_full(t.spark, landed_lake(t), REPLAY_DATE, *source_system(t)).per_currency.drop("in_source")


@query("pipeline_postconditions", q.with_("""
SELECT orders, lines, bronze, CAST(1 AS BIGINT) AS green, true AS holds FROM
  (SELECT CAST(count(*) AS BIGINT) AS orders FROM oms_orders), (SELECT CAST(count(*) AS BIGINT) AS lines FROM silver_lines),
  (SELECT CAST((SELECT count(*) FROM order_versions) + (SELECT count(*) FROM line_versions) AS BIGINT) AS bronze)""",
                                          *q.LAKE, q.OMS_ORDERS))
def pipeline_postconditions(t: Tables) -> DataFrame:
    """Rows exist, objects exist and the report is green after a landing and a comparison."""
    lake = landed_lake(t)
    orders, lines = source_system(t)
    report = lq.recon.report_row(lq.recon_frames(t), "run-1", REPLAY_DATE)
    return daily.postconditions(orders, lines, object_scan(t.spark, lake.bronze), report)


# ------------------------------------------------------------------------ reconciliation of tampered gold

_TAMPERED = """
tampered AS (
  SELECT order_id, total_amount_minor + CASE WHEN o_orderkey % 71 = 1 THEN 1 ELSE 0 END AS total_amount_minor,
         CASE WHEN o_orderkey % 73 = 2 THEN 'XXX' ELSE currency END AS currency
  FROM oms_orders, range(0, 2) twice(k) WHERE o_orderkey % 70 <> 0 AND (k = 0 OR o_orderkey % 79 = 3)
  UNION ALL SELECT 'ghost-' || order_id, total_amount_minor, currency FROM oms_orders WHERE o_orderkey % 83 = 4),
tampered_lines AS (
  SELECT order_id, line_no, currency, line_total_minor + CASE WHEN line_no = 1 AND quantity % 13 = 4 THEN 7 ELSE 0 END
         AS line_total_minor
  FROM silver_lines SEMI JOIN oms_orders USING (order_id) WHERE NOT (line_no = 2 AND quantity % 11 = 5))"""


def tampered_gold(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Facts from which orders and lines were lost, changed, stored twice or invented."""
    orders, lines = source_system(t)
    key = F.col("kafka_offset")
    kept = t.oms_orders().where(key % 70 != 0).select(
        "order_id", (F.col("total_amount_minor") + F.when(key % 71 == 1, 1).otherwise(0)).alias("total_amount_minor"),
        F.when(key % 73 == 2, "XXX").otherwise(F.col("currency")).alias("currency"),
        F.explode(F.when(key % 79 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k")).drop("k")
    ghosts = t.oms_orders().where(key % 83 == 4).select(
        F.concat(F.lit("ghost-"), "order_id").alias("order_id"), "total_amount_minor", "currency")
    more = F.when((F.col("line_no") == 1) & (F.col("quantity") % 13 == 4), 7).otherwise(0)
    left = lines.where(~((F.col("line_no") == 2) & (F.col("quantity") % 11 == 5))).join(
        orders.select("order_id"), "order_id", "left_semi")
    return kept.unionByName(ghosts), left.select(
        "order_id", "line_no", "currency", (F.col("line_total_minor") + more).alias("line_total_minor"))


_TAMPERED_SIDES = """
sides AS (
  SELECT 'orders' AS entity, currency, 1 AS s, count(*) AS n, sum(total_amount_minor) AS m FROM oms_orders GROUP BY ALL
  UNION ALL SELECT 'orders', currency, 0, count(*), sum(total_amount_minor) FROM tampered GROUP BY ALL
  UNION ALL SELECT 'lines', currency, 1, count(*), sum(line_total_minor) FROM silver_lines
    SEMI JOIN oms_orders USING (order_id) GROUP BY ALL
  UNION ALL SELECT 'lines', currency, 0, count(*), sum(line_total_minor) FROM tampered_lines GROUP BY ALL)"""


@query("recon_only_tampered", q.with_("""
SELECT entity, currency, CAST(sum(CASE WHEN s = 1 THEN n ELSE 0 END) AS BIGINT) AS source_rows,
       CAST(sum(CASE WHEN s = 0 THEN n ELSE 0 END) AS BIGINT) AS gold_rows,
       CAST(sum(CASE WHEN s = 1 THEN m ELSE 0 END) AS BIGINT) AS source_minor,
       CAST(sum(CASE WHEN s = 0 THEN m ELSE 0 END) AS BIGINT) AS gold_minor,
       sum(CASE WHEN s = 1 THEN m ELSE 0 END) = sum(CASE WHEN s = 0 THEN m ELSE 0 END) AS match, 2 AS exit_code
FROM sides GROUP BY entity, currency""", *q.LAKE, q.OMS_ORDERS, _TAMPERED, _TAMPERED_SIDES))
def recon_only_tampered(t: Tables) -> DataFrame:
    """The job that compares without rebuilding, on gold that somebody changed: it is red."""
    lake = Lake(scratch_path(t.spark, "lake"))
    for name, df in zip(("fact_orders", "fact_order_lines"), tampered_gold(t)):
        tables.replace_day(df, lake.gold(name), REPLAY_DT)
    result = daily.recon_only(t.spark, lake, REPLAY_DATE, *source_system(t))
    return result.per_currency.drop("in_source").withColumn("exit_code", F.lit(result.exit_code))


_LOCATED = """
SELECT 'orders' AS entity, order_id, NULL::INTEGER AS line_no,
       CASE WHEN g = 0 THEN 'LOST' WHEN s = 0 THEN 'INVENTED' ELSE 'CHANGED' END AS verdict,
       CAST(s AS BIGINT) AS source_rows, CAST(g AS BIGINT) AS gold_rows
FROM (SELECT order_id, sum(greatest(d, 0)) AS s, sum(greatest(-d, 0)) AS g FROM (
        SELECT order_id, total_amount_minor, currency, sum(x) AS d FROM (
          SELECT order_id, total_amount_minor, currency, 1 AS x FROM oms_orders
          UNION ALL SELECT order_id, total_amount_minor, currency, -1 FROM tampered) GROUP BY ALL) WHERE d <> 0 GROUP BY 1)
UNION ALL
SELECT 'lines', order_id, line_no, CASE WHEN b.order_id IS NULL THEN 'LOST' ELSE 'CHANGED' END,
       CAST(1 AS BIGINT), CAST(CASE WHEN b.order_id IS NULL THEN 0 ELSE 1 END AS BIGINT)
FROM (SELECT l.* FROM silver_lines l SEMI JOIN oms_orders USING (order_id)) a LEFT JOIN tampered_lines b
USING (order_id, line_no) WHERE b.order_id IS NULL OR a.line_total_minor <> b.line_total_minor"""


@query("recon_located", q.with_(_LOCATED, *q.LAKE, q.OMS_ORDERS, _TAMPERED))
def recon_located(t: Tables) -> DataFrame:
    """The orders and lines that make a comparison red, named."""
    orders, lines = source_system(t)
    gold_orders, gold_lines = tampered_gold(t)
    lines = lines.join(orders.select("order_id"), "order_id", "left_semi")
    found = [lq.recon.locate(orders, gold_orders, ("order_id",), ("total_amount_minor", "currency")),
             lq.recon.locate(lines, gold_lines, ("order_id", "line_no"), ("line_total_minor", "currency"))]
    return found[0].select(F.lit("orders").alias("entity"), "order_id", F.lit(None).cast("int").alias("line_no"),
                           "verdict", "source_rows", "gold_rows").unionByName(
        found[1].withColumn("entity", F.lit("lines")))


_MIXED = ("SELECT region, tbl AS \"table\", dt, CAST(count(*) AS BIGINT) AS records, true AS counted, CAST(0 AS BIGINT) AS "
          "bad_names, true AS named FROM landed GROUP BY ALL")


@query("object_landing_mixed", q.with_(_MIXED, q.EVENT_CHANGES, lg._ROUTED))
def object_landing_mixed(t: Tables) -> DataFrame:
    """JSON-lines objects by a stream, then by a batch job under the same root, the latter tried twice: each record once.

    The names are those of the files that are read, and the manifest counts what they hold.
    """
    root = scratch_path(t.spark, "objects")
    early = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp")
    jobs.land_bronze(StreamTables(t, "events").event_changes().where(early), root, scratch_path(t.spark, "checkpoint"),
                     strict=False, objects=True, once=True).awaitTermination()
    rest = landing.route(t.event_changes().where(~early)).where("reject is null")
    with written_for(rest.drop("timestamp", "reject"), "rest") as once:
        for attempt in ("attempt-1", "attempt-2"):
            land_objects(landing.bronze_rows(once, attempt), root, "rest")
    keys = ["region", "table", "dt"]
    named = landing.is_object_key(F.col("object_key"))
    files = object_scan(t.spark, root).groupBy(*keys, "bronze_object", "object_key").agg(F.count(F.lit(1)).alias("lines"))
    by_name = files.groupBy(*keys).agg(
        F.sum("lines").alias("records"), F.count(F.lit(1)).alias("files"), F.sum(F.when(~named, F.col("lines"))).alias("bad"))
    listed = object_counts(t.spark, root).withColumnRenamed("records", "listed")
    return by_name.join(listed, keys, "full").select(
        *keys, "records", F.coalesce(F.col("records") == F.col("listed"), F.lit(False)).alias("counted"),
        F.coalesce("bad", F.lit(0).cast("bigint")).alias("bad_names"),
        F.coalesce(F.col("files") == F.col("objects"), F.lit(False)).alias("named"))


@query("landing_mixed", q.with_(_LANDED, q.EVENT_CHANGES, lg._ROUTED))
def landing_mixed(t: Tables) -> DataFrame:
    """Parquet bronze by a stream and by a batch job under one root."""
    root = scratch_path(t.spark, "bronze")
    early = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp")
    jobs.land_bronze(StreamTables(t, "events").event_changes().where(early), root, scratch_path(t.spark, "checkpoint"),
                     strict=False, once=True).awaitTermination()
    rest = landing.route(t.event_changes().where(~early)).where("reject is null")
    for _ in range(2):
        tables.land(landing.bronze_rows(rest, "attempt-1"), root, "rest")
    return landed_profile(bronze_scan(t.spark, root))


# ------------------------------------------------------------------------------------ event store

_STORE = ("SELECT source_system, CAST(count(*) AS BIGINT) AS n_orders, CAST(sum(n_lines) AS BIGINT) AS n_lines, "
          "CAST(sum(minor) AS BIGINT) AS line_minor FROM (SELECT 'WEB_STORE_' || f.region AS source_system, "
          "f.event_order_id, f.ref, f.region FROM firsts f) o JOIN (SELECT f.event_order_id, f.region, "
          "CAST(count(l.order_id) AS BIGINT) AS n_lines, CAST(coalesce(sum(l.quantity * l.unit_price_minor), 0) AS BIGINT)"
          " AS minor FROM firsts f LEFT JOIN event_lines l ON l.order_id = f.event_order_id AND l.region = f.region "
          "GROUP BY ALL) x USING (event_order_id, region) GROUP BY source_system")


def store_profile(t: Tables, path: str) -> DataFrame:
    """Orders, lines and line amounts of an event store per source system."""
    rows = store.oms_order(t.spark, path).select("source_system", F.lit(1).alias("o"), F.lit(0).alias("l"),
                                                 F.lit(0).cast("bigint").alias("m"))
    lines = store.oms_order_line(t.spark, path).select(
        F.concat(F.lit("WEB_STORE_"), F.col("region")).alias("source_system"), F.lit(0).alias("o"),
        F.lit(1).alias("l"), F.col("line_total_minor").alias("m"))
    return rows.unionByName(lines).groupBy("source_system").agg(
        F.sum("o").alias("n_orders"), F.sum("l").alias("n_lines"), F.sum("m").alias("line_minor"))


@query("event_store_replay", q.with_(_STORE, *q.LINES, oq.EVENTS_SQL))
def event_store_replay(t: Tables) -> DataFrame:
    """Store half, all and all again, retry, then restart as a new stream at batch 0 with the other half: each once."""
    path = scratch_path(t.spark, "store")
    half = F.pmod(F.xxhash64("external_order_ref"), F.lit(2)) == 0
    with settings(t.spark, LONG_JOB), written_for(store.routed_messages(t.order_events()), "messages") as messages:
        for stream, batch, rows in (("a", 0, messages.where(half)), ("a", 1, messages), ("a", 1, messages),
                                    ("b", 0, messages.where(~half)), ("b", 1, messages.where("false"))):
            store.store_batch(rows, path, batch, stream)
    return store_profile(t, path)


@query("ingest_outcomes", q.with_("""
SELECT pass, outcome, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT p AS pass, CASE WHEN route <> 'OK' THEN route WHEN p = 'first' AND is_first THEN 'STORED' ELSE 'REPLAY' END
         AS outcome, 1 AS n FROM outcome_rows, (VALUES ('first'), ('second')) v(p))
GROUP BY ALL""", *q.LINES, oq.EVENTS_SQL, oq.OUTCOMES_SQL))
def ingest_outcomes(t: Tables) -> DataFrame:
    """What became of every message when all are stored, and again when a new stream brings them a second time."""
    path = scratch_path(t.spark, "store")
    with settings(t.spark, LONG_JOB), written_for(store.routed_messages(t.order_events()), "messages") as messages:
        for stream in ("first", "second"):
            store.store_batch(messages, path, 0, stream)
    return t.spark.read.parquet(f"{path}/outcomes").where("n > 0").groupBy(
        F.col("stream").alias("pass"), F.col("route").alias("outcome")).agg(F.sum("n").alias("n"))


@query("stream_ingest_orders", q.with_(_STORE, *q.LINES, oq.EVENTS_SQL))
def stream_ingest_orders(t: Tables) -> DataFrame:
    """Order events as a stream into the event store."""
    path = scratch_path(t.spark, "store")
    messages = StreamTables(t, "lineitem").order_events()
    jobs.ingest_orders(messages, path, scratch_path(t.spark, "checkpoint"), once=True).awaitTermination()
    return store_profile(t, path)


# ------------------------------------------------------------------------------- growth of a topic

#: Commit hours of the batches, in which a fault window lies.
FAULT_FROM, FAULT_UNTIL = dt.datetime(2026, 9, 12, 1, 0), dt.datetime(2026, 9, 12, 2, 15)

_GROWTH = f"""
SELECT error_code, CAST(count(*) FILTER (minute_no <= 60) AS BIGINT) AS before, CAST(count(*) AS BIGINT) AS after,
       CAST(count(*) FILTER (minute_no > 60) AS BIGINT) AS grown,
       CAST(count(*) FILTER (minute_no > 60 AND ref_out IS NOT NULL AND occurred_at IS NOT NULL) AS BIGINT) AS grown_complete
FROM (SELECT *, {oq._DLQ_CODE} AS error_code,
             60 * CASE failed_step WHEN 'pricing' THEN 1 WHEN 'confirm' THEN 2 ELSE 0 END
             + CASE WHEN region = 'CA' THEN 0 ELSE 30 END AS minute_no FROM dlq)
WHERE minute_no <= 135 GROUP BY error_code"""


@query("dlq_growth", q.with_(_GROWTH, *q.ORDERS, oq.DLQ_SQL))
def dlq_growth(t: Tables) -> DataFrame:
    """Dead letters before and after a fault window, and how many of the new ones are complete.

    Two streams commit three batches each, an hour apart; one batch is tried a second time, later, and changes nothing.
    """
    root = scratch_path(t.spark, "dead-letters")
    fields = written(events.dlq_missing(events.dlq_fields(oq.failures(t), oq.TEST_SECRET)), "failures")
    batch = F.when(F.col("failedStep") == "pricing", 1).when(F.col("failedStep") == "confirm", 2).otherwise(0)
    start = dt.datetime(2026, 9, 12)
    for stream, rows, minutes in (("ca", fields.where("region = 'CA'"), 0), ("rest", fields.where("region <> 'CA'"), 30)):
        for number in (0, 1, 2):
            snapshots.commit_batch(rows.where(batch == number), root, stream, number,
                                   start + dt.timedelta(minutes=60 * number + minutes))
    snapshots.commit_batch(fields, root, "ca", 1, start + dt.timedelta(hours=2))
    return snapshots.growth(t.spark, root, FAULT_FROM, FAULT_UNTIL, ("errorCode",), F.size("missing") == 0) \
        .withColumnRenamed("errorCode", "error_code")


# ---------------------------------------------------------------------------------------- streams

@query("stream_land_bronze", q.with_(_LANDED, q.EVENT_CHANGES, lg._ROUTED))
def stream_land_bronze(t: Tables) -> DataFrame:
    """The change stream into bronze by a file sink."""
    root = scratch_path(t.spark, "bronze")
    jobs.land_bronze(StreamTables(t, "events").event_changes(), root, scratch_path(t.spark, "checkpoint"),
                     strict=False, once=True).awaitTermination()
    return landed_profile(bronze_scan(t.spark, root))


@query("landing_balance", q.with_("""
SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN tombstone THEN 'tombstone' WHEN landed THEN 'landed' ELSE 'rejected' END AS outcome FROM balance)
GROUP BY outcome""", q.EVENT_CHANGES, lg._ROUTED, lg._BALANCE))
def landing_balance(t: Tables) -> DataFrame:
    """Landed, rejected and tombstones, from what the streams wrote; together they are the input."""
    root, side = scratch_path(t.spark, "bronze"), scratch_path(t.spark, "rejects")
    for start, path in ((jobs.land_bronze, root), (jobs.keep_rejects, side)):
        more = {"strict": False} if start is jobs.land_bronze else {}
        start(StreamTables(t, "events").event_changes(), path, scratch_path(t.spark, "checkpoint"), once=True,
              **more).awaitTermination()
    landed = bronze_scan(t.spark, root).select(F.lit("landed").alias("outcome"))
    kept = t.spark.read.parquet(side).select(
        F.when(F.col("reject") == landing.TOMBSTONE, "tombstone").otherwise("rejected").alias("outcome"))
    return landed.unionByName(kept).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("stream_restart", q.with_(_LANDED, q.EVENT_CHANGES, lg._ROUTED))
def stream_restart(t: Tables) -> DataFrame:
    """Land the first part of a topic, stop, land the rest from the saved offsets: no loss, no copy."""
    topic, root = scratch_path(t.spark, "topic"), scratch_path(t.spark, "bronze")
    checkpoint = scratch_path(t.spark, "checkpoint")
    messages = t.event_changes()
    early = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp")
    for part in (messages.where(early), messages.where(~early)):
        part.write.mode("append").parquet(topic)
        source = t.spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 4).parquet(topic)
        jobs.land_bronze(source, root, checkpoint, strict=False, once=True).awaitTermination()
    return landed_profile(bronze_scan(t.spark, root))


@query("stream_minute_counts", q.with_("""
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS n
FROM transcript GROUP BY 1""", q.TRANSCRIPT))
def stream_minute_counts(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "windows")
    jobs.window_counts(StreamTables(t, "events").transcript(), out, scratch_path(t.spark, "checkpoint"), "1 minute",
                       once=True).awaitTermination()
    return jobs.current_windows(t.spark, out).select(lg.stamp("window_start").alias("window_start"), "n")


@query("stream_sliding_dlq", q.with_("""
SELECT strftime(make_timestamp(b * 300000000), '%Y-%m-%d %H:%M:%S') AS window_start, dlq_depth
FROM (SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) - k AS b, CAST(count(*) AS BIGINT) AS dlq_depth
      FROM transcript, range(0, 2) r(k) WHERE status IN (0, 503) GROUP BY 1)""", q.TRANSCRIPT))
def stream_sliding_dlq(t: Tables) -> DataFrame:
    """The 10-minute window that moves by 5 minutes, as a stream."""
    out = scratch_path(t.spark, "windows")
    log = StreamTables(t, "events").transcript().where("status in (0, 503)")
    jobs.window_counts(log, out, scratch_path(t.spark, "checkpoint"), "10 minutes", "5 minutes", name="dlq_depth",
                       once=True).awaitTermination()
    return jobs.current_windows(t.spark, out).select(
        lg.stamp("window_start").alias("window_start"), "dlq_depth")


def restarted_windows(t: Tables, log: DataFrame, value: str | None = None, name: str = "n") -> str:
    """Five-minute window parts of a log that comes out of order, by a stream that is started anew half-way."""
    topic, out = scratch_path(t.spark, "topic"), scratch_path(t.spark, "windows")
    late = F.pmod(F.xxhash64("ts"), F.lit(3)) == 0
    for part in (log.where(~late), log.where(late)):
        part.write.mode("append").parquet(topic)
        source = t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(topic)
        jobs.window_parts(source, out, scratch_path(t.spark, "checkpoint"), "5 minutes", name=name, value=value,
                          once=True).awaitTermination()
    return out


@query("stream_p95_alert", ORACLES["alert_p95"])
def stream_p95_alert(t: Tables) -> DataFrame:
    """The p95 alert from window parts of a stream, after late rows and a new checkpoint."""
    log = t.transcript().select("ts", "time_ms")
    values = jobs.window_values(t.spark, restarted_windows(t, log, "time_ms"), "time_ms")
    return lg.minutes(alerts.p95_of_counts(values, limit=20_000), "window_start", "window_end")


@query("stream_denied_alert", ORACLES["alert_denied"])
def stream_denied_alert(t: Tables) -> DataFrame:
    """Refused actions per window from a stream, after late rows and a new checkpoint."""
    log = t.audit_events().where("error_code is not null").select(F.col("event_time").alias("ts"))
    counts = jobs.current_windows(t.spark, restarted_windows(t, log, name="denied_count"))
    return lg.minutes(counts.withColumn("fires", F.col("denied_count") > 1), "window_start", "window_end")


@query("stream_tamper_alert", ORACLES["alert_tamper"])
def stream_tamper_alert(t: Tables) -> DataFrame:
    """Attempts to silence the audit trail per window from a stream, after late rows and a new checkpoint."""
    log = t.audit_events().where(F.col("event_name").isin(*audit.TAMPER_EVENTS)).select(F.col("event_time").alias("ts"))
    counts = jobs.current_windows(t.spark, restarted_windows(t, log, name="tripwire"))
    return lg.minutes(counts.withColumn("fires", F.col("tripwire") >= 1), "window_start", "window_end")


@query("stream_freshness", q.with_(f"""
SELECT '{freshness.METRIC}' AS metric, CAST((1706745600000 - max(ts_ms)) // 1000 AS BIGINT) AS value, 'cdc' AS pipeline
FROM live""", q.EVENT_CHANGES, lg._ROUTED))
def stream_freshness(t: Tables) -> DataFrame:
    """A freshness line per published batch; the whole table is one batch here."""
    out = scratch_path(t.spark, "metrics")
    jobs.freshness_metrics(StreamTables(t, "events").event_changes(), out, scratch_path(t.spark, "checkpoint"),
                           clock_ms=lambda: 1_706_745_600_000, once=True).awaitTermination()
    return metric_lines(t.spark, out)


@query("stream_claims", ORACLES["idempotent_requests"])
def stream_claims(t: Tables) -> DataFrame:
    """Request claims with keyed state."""
    out = scratch_path(t.spark, "claims")
    claims.write_claims(StreamTables(t, "events").api_requests(), out, scratch_path(t.spark, "checkpoint"),
                        once=True).awaitTermination()
    return t.spark.read.parquet(out)
