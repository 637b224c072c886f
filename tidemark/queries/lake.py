"""Bronze, silver, quality, gold and reconciliation queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.envelopes import decode_header, is_valid
from tidemark.operators import dq, gold, latest, recon, silver
from tidemark.queries import sql as q
from tidemark.queries.registry import query
from tidemark.session import written
from tidemark.sources.adapters import ORDER_FIELDS, REPLAY_DATE, REPLAY_DT, Tables

DATE_KEY = int(REPLAY_DT)

@query("bronze_envelope_decode", q.with_("""
SELECT op, 'oms_order_line' AS table_name, region, CAST(count(*) AS BIGINT) AS n_rows,
       min(source_ts_ms) AS first_ts_ms, max(source_ts_ms) AS last_ts_ms,
       CAST(sum(CASE WHEN op <> 'd' THEN 1 ELSE 0 END) AS BIGINT) AS with_after,
       CAST(sum(CASE WHEN op <> 'c' THEN 1 ELSE 0 END) AS BIGINT) AS with_before
FROM line_versions GROUP BY op, region""", *q.LINES))
def bronze_envelope_decode(t: Tables) -> DataFrame:
    """Decode and validate line envelopes, then profile them by op and region."""
    decoded = decode_header(t.line_changes()).where(is_valid(F.col("after_json"), F.col("before_json")))
    region = F.coalesce(F.get_json_object("after_json", "$.region"), F.get_json_object("before_json", "$.region"))
    return decoded.groupBy("op", "table_name", region.alias("region")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("source_ts_ms").alias("first_ts_ms"),
        F.max("source_ts_ms").alias("last_ts_ms"), F.count("after_json").alias("with_after"),
        F.count("before_json").alias("with_before"))


_SILVER_ORDER = ("order_id, external_order_ref, source_system, store_id, region, customer_ref, channel, status, "
                 "reservation_id, total_amount_minor, currency, correlation_id, source_ts_ms")
_SILVER_LINE = ("order_id, line_no, sku_id, quantity, unit_price_minor, currency, region, source_ts_ms, "
                "line_total_minor")


@query("silver_orders", q.with_(f"SELECT {_SILVER_ORDER} FROM silver_orders", *q.ORDERS, q.ORDER_VERSIONS,
                                q.SILVER_ORDERS))
def silver_orders(t: Tables) -> DataFrame:
    return silver.silver_orders(t.order_changes())


_LINES_SQL = q.with_(f"SELECT {_SILVER_LINE} FROM silver_lines", *q.LINES, q.SILVER_LINES)


@query("silver_lines_latest", _LINES_SQL)
def silver_lines_latest(t: Tables) -> DataFrame:
    return silver.silver_lines(t.line_changes())


@query("silver_lines_latest_maxby", _LINES_SQL)
def silver_lines_latest_maxby(t: Tables) -> DataFrame:
    return silver.silver_lines(t.line_changes(), pick=latest.latest_per_key_by_max)


@query("silver_line_totals_by_currency", q.with_("""
SELECT currency, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(line_total_minor) AS BIGINT) AS total_minor
FROM silver_lines GROUP BY currency""", *q.LINES, q.SILVER_LINES))
def silver_line_totals_by_currency(t: Tables) -> DataFrame:
    return silver.silver_lines(t.line_changes()).groupBy("currency").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("line_total_minor").alias("total_minor"))


# ------------------------------------------------------------------------------------- quality

DQ_ORDER = ("source_ts_ms", "partition", "offset", "position")


def faulty_orders(t: Tables) -> DataFrame:
    """Order rows with nulls injected by key and a store outside the directory."""
    key = F.col("o_orderkey")
    hole = lambda c, m, r: F.when(key % m != r, F.col(c)).alias(c)
    return t.order_rows().select(
        hole("order_id", 211, 3), hole("store_id", 97, 1), hole("region", 89, 2), hole("total_amount_minor", 97, 1),
        hole("currency", 83, 4), F.col("o_orderkey").alias("seq"))


def faulty_lines(t: Tables) -> DataFrame:
    """Line versions (keys repeat) with nulls and a zero quantity injected by part."""
    key = F.col("l_partkey")
    return t.line_versions().select(
        "order_id", F.when(key % 307 != 5, F.col("line_no")).alias("line_no"),
        F.when(key % 101 != 1, F.col("sku_id")).alias("sku_id"),
        F.when(key % 103 == 2, 0).when(key % 107 != 3, F.col("quantity")).alias("quantity"),
        F.when(key % 101 != 1, F.col("unit_price_minor")).alias("unit_price_minor"),
        F.when(key % 109 != 4, F.col("currency")).alias("currency"),
        *DQ_ORDER)


ORDER_ROW = ("order_id", "store_id", "region", "total_amount_minor", "currency")
LINE_ROW = ("order_id", "line_no", "sku_id", "quantity", "unit_price_minor", "currency")

FAULTY_ORDERS = """
faulty_orders AS (
  SELECT CASE WHEN o_orderkey % 211 <> 3 THEN order_id END AS order_id,
         CASE WHEN o_orderkey % 97 <> 1 THEN store_id END AS store_id,
         CASE WHEN o_orderkey % 89 <> 2 THEN region END AS region,
         CASE WHEN o_orderkey % 97 <> 1 THEN total_amount_minor END AS total_amount_minor,
         CASE WHEN o_orderkey % 83 <> 4 THEN currency END AS currency, o_orderkey AS seq
  FROM order_rows)"""
FAULTY_LINES = """
faulty_lines AS (
  SELECT order_id, CASE WHEN l_partkey % 307 <> 5 THEN line_no END AS line_no,
         CASE WHEN l_partkey % 101 <> 1 THEN sku_id END AS sku_id,
         CASE WHEN l_partkey % 103 = 2 THEN 0 WHEN l_partkey % 107 <> 3 THEN quantity END AS quantity,
         CASE WHEN l_partkey % 101 <> 1 THEN unit_price_minor END AS unit_price_minor,
         CASE WHEN l_partkey % 109 <> 4 THEN currency END AS currency, source_ts_ms, part, off, position
  FROM line_versions)"""
_LKEY = "coalesce(order_id, 'null') || '|' || coalesce(CAST(line_no AS VARCHAR), 'null')"
DQ_V = f"""
v_order_complete AS (
  SELECT 'DQ-COMPLETE' AS rule_id, 'fact_orders' AS table_name, coalesce(order_id, 'null') AS row_key,
         'missing required field(s): [' || concat_ws(', ', CASE WHEN order_id IS NULL THEN 'order_id' END,
           CASE WHEN store_id IS NULL THEN 'store_id' END, CASE WHEN region IS NULL THEN 'region' END,
           CASE WHEN total_amount_minor IS NULL THEN 'total_amount_minor' END,
           CASE WHEN currency IS NULL THEN 'currency' END) || ']' AS reason,
         store_id AS f1, currency AS f2, total_amount_minor AS f3
  FROM faulty_orders WHERE order_id IS NULL OR store_id IS NULL OR region IS NULL OR total_amount_minor IS NULL
    OR currency IS NULL),
v_order_unique AS (
  SELECT 'DQ-UNIQUE' AS rule_id, 'fact_orders' AS table_name, coalesce(order_id, 'null') AS row_key,
         'duplicate key [order_id] = [' || coalesce(order_id, 'null')
           || '] (first occurrence kept, later occurrences quarantined)' AS reason,
         store_id AS f1, currency AS f2, total_amount_minor AS f3
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq) AS rn FROM faulty_orders) WHERE rn > 1),
v_order_ref AS (
  SELECT 'DQ-REFERENTIAL' AS rule_id, 'fact_orders' AS table_name, coalesce(order_id, 'null') AS row_key,
         'store_id=' || coalesce(store_id, 'null') || ' has no matching row in dim_store' AS reason,
         store_id AS f1, currency AS f2, total_amount_minor AS f3
  FROM faulty_orders WHERE store_id IS NULL OR store_id = 'ST-CN-03'),
good_orders AS (
  SELECT DISTINCT order_id FROM faulty_orders WHERE order_id IS NOT NULL AND order_id NOT IN (
    SELECT row_key FROM v_order_complete UNION SELECT row_key FROM v_order_unique UNION SELECT row_key FROM v_order_ref)),
v_line_complete AS (
  SELECT * FROM (
    SELECT 'DQ-COMPLETE' AS rule_id, 'fact_order_lines' AS table_name, {_LKEY} AS row_key,
           concat_ws('; ', CASE WHEN sku_id IS NULL THEN 'sku_id is null' END,
             CASE WHEN unit_price_minor IS NULL THEN 'unit_price_minor is null' END,
             CASE WHEN currency IS NULL THEN 'currency is null' END,
             CASE WHEN quantity IS NULL THEN 'quantity is null'
                  WHEN quantity <= 0 THEN 'quantity must be > 0, got ' || quantity END) AS reason,
           sku_id AS f1, currency AS f2, unit_price_minor AS f3 FROM faulty_lines) WHERE reason <> ''),
v_line_unique AS (
  SELECT 'DQ-UNIQUE' AS rule_id, 'fact_order_lines' AS table_name, {_LKEY} AS row_key,
         'duplicate key [order_id, line_no] = [' || coalesce(order_id, 'null') || ', '
           || coalesce(CAST(line_no AS VARCHAR), 'null')
           || '] (first occurrence kept, later occurrences quarantined)' AS reason,
         sku_id AS f1, currency AS f2, unit_price_minor AS f3
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line_no ORDER BY source_ts_ms, part, off, position) AS rn
        FROM faulty_lines) WHERE rn > 1),
v_line_ref AS (
  SELECT 'DQ-REFERENTIAL' AS rule_id, 'fact_order_lines' AS table_name, {_LKEY} AS row_key,
         'order_id=' || coalesce(order_id, 'null') || ' has no matching row in fact_orders' AS reason,
         sku_id AS f1, currency AS f2, unit_price_minor AS f3
  FROM faulty_lines l WHERE NOT EXISTS (SELECT 1 FROM good_orders g WHERE g.order_id = l.order_id)),
v_all AS (
  SELECT * FROM v_order_complete UNION ALL SELECT * FROM v_order_unique UNION ALL SELECT * FROM v_order_ref
  UNION ALL SELECT * FROM v_line_complete UNION ALL SELECT * FROM v_line_unique UNION ALL SELECT * FROM v_line_ref)"""
DQ_CTES = (q.ORDER_BASE, q.ORDER_ROWS, q.LINE_VERSIONS, FAULTY_ORDERS, FAULTY_LINES, DQ_V)


def known_stores(t: Tables) -> DataFrame:
    """The store directory as far as the orders use it: every store but the one outside of it."""
    return t.order_rows().select("store_id").distinct().where("store_id <> 'ST-CN-03'")


def dq_judged(t: Tables):
    """Faulty orders and lines, judged by all their rules in one pass each, and the rules."""
    o_rules = [dq.order_complete(), dq.UniqueRule(dq.FACT_ORDERS, ("order_id",), dq.UNIQUE, ("order_id",), ("seq",)),
               dq.ReferentialRule(dq.FACT_ORDERS, ("order_id",), dq.REFERENTIAL, "store_id", "dim_store",
                                  known_stores(t), "store_id")]
    orders = written(dq.judged(written(faulty_orders(t), "faulty-orders"), o_rules), "judged-orders")
    l_rules = dq.line_rules(DQ_ORDER, dq.passing_judged(orders, ["order_id"]))
    lines = dq.judged(written(faulty_lines(t), "faulty-lines"), l_rules)
    return (orders, o_rules), (lines, l_rules)


@query("dq_complete_orders", q.with_("SELECT row_key, reason FROM v_order_complete", *DQ_CTES))
def dq_complete_orders(t: Tables) -> DataFrame:
    return dq.order_complete().violations(faulty_orders(t)).select("row_key", "reason")


@query("dq_complete_lines", q.with_("SELECT row_key, reason FROM v_line_complete", *DQ_CTES))
def dq_complete_lines(t: Tables) -> DataFrame:
    return dq.line_complete().violations(faulty_lines(t)).select("row_key", "reason")


@query("dq_unique_lines", q.with_("SELECT row_key, reason, f1 AS sku_id FROM v_line_unique", *DQ_CTES))
def dq_unique_lines(t: Tables) -> DataFrame:
    pk = ("order_id", "line_no")
    found = dq.UniqueRule(dq.FACT_LINES, pk, dq.UNIQUE, pk, DQ_ORDER).violations(faulty_lines(t))
    return found.select("row_key", "reason", F.get_json_object("violating_row_json", "$.sku_id").alias("sku_id"))


@query("dq_referential_lines", q.with_("SELECT row_key, reason FROM v_line_ref", *DQ_CTES))
def dq_referential_lines(t: Tables) -> DataFrame:
    _, (lines, rules) = dq_judged(t)
    found = dq.violations_of(lines, rules).where(F.col("rule_id") == dq.REFERENTIAL)
    return found.select("row_key", "reason")


@query("dq_results", q.with_("""
SELECT rule_id, table_name, checked, coalesce(n, 0) AS violations,
       CASE WHEN coalesce(n, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT r.rule_id, t.table_name, t.checked
      FROM (VALUES ('DQ-COMPLETE'), ('DQ-UNIQUE'), ('DQ-REFERENTIAL')) r(rule_id),
           (SELECT 'fact_orders' AS table_name, count(*) AS checked FROM faulty_orders
            UNION ALL SELECT 'fact_order_lines', count(*) FROM faulty_lines) t)
LEFT JOIN (SELECT rule_id, table_name, count(*) AS n FROM v_all GROUP BY ALL) USING (rule_id, table_name)""", *DQ_CTES))
def dq_results(t: Tables) -> DataFrame:
    return dq.results(dq_judged(t))


@query("dq_quarantine_rows", q.with_("""
SELECT 'run-1' AS run_id, rule_id, table_name, row_key, reason, f1, f2, f3 FROM v_all""", *DQ_CTES))
def dq_quarantine_rows(t: Tables) -> DataFrame:
    orders, lines = dq_judged(t)
    rows = dq.quarantine_rows(dq.violations_of(*orders).unionByName(dq.violations_of(*lines)), "run-1")
    field = lambda a, b: F.coalesce(F.get_json_object("violating_row_json", f"$.{a}"),
                                    F.get_json_object("violating_row_json", f"$.{b}"))
    return rows.select(
        "run_id", "rule_id", "table_name", "row_key", "reason", field("store_id", "sku_id").alias("f1"),
        field("currency", "currency").alias("f2"),
        field("total_amount_minor", "unit_price_minor").cast("bigint").alias("f3"))


# ------------------------------------------------------------------------------- gold and recon

def silver_pair(t: Tables, fields: tuple[str, ...] = ORDER_FIELDS) -> tuple[DataFrame, DataFrame]:
    return silver.silver_orders(t.order_changes(), fields=fields), silver.silver_lines(t.line_changes())


def passed_pair(t: Tables, fields: tuple[str, ...] = ORDER_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Silver rows that pass the rules: the store directory has no ST-CN-03, so its orders are out.

    Silver keys are unique after the latest-row step, so the uniqueness rule is not run here again.
    """
    orders, lines = silver_pair(t, fields)
    ref = dq.ReferentialRule(dq.FACT_ORDERS, ("order_id",), dq.REFERENTIAL, "store_id", "dim_store", known_stores(t),
                             "store_id")
    good = dq.passing_unique(orders, ["order_id"], dq.order_complete(), ref)
    return good, dq.passing_unique(lines, ["order_id", "line_no"], dq.line_complete(), line_reference(good))


def line_reference(orders: DataFrame) -> dq.ReferentialRule:
    return dq.ReferentialRule(dq.FACT_LINES, ("order_id", "line_no"), dq.REFERENTIAL, "order_id", dq.FACT_ORDERS,
                              orders, "order_id")


GOOD = """
good AS (SELECT * FROM silver_orders WHERE store_id <> 'ST-CN-03'),
good_lines AS (SELECT l.* FROM silver_lines l WHERE l.order_id IN (SELECT order_id FROM good))"""
GOLD_CTES = (*q.LAKE, GOOD)


@query("gold_fact_orders", q.with_(f"""
SELECT order_id, store_id, region, customer_ref, channel, source_system, correlation_id, total_amount_minor, currency,
       {DATE_KEY} AS date_key, '{REPLAY_DT}' AS dt FROM good""", *GOLD_CTES))
def gold_fact_orders(t: Tables) -> DataFrame:
    return gold.fact_orders(passed_pair(t)[0], REPLAY_DATE)


@query("gold_fact_order_lines", q.with_(f"""
SELECT order_id, line_no, sku_id, quantity, unit_price_minor, currency, line_total_minor, '{REPLAY_DT}' AS dt
FROM good_lines""", *GOLD_CTES))
def gold_fact_order_lines(t: Tables) -> DataFrame:
    return gold.fact_order_lines(passed_pair(t, ORDER_ROW)[1], REPLAY_DATE)


@query("gold_dim_sku", q.with_(f"SELECT DISTINCT sku_id, '{REPLAY_DT}' AS dt FROM good_lines", *GOLD_CTES))
def gold_dim_sku(t: Tables) -> DataFrame:
    return gold.dim_sku(passed_pair(t, ORDER_ROW)[1], REPLAY_DATE)


@query("gold_dim_store", q.with_(f"SELECT DISTINCT store_id, region, '{REPLAY_DT}' AS dt FROM good", *GOLD_CTES))
def gold_dim_store(t: Tables) -> DataFrame:
    return gold.dim_store(passed_pair(t, ORDER_ROW)[0], REPLAY_DATE)


@query("gold_dim_date", """
SELECT DISTINCT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, strftime(d, '%Y-%m-%d') AS cal_date,
       CAST(isodow(d) AS INTEGER) AS day_of_week, strftime(d, '%Y%m%d') AS dt
FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def gold_dim_date(t: Tables) -> DataFrame:
    days = t.table("orders").select(F.col("o_orderdate").cast("date").alias("cal_date")).distinct()
    return gold.dim_dates(days).withColumn("cal_date", F.date_format("cal_date", "yyyy-MM-dd"))


#: What the comparison reads of an order.
RECON_ORDER = ("order_id", "total_amount_minor", "currency")


def recon_frames(t: Tables, phantom: bool = False) -> DataFrame:
    """Per-currency comparison of the order system against gold built from the change stream.

    Orders are compared and are the parents of the lines; they are written once with the columns that this takes.
    """
    silver_o, silver_l = silver_pair(t, RECON_ORDER)
    silver_o = written(silver_o.select(*RECON_ORDER), "silver-orders")
    lines = dq.passing_unique(silver_l, ["order_id", "line_no"], dq.line_complete(), line_reference(silver_o))
    day_orders = recon.source_day(t.oms_orders(), REPLAY_DATE)
    if phantom:
        extra = t.spark.range(1).select(
            F.lit("phantom-1").alias("order_id"), F.lit(9999).cast("bigint").alias("total_amount_minor"),
            F.lit("CAD").alias("currency"))
        day_orders = day_orders.select("order_id", "total_amount_minor", "currency").unionByName(extra)
    oms_lines = recon.source_lines(oms_lines_of(t), day_orders)
    return recon.by_currency(day_orders, oms_lines, gold.fact_orders(silver_o, REPLAY_DATE, RECON_ORDER),
                             gold.fact_order_lines(lines, REPLAY_DATE))


def oms_lines_of(t: Tables) -> DataFrame:
    """`oms_order_line` at the end of the day, with the line total stored by the order system."""
    live = latest.latest_per_key_by_max(
        t.line_versions().select("order_id", "line_no", "quantity", "unit_price_minor", "currency", "op",
                                 *latest.CHANGE_ORDER),
        ["order_id", "line_no"], deleted=F.col("op") == "d")
    return live.withColumn("line_total_minor", F.col("quantity").cast("bigint") * F.col("unit_price_minor"))


def recon_sql(phantom: bool) -> tuple[str, ...]:
    extra = "UNION ALL SELECT 'phantom-1', 9999, 'CAD'" if phantom else ""
    return (*q.LAKE, q.OMS_ORDERS, f"""
src AS (SELECT order_id, total_amount_minor, currency FROM oms_orders {extra}),
src_lines AS (SELECT l.* FROM silver_lines l SEMI JOIN src USING (order_id)),
gold_lines AS (SELECT l.* FROM silver_lines l SEMI JOIN silver_orders USING (order_id)),
sides AS (
  SELECT 'orders' AS entity, currency, 1 AS s, count(*) AS n, sum(total_amount_minor) AS m FROM src GROUP BY ALL
  UNION ALL SELECT 'orders', currency, 0, count(*), sum(total_amount_minor) FROM silver_orders GROUP BY ALL
  UNION ALL SELECT 'lines', currency, 1, count(*), sum(line_total_minor) FROM src_lines GROUP BY ALL
  UNION ALL SELECT 'lines', currency, 0, count(*), sum(line_total_minor) FROM gold_lines GROUP BY ALL),
rec AS (
  SELECT entity, currency, CAST(sum(CASE WHEN s = 1 THEN n ELSE 0 END) AS BIGINT) AS source_rows,
         CAST(sum(CASE WHEN s = 0 THEN n ELSE 0 END) AS BIGINT) AS gold_rows,
         CAST(sum(CASE WHEN s = 1 THEN m ELSE 0 END) AS BIGINT) AS source_minor,
         CAST(sum(CASE WHEN s = 0 THEN m ELSE 0 END) AS BIGINT) AS gold_minor
  FROM sides GROUP BY entity, currency)""")


_REC = "SELECT entity, currency, source_rows, gold_rows, source_minor, gold_minor, source_minor = gold_minor AS match FROM rec"
_SUMMARY = """
SELECT CAST(sum(CASE WHEN entity = 'orders' THEN source_rows ELSE 0 END) AS BIGINT) AS orders_source,
       CAST(sum(CASE WHEN entity = 'orders' THEN gold_rows ELSE 0 END) AS BIGINT) AS orders_gold,
       CAST(sum(CASE WHEN entity = 'lines' THEN source_rows ELSE 0 END) AS BIGINT) AS lines_source,
       CAST(sum(CASE WHEN entity = 'lines' THEN gold_rows ELSE 0 END) AS BIGINT) AS lines_gold,
       bool_and(source_minor = gold_minor) AND sum(source_rows) = sum(gold_rows) AS all_match FROM rec"""


@query("recon_by_currency", q.with_(_REC, *recon_sql(False)))
def recon_by_currency(t: Tables) -> DataFrame:
    return recon.in_report_order(recon_frames(t)).drop("in_source")


@query("recon_counts", q.with_(f"SELECT orders_source, orders_gold, lines_source, lines_gold FROM ({_SUMMARY})",
                               *recon_sql(False)))
def recon_counts(t: Tables) -> DataFrame:
    return recon.summary(recon_frames(t)).drop("all_match")


@query("recon_all_match", q.with_(_SUMMARY, *recon_sql(False)))
def recon_all_match(t: Tables) -> DataFrame:
    return recon.summary(recon_frames(t))


@query("recon_negative_control", q.with_(_SUMMARY, *recon_sql(True)))
def recon_negative_control(t: Tables) -> DataFrame:
    """A phantom source row must turn the comparison red."""
    return recon.summary(recon_frames(t, phantom=True))


@query("recon_report_row", q.with_(f"""
SELECT 'run-1' AS run_id, '{REPLAY_DATE}' AS business_date, s.*,
       (SELECT '[' || string_agg('{{"currency":"' || currency || '","sourceMinor":' || source_minor || ',"goldMinor":'
          || gold_minor || ',"match":' || (source_minor = gold_minor) || '}}', ',' ORDER BY currency) || ']'
        FROM rec WHERE entity = 'orders') AS totals_json,
       (SELECT '[' || string_agg('{{"currency":"' || currency || '","sourceMinor":' || source_minor || ',"goldMinor":'
          || gold_minor || ',"match":' || (source_minor = gold_minor) || '}}', ',' ORDER BY currency) || ']'
        FROM rec WHERE entity = 'lines') AS line_totals_json
FROM ({_SUMMARY}) s""", *recon_sql(False)))
def recon_report_row(t: Tables) -> DataFrame:
    return recon.report_row(recon_frames(t), "run-1", REPLAY_DATE)


@query("recon_source_day", """
SELECT currency_day AS day, CAST(count(*) AS BIGINT) AS n_orders, CAST(sum(minor) AS BIGINT) AS total_minor
FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN '1900-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS currency_day,
             CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS minor FROM orders)
WHERE currency_day IN ('1900-01-01', '1998-03-05') GROUP BY ALL""")
def recon_source_day(t: Tables) -> DataFrame:
    """Source rows of two business dates, null ingest times counting as 1900-01-01."""
    orders = t.table("orders").select(
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("timestamp")).alias("ingested_at"),
        (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("minor"))
    parts = [
        recon.source_day(orders, day).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("minor").alias("total_minor"))
        .where("n_orders > 0").withColumn("day", F.lit(day.isoformat()))
        for day in (recon.NULL_DATE, dt.date(1998, 3, 5))
    ]
    return parts[0].unionByName(parts[1])


@query("recon_skew_rows", q.with_(f"""
SELECT order_id, CASE WHEN o_orderkey % 100 = 0 THEN '20260913' ELSE '{REPLAY_DT}' END AS source_dt,
       CASE WHEN o_orderkey % 70 <> 0 THEN '{REPLAY_DT}' END AS gold_dt
FROM oms_orders WHERE o_orderkey % 100 = 0 OR o_orderkey % 70 = 0""", *q.ORDERS, q.OMS_ORDERS))
def recon_skew_rows(t: Tables) -> DataFrame:
    """Orders that gold holds under another day or not at all: some are ingested after midnight, some lost."""
    key = F.col("kafka_offset")
    late = F.when(key % 100 == 0, F.col("ingested_at") + F.expr("interval 1 day")).otherwise(F.col("ingested_at"))
    stored = t.oms_orders().where(key % 70 != 0).select("order_id", F.lit(REPLAY_DT).alias("dt"))
    return recon.skew_rows(t.oms_orders().withColumn("ingested_at", late), stored)
