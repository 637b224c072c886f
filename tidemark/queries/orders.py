"""Order-request queries: masking, keys, prices, validation, ids, ingest, events, stock, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import masking, money
from tidemark.functions.regions import is_known_store, region_of_store
from tidemark.functions.text import idempotency_key
from tidemark.operators import asof, claims, events, ingest, latest, orders, sequence, stock
from tidemark.queries import sql as q
from tidemark.queries.registry import query
from tidemark.session import written
from tidemark.sources.adapters import REPLAY_MS, TEST_SECRET, Tables, materialized, padded, replaced, sku_of_part
from tidemark.sources.lake import price_list

KNOWN_STORES_SQL = "('ST-CA-01','ST-CA-02','ST-CA-03','ST-SG-01','ST-SG-02','ST-SG-03','ST-CN-01','ST-CN-02')"


# --------------------------------------------------------------------------------- scalar rules

@query("mask_customer_ref", q.with_("SELECT order_id, region, customer_ref FROM order_rows", *q.ORDERS))
def mask_customer_ref(t: Tables) -> DataFrame:
    return t.order_rows().select("order_id", "region", masking.mask_customer_ref(
        F.col("customer_ref_clear"), F.col("region"), TEST_SECRET).alias("customer_ref"))


@query("idempotency_keys", q.with_("""
SELECT order_id, CASE WHEN o_orderkey % 4 = 0 THEN 'key-' || o_orderkey
                      ELSE sha256(source_system || external_order_ref) END AS idem_key FROM order_rows""", *q.ORDERS))
def idempotency_keys(t: Tables) -> DataFrame:
    """A header on every fourth request (padded with blanks), a blank one on the next, none otherwise."""
    key = F.col("o_orderkey")
    header = F.when(key % 4 == 0, F.concat(F.lit("  key-"), key.cast("string"), F.lit(" "))).when(key % 4 == 1, "  ")
    return t.order_rows().select("order_id", idempotency_key(
        header, F.col("source_system"), F.col("external_order_ref")).alias("idem_key"))


@query("region_currency", q.with_(f"""
SELECT shown AS store_id, r AS region, {q.currency('r')} AS currency, CAST(count(*) AS BIGINT) AS n_orders
FROM (SELECT shown, CASE WHEN k % 6 IN (3, 4, 5) THEN NULL ELSE region END AS r
      FROM (SELECT o_orderkey AS k, region, CASE o_orderkey % 6 WHEN 1 THEN lower(store_id) WHEN 2 THEN store_id || '9'
                     WHEN 3 THEN substr(store_id, 1, 5) WHEN 4 THEN 'XX-' || region || '-01' WHEN 5 THEN 'ST-ZZ-01'
                     ELSE store_id END AS shown FROM order_rows)) GROUP BY ALL""", *q.ORDERS))
def region_currency(t: Tables) -> DataFrame:
    """Region and currency of store ids, malformed ones included."""
    k, store = F.col("o_orderkey") % 6, F.col("store_id")
    shown = (F.when(k == 1, F.lower(store)).when(k == 2, F.concat(store, F.lit("9")))
             .when(k == 3, F.substring(store, 1, 5)).when(k == 4, F.concat(F.lit("XX-"), F.col("region"), F.lit("-01")))
             .when(k == 5, "ST-ZZ-01").otherwise(store))
    named = t.order_rows().select(shown.alias("store_id")).withColumn("region", region_of_store(F.col("store_id")))
    return named.withColumn("currency", money.currency_of_region(F.col("region"))).groupBy(
        "store_id", "region", "currency").agg(F.count(F.lit(1)).alias("n_orders"))


def catalog(t: Tables) -> DataFrame:
    """Parts as SKUs with a base price in CAD minor units."""
    return t.table("part").select(
        padded("PART-", F.col("p_partkey"), 9).alias("sku_id"), F.col("p_brand").alias("category"),
        money.to_minor(F.col("p_retailprice")).alias("base_price_cad_minor"))


def _convert(base: str, cur: str) -> str:
    factor = f"CASE {cur} WHEN 'CAD' THEN 1.00 WHEN 'SGD' THEN 0.98 ELSE 5.13 END"
    return f"CAST(round(CAST({base} AS DECIMAL(20,0)) * CAST({factor} AS DECIMAL(6,2)), 0) AS BIGINT)"


@query("price_convert", q.with_(f"""
SELECT {q.padded('PART-', 'p_partkey', 9)} AS sku_id, c.currency, 'STD-2026' AS price_list_code,
       {_convert(q.minor('p_retailprice'), 'c.currency')} AS unit_price_minor
FROM part, (VALUES ('CAD'), ('SGD'), ('CNY')) c(currency)""", "one AS (SELECT 1)"))
def price_convert(t: Tables) -> DataFrame:
    """Every SKU in every currency, whatever price list was asked for."""
    skus = catalog(t).withColumn("currency", F.explode(F.array(*[F.lit(c) for c in money.FX_FROM_CAD])))
    return skus.select(
        "sku_id", "currency", orders.applied_price_list(F.lit("OTHER")).alias("price_list_code"),
        money.convert_from_cad(F.col("base_price_cad_minor"), F.col("currency")).alias("unit_price_minor"))


@query("price_by_list", q.with_(f"""
SELECT {q.padded('PART-', 'p_partkey', 9)} AS sku_id, c.currency, 'STD-2026' AS price_list_code,
       '2026-12-31' AS valid_until, {_convert(q.minor('p_retailprice'), 'c.currency')} AS unit_price_minor
FROM part, (VALUES ('CAD'), ('SGD'), ('CNY')) c(currency)""", "one AS (SELECT 1)"))
def price_by_list(t: Tables) -> DataFrame:
    """The same prices by joining the price list, one row per currency, valid on a day."""
    skus = catalog(t).withColumn("currency", F.explode(F.array(*[F.lit(c) for c in money.FX_FROM_CAD])))
    day = F.lit("2026-06-30").cast("date")
    prices = price_list(t.spark).where(day.between(F.col("effective_from"), F.col("valid_until")))
    return skus.join(prices, "currency").select(
        "sku_id", "currency", "price_list_code", F.date_format("valid_until", "yyyy-MM-dd").alias("valid_until"),
        F.round(F.col("base_price_cad_minor").cast("decimal(20,0)") * F.col("factor"), 0).cast("bigint")
        .alias("unit_price_minor"))


@query("order_pricing", q.with_(f"""
SELECT order_id, currency, CAST(sum({_convert('unit_price_minor', 'currency')} * quantity) AS BIGINT)
         AS total_amount_minor, CAST(count(*) AS BIGINT) AS line_count
FROM line_versions GROUP BY order_id, currency""", *q.LINES))
def order_pricing(t: Tables) -> DataFrame:
    lines = t.line_versions().select("order_id", padded("PART-", F.col("l_partkey"), 9).alias("sku_id"), "quantity",
                                     "currency")
    return orders.order_totals(orders.price_lines(lines, catalog(t)))


# ------------------------------------------------------------------------------------ validation

def faulty_requests(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order requests, their lines and the SKU directory, with faults injected by key."""
    key = F.col("o_orderkey")
    heads = t.order_rows().select(
        "order_id", F.when(key % 41 != 0, F.col("source_system")).alias("audit_source"),
        F.when(key % 43 == 0, " ").otherwise(F.col("correlation_id")).alias("correlation_id"),
        F.when(key % 47 == 0, " ").otherwise(F.concat(F.lit("WEB-"), F.floor(key / 2).cast("string")))
        .alias("external_order_ref"),
        "source_system", "store_id", F.col("ingested_at_ms").alias("received_at"))
    lines = t.line_versions().select(
        "order_id", "line_no", "sku_id", F.when(F.col("l_partkey") % 53 == 0, 0).otherwise(F.col("quantity"))
        .alias("quantity"), "currency")
    skus = t.table("part").select(padded("SKU-", F.col("p_partkey") % 50 + 1, 4).alias("sku_id")).where(
        "sku_id <> 'SKU-0050'")
    return heads, lines, skus


_FAULTS = f"""
req AS (
  SELECT order_id, CASE WHEN o_orderkey % 41 <> 0 THEN source_system END AS audit_source,
         CASE WHEN o_orderkey % 43 = 0 THEN ' ' ELSE correlation_id END AS correlation_id,
         CASE WHEN o_orderkey % 47 = 0 THEN ' ' ELSE 'WEB-' || (o_orderkey // 2) END AS ref, source_system, store_id,
         ingested_at_ms AS received_at FROM order_rows),
lf AS (
  SELECT order_id, count(*) AS n, arg_min(code, (line_no, code)) FILTER (code IS NOT NULL) AS code
  FROM (SELECT order_id, line_no, CASE WHEN sku_id = 'SKU-0050' THEN 'ORD-UNKNOWN-SKU'
                                       WHEN l_partkey % 53 = 0 OR quantity < 1 THEN 'ORD-BAD-QUANTITY' END AS code
        FROM line_versions) GROUP BY order_id),
own AS (
  SELECT r.*, CASE WHEN audit_source IS NULL OR trim(correlation_id) = '' THEN 'ORD-MISSING-AUDIT'
                   WHEN trim(ref) = '' THEN 'ORD-BAD-REF'
                   WHEN store_id NOT IN {KNOWN_STORES_SQL} THEN 'ORD-UNKNOWN-STORE'
                   WHEN n IS NULL THEN 'ORD-BAD-QUANTITY' ELSE code END AS own
  FROM req r LEFT JOIN lf USING (order_id)),
ranked AS (
  SELECT *, first_value(order_id) OVER w AS winner, row_number() OVER w AS rn FROM own
  WHERE own IS NULL WINDOW w AS (PARTITION BY source_system, ref ORDER BY received_at, order_id))"""


@query("order_validation_first_error", q.with_("""
SELECT order_id, own AS fault, CAST(NULL AS VARCHAR) AS original_order_id FROM own WHERE own IS NOT NULL
UNION ALL SELECT order_id, CASE WHEN rn > 1 THEN 'ORD-DUP-REF' END, CASE WHEN rn > 1 THEN winner END FROM ranked""",
                                               *q.ORDERS, q.LINE_VERSIONS, _FAULTS))
def order_validation_first_error(t: Tables) -> DataFrame:
    heads, lines, skus = faulty_requests(t)
    return orders.first_fault(heads, lines, skus, is_known_store(F.col("store_id"))).select(
        "order_id", "fault", "original_order_id")


@query("order_job", q.with_(f"""
SELECT order_id, 'ORD-2026-' || lpad(CAST(row_number() OVER (ORDER BY received_at, order_id) AS VARCHAR), 6, '0')
         AS erp_order_id, currency, total_amount_minor, line_count
FROM (SELECT r.order_id, r.received_at, v.currency, CAST(count(*) AS BIGINT) AS line_count,
             CAST(sum({_convert('base', 'v.currency')} * v.quantity) AS BIGINT) AS total_amount_minor
      FROM ranked r JOIN line_versions v USING (order_id) JOIN sku_prices USING (sku_id) WHERE rn = 1 GROUP BY ALL)""",
                             *q.ORDERS, q.LINE_VERSIONS, _FAULTS, f"""
sku_prices AS (SELECT {q.padded('SKU-', '(p_partkey % 50 + 1)', 4)} AS sku_id, max({q.minor('p_retailprice')}) AS base
               FROM part GROUP BY 1)"""))
def order_job(t: Tables) -> DataFrame:
    """Requests with faults: validated, and the accepted ones priced, totalled and numbered."""
    heads, lines, skus = faulty_requests(t)
    prices = t.table("part").groupBy(padded("SKU-", F.col("p_partkey") % 50 + 1, 4).alias("sku_id")).agg(
        F.max(money.to_minor(F.col("p_retailprice"))).alias("base_price_cad_minor"))
    accepted, _ = orders.take_orders(heads, lines, skus.distinct().join(prices, "sku_id"),
                                     is_known_store(F.col("store_id")))
    return accepted.select("order_id", "erp_order_id", "currency", "total_amount_minor", "line_count")


def canonical_requests(t: Tables) -> DataFrame:
    """Canonical order JSON with one kind of schema fault per remainder; prices of parts are not needed for it."""
    f = F.col("l_partkey") % 28
    qty = F.when(f.isin(7, 15), 0).when(f == 8, 1000).otherwise(F.col("l_quantity").cast("int"))
    line = F.struct(
        F.when(f == 6, "BAD").otherwise(sku_of_part(F.col("l_partkey"))).alias("skuId"), qty.alias("quantity"),
        F.when(f == 12, F.lit(5)).alias("price"))
    stamp = F.struct(
        F.lit("WEB").alias("sourceSystem"),
        F.when(f == 10, "yesterday").otherwise("2026-09-12T08:00:00Z").alias("receivedAt"),
        F.concat(F.lit("c-"), F.col("l_orderkey").cast("string")).alias("correlationId"))
    lines = F.when(f == 5, F.filter(F.array(line), lambda _: F.lit(False))).when(
        f == 14, F.array_repeat(line, 51)).otherwise(F.array(line))
    body = F.struct(
        F.when(f == 1, "").when(f == 2, F.repeat(F.lit("x"), 70)).when(
            f != 0, F.concat(F.lit("WEB-"), F.col("l_orderkey").cast("string"))).alias("externalOrderRef"),
        F.lit("WEB").alias("sourceSystem"),
        F.when(f.isin(3, 15), "ST-XX-01").otherwise(F.concat(F.lit("ST-"), F.col("region"), F.lit("-01")))
        .alias("storeId"),
        F.when(f == 4, "FAX").otherwise("POS").alias("channel"),
        lines.alias("lines"), F.when(f != 9, stamp).alias("audit"), F.when(f == 11, F.lit(5)).alias("amount"))
    text = replaced(F.to_json(body), f, {
        16: ("^\\{", '{"customerRef":null,'), 17: ('"quantity":([0-9]+)', '"quantity":$1.5'),
        18: ('"externalOrderRef":"[^"]*"', '"externalOrderRef":5'),
        19: ('"sourceSystem":"WEB",', '"sourceSystem":{"a":1},'), 20: ('"quantity":([0-9]+)', '"quantity":"$1"'),
        21: ('"lines":\\[([^\\]]*)\\]', '"lines":$1'), 22: ('"quantity":([0-9]+)', '"quantity":$1.0'),
        23: ('"lines":\\[([^\\]]*)\\]', '"lines":[7]'), 24: ('"channel":"POS"', '"channel":null'),
        25: ('"audit":\\{[^}]*\\}', '"audit":"now"')})
    value = F.when(f == 13, "{oops").when(f == 26, "[1]").otherwise(text)
    return materialized(t.order_lines(), value=value).select("value")


@query("canonical_validation", q.with_("""
SELECT errors, CAST(count(*) AS BIGINT) AS n_orders FROM (
  SELECT CASE l_partkey % 28
    WHEN 0 THEN '$.externalOrderRef: required'
    WHEN 1 THEN '$.externalOrderRef: must be at least 1 characters long'
    WHEN 2 THEN '$.externalOrderRef: must be at most 64 characters long'
    WHEN 3 THEN '$.storeId: does not match the pattern'
    WHEN 4 THEN '$.channel: not in the enumeration'
    WHEN 5 THEN '$.lines: must have at least 1 item'
    WHEN 6 THEN '$.lines[0].skuId: does not match the pattern'
    WHEN 7 THEN '$.lines[0].quantity: must be at least 1'
    WHEN 8 THEN '$.lines[0].quantity: must be at most 999'
    WHEN 9 THEN '$.audit: required'
    WHEN 10 THEN '$.audit.receivedAt: date-time expected'
    WHEN 11 THEN '$.amount: not allowed'
    WHEN 12 THEN '$.lines[0].price: not allowed'
    WHEN 13 THEN 'request body is not valid JSON'
    WHEN 14 THEN '$.lines: must have at most 50 items'
    WHEN 15 THEN '$.lines[0].quantity: must be at least 1 | $.storeId: does not match the pattern'
    WHEN 16 THEN '$.customerRef: string expected'
    WHEN 17 THEN '$.lines[0].quantity: integer expected'
    WHEN 18 THEN '$.externalOrderRef: string expected'
    WHEN 19 THEN '$.audit.sourceSystem: string expected | $.sourceSystem: string expected'
    WHEN 20 THEN '$.lines[0].quantity: integer expected'
    WHEN 21 THEN '$.lines: array expected'
    WHEN 23 THEN '$.lines[0]: object expected'
    WHEN 24 THEN '$.channel: not in the enumeration'
    WHEN 25 THEN '$.audit: object expected'
    WHEN 26 THEN '$: object expected'
    ELSE '' END AS errors FROM lineitem) GROUP BY errors""", "one AS (SELECT 1)"))
def canonical_validation(t: Tables) -> DataFrame:
    checked = orders.canonical_errors(canonical_requests(t))
    return checked.groupBy(F.array_join("errors", " | ").alias("errors")).agg(F.count(F.lit(1)).alias("n_orders"))


@query("first_wins_orders", q.with_("""
SELECT source_system, ref AS external_order_ref, order_id FROM (
  SELECT source_system, 'WEB-' || (o_orderkey // 4) AS ref, order_id,
         row_number() OVER (PARTITION BY source_system, o_orderkey // 4 ORDER BY ingested_at_ms, order_id) AS rn
  FROM order_rows) WHERE rn = 1""", *q.ORDERS))
def first_wins_orders(t: Tables) -> DataFrame:
    refs = t.order_rows().select(
        "source_system", F.concat(F.lit("WEB-"), F.floor(F.col("o_orderkey") / 4).cast("string"))
        .alias("external_order_ref"), "order_id", "ingested_at_ms")
    return latest.first_per_key(refs, ingest.BUSINESS_KEY, ("ingested_at_ms", "order_id")).drop("ingested_at_ms")


@query("order_ids_sequential", q.with_("""
SELECT order_id, row_number() OVER (ORDER BY ingested_at_ms, order_id) AS row_no,
       'ORD-2026-' || lpad(CAST(row_number() OVER (ORDER BY ingested_at_ms, order_id) AS VARCHAR), 6, '0') AS erp_order_id
FROM order_rows""", *q.ORDERS))
def order_ids_sequential(t: Tables) -> DataFrame:
    rows = t.order_rows().select("order_id", "ingested_at_ms")
    return sequence.number_rows(rows, ("ingested_at_ms", "order_id")).select(
        "order_id", "row_no", sequence.order_id(F.col("row_no")).alias("erp_order_id"))


# ---------------------------------------------------------------------------------------- ingest

_FAULT = "(l_partkey + line_no) % 32"
EVENTS_SQL = f"""
ev AS (
  SELECT *, {_FAULT} AS fault, CASE {_FAULT}
      WHEN 10 THEN 'event payload is null or blank'
      WHEN 1 THEN 'event payload is not valid JSON'
      WHEN 11 THEN 'event payload is not a JSON object'
      WHEN 2 THEN 'event is missing required business key(s): orderId, externalOrderRef, audit.sourceSystem'
      WHEN 3 THEN 'event is missing required business key(s): orderId, externalOrderRef, audit.sourceSystem'
      WHEN 4 THEN 'event is missing required business key(s): orderId, externalOrderRef, audit.sourceSystem'
      WHEN 5 THEN 'lines[0] quantity must be >= 1, got 0'
      WHEN 6 THEN 'lines[0] is missing unitPriceMinor/currency (and no unitPrices fallback)'
      WHEN 12 THEN 'lines[0] is missing unitPriceMinor/currency (and no unitPrices fallback)'
      WHEN 15 THEN 'lines[0] is missing skuId or quantity'
      WHEN 16 THEN 'lines[0] quantity must be >= 1, got 0'
      WHEN 17 THEN 'lines[0] is missing unitPriceMinor/currency (and no unitPrices fallback)'
      WHEN 9 THEN 'lines[1] is missing skuId or quantity' END AS reason,
    order_id || '-' || line_no AS event_order_id, 'WEB-' || l_orderkey || '-' || line_no AS ref
  FROM line_versions),
ok AS (SELECT * FROM ev WHERE reason IS NULL AND fault <> 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY 'WEB_STORE_' || region, ref
                                  ORDER BY source_ts_ms, part, off) AS rn FROM ok) WHERE rn = 1),
event_lines AS (
  SELECT event_order_id AS order_id, 0 AS line_no, sku_id, quantity,
         CASE WHEN fault = 7 THEN unit_price_minor + 7 ELSE unit_price_minor END AS unit_price_minor, currency,
         fault = 7 AS from_offer, region FROM firsts WHERE fault <> 8
  UNION ALL
  SELECT event_order_id, 1, {q.padded('SKU-', '(l_partkey % 47 + 1)', 4)}, 1, unit_price_minor + 1, currency, false,
         region FROM firsts WHERE fault <> 8)"""


OUTCOMES_SQL = """
outcome_rows AS (
  SELECT 'OK' AS route, row_number() OVER (PARTITION BY 'WEB_STORE_' || region, ref
                                           ORDER BY source_ts_ms, part, off) = 1 AS is_first FROM ok
  UNION ALL
  SELECT CASE WHEN fault = 0 THEN 'TOMBSTONE' ELSE 'POISON' END, false FROM ev
  WHERE fault = 0 OR reason IS NOT NULL)"""


@query("poison_routing", q.with_("""
SELECT route, reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN fault = 0 THEN 'TOMBSTONE' WHEN reason IS NOT NULL THEN 'POISON' ELSE 'OK' END AS route, reason
  FROM ev) GROUP BY ALL""", *q.LINES, EVENTS_SQL))
def poison_routing(t: Tables) -> DataFrame:
    return ingest.routed(ingest.parse_events(t.order_events())).groupBy("route", "reason").agg(
        F.count(F.lit(1)).alias("n"))


def stored_events(t: Tables) -> DataFrame:
    return ingest.first_events(ingest.routed(ingest.parse_events(t.order_events())).where("route = 'OK'"))


@query("price_fallback_lines", q.with_("""
SELECT order_id, CAST(line_no AS INTEGER) AS line_no, sku_id, quantity, unit_price_minor, currency,
       quantity * unit_price_minor AS line_total_minor, from_offer, region FROM event_lines""", *q.LINES, EVENTS_SQL))
def price_fallback_lines(t: Tables) -> DataFrame:
    return ingest.line_rows(stored_events(t))


@query("oms_order_store", q.with_("""
SELECT event_order_id AS order_id, ref AS external_order_ref, 'WEB_STORE_' || region AS source_system, region,
       unit_price_minor * quantity AS total_amount_minor, currency, part AS kafka_partition, off AS kafka_offset,
       source_ts_ms AS ingested_at_ms FROM firsts""", *q.LINES, EVENTS_SQL))
def oms_order_store(t: Tables) -> DataFrame:
    """Stored orders after first-wins on the business key."""
    return ingest.order_rows(stored_events(t)).select(
        "order_id", "external_order_ref", "source_system", "region", "total_amount_minor", "currency",
        "kafka_partition", "kafka_offset", F.unix_millis("ingested_at").alias("ingested_at_ms"))


CUT_MS = REPLAY_MS + 2_500_000


@query("replay_split", q.with_(f"""
SELECT 'WEB_STORE_' || region AS source_system, CAST(count(*) FILTER (known) AS BIGINT) AS replays,
       CAST(count(*) FILTER (NOT known) AS BIGINT) AS fresh
FROM (SELECT o.region, EXISTS (SELECT 1 FROM ok s WHERE s.source_ts_ms < {CUT_MS} AND s.region = o.region
                               AND s.ref = o.ref) AS known FROM ok o WHERE o.source_ts_ms >= {CUT_MS}) GROUP BY 1""",
                               *q.LINES, EVENTS_SQL))
def replay_split(t: Tables) -> DataFrame:
    """Later events against the store of the earlier ones: replays by semi-join, fresh ones by anti-join.

    Messages are made and parsed once; times and keys, all that is asked of them, are kept.
    """
    good = written(ingest.routed(ingest.parse_events(t.order_events())).where("route = 'OK'").select(
        "timestamp", *ingest.BUSINESS_KEY), "good-keys")
    cut = F.timestamp_millis(F.lit(CUT_MS))
    stored = good.where(F.col("timestamp") < cut).select(*ingest.BUSINESS_KEY).distinct()
    late = good.where(F.col("timestamp") >= cut).select(*ingest.BUSINESS_KEY)
    tagged = ingest.replays(late, stored).withColumn("known", F.lit(True)).unionByName(
        ingest.not_stored(late, stored).withColumn("known", F.lit(False)))
    return tagged.groupBy("source_system").agg(
        F.count_if("known").alias("replays"), F.count_if(~F.col("known")).alias("fresh"))


# ---------------------------------------------------------------------------------------- events

def live_lines(t: Tables) -> DataFrame:
    """Current order lines straight from the line versions."""
    versions = t.line_versions().select("order_id", "line_no", "sku_id", "quantity", "unit_price_minor", "currency",
                                        "op", *latest.CHANGE_ORDER)
    return latest.latest_per_key_by_max(versions, ["order_id", "line_no"], deleted=F.col("op") == "d")


def assembled_orders(t: Tables) -> DataFrame:
    heads = t.order_rows().withColumn("customer_ref", F.col("customer_ref_clear"))
    ready, _ = events.assemble(heads, live_lines(t))
    return ready.withColumn("attempts", events.attempts_map(
        {"order": F.lit(1), "reserve": F.size("lines"), "pricing": (F.col("o_orderkey") % 3 + 1).cast("int")}))


@query("success_events", q.with_("""
SELECT r.order_id, r.region, CASE WHEN r.region = 'CN' THEN 'true' ELSE 'false' END AS masked,
       r.customer_ref, r.total_amount_minor, n_lines, first_sku, last_sku,
       CAST(n_lines AS INTEGER) AS reserve_attempts, CAST(o_orderkey % 3 + 1 AS INTEGER) AS pricing_attempts,
       0 AS confirm_attempts
FROM order_rows r JOIN (SELECT order_id, CAST(count(*) AS INTEGER) AS n_lines, arg_min(sku_id, line_no) AS first_sku,
                               arg_max(sku_id, line_no) AS last_sku FROM silver_lines GROUP BY order_id) l
  ON l.order_id = r.order_id WHERE n_lines <= 50""", *q.ORDERS, q.LINE_VERSIONS, q.SILVER_LINES))
def success_events(t: Tables) -> DataFrame:
    """Success events, read back from their JSON."""
    j = lambda path: F.get_json_object("value", path)
    lines = F.from_json(j("$.lines"), "array<struct<skuId:string>>")
    return events.success_messages(assembled_orders(t), TEST_SECRET).select(
        j("$.orderId").alias("order_id"), j("$.region").alias("region"),
        j("$.route.customerRefMasked").alias("masked"), j("$.customerRef").alias("customer_ref"),
        j("$.totalAmount.amountMinor").cast("bigint").alias("total_amount_minor"),
        F.size(lines).alias("n_lines"), F.element_at(lines, 1)["skuId"].alias("first_sku"),
        F.element_at(lines, -1)["skuId"].alias("last_sku"),
        *[j(f"$.attempts.{s}").cast("int").alias(f"{s}_attempts") for s in ("reserve", "pricing", "confirm")])


@query("events_over_contract", q.with_("""
SELECT r.order_id, CAST(coalesce(n, 0) AS BIGINT) AS line_count FROM order_rows r
LEFT JOIN (SELECT order_id, count(*) AS n FROM silver_lines GROUP BY order_id) USING (order_id)
WHERE coalesce(n, 0) NOT BETWEEN 1 AND 5""", *q.ORDERS, q.LINE_VERSIONS, q.SILVER_LINES))
def events_over_contract(t: Tables) -> DataFrame:
    """Orders that a contract of five lines keeps out of the success stream, with their true number of lines."""
    return events.assemble(t.order_rows(), live_lines(t), most=5)[1].select("order_id", "line_count")


def failures(t: Tables) -> DataFrame:
    """Every order with the step it failed in, those that are published to the dead-letter topic."""
    key = F.col("o_orderkey")
    step = F.element_at(F.array(*[F.lit(s) for s in ("order", "reserve", "pricing", "confirm")]),
                        (key % 4 + 1).cast("int"))
    business = key % 3 == 0
    breaker = ~business & (key % 7 == 0)
    late = F.col("failed_step").isin("pricing", "confirm")
    none = F.array().cast("array<string>")
    rows = (
        t.order_rows().withColumn("failed_step", step).withColumn("business", business)
        .withColumn("released_ids", F.when(late, F.array("reservation_id")).otherwise(none))
        .withColumn("error_code", F.when(business, "PRC-SKU-UNKNOWN").when(breaker, "CIRCUIT-OPEN")
                    .otherwise("UPSTREAM-UNAVAILABLE"))
        .withColumn("attempts", events.attempts_map({"order": F.when(F.col("failed_step") == "order", 3)
                                                     .otherwise(1)}))
        .withColumn("message", F.concat(F.lit("failed on "), F.col("failed_step")))
        .withColumn("customer_ref", F.when(key % 10 != 1, F.col("customer_ref_clear")))
        .withColumn("occurred_at", F.when(key % 35 != 6, F.date_format(
            F.timestamp_millis("ingested_at_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    )
    return rows.where(events.dlq_required(F.col("business"), late, breaker, F.col("released_ids")))


DLQ_SQL = f"""
dlq AS (
  SELECT * FROM (
    SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'order' WHEN 1 THEN 'reserve' WHEN 2 THEN 'pricing' ELSE 'confirm' END
             AS failed_step, o_orderkey % 4 >= 2 AS late, o_orderkey % 3 = 0 AS business,
           o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0 AS breaker,
           CASE WHEN o_orderkey % 10 <> 1 THEN customer_ref END AS ref_out,
           CASE WHEN o_orderkey % 35 <> 6 THEN
             strftime(make_timestamp(ingested_at_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') END AS occurred_at
    FROM order_rows)
  WHERE CASE WHEN business THEN late WHEN breaker THEN late ELSE true END)"""
_DLQ_CODE = "CASE WHEN business THEN 'PRC-SKU-UNKNOWN' WHEN breaker THEN 'CIRCUIT-OPEN' ELSE 'UPSTREAM-UNAVAILABLE' END"


@query("dlq_events", q.with_(f"""
SELECT order_id, region, ref_out AS customer_ref, failed_step, {_DLQ_CODE} AS error_code,
       CASE WHEN business THEN 'BUSINESS' ELSE 'RECEIVER' END AS category, late AS compensated,
       CASE WHEN late THEN reservation_id ELSE '' END AS released,
       CASE WHEN failed_step = 'order' THEN 3 ELSE 1 END AS order_attempts, 0 AS confirm_attempts, occurred_at
FROM dlq""", *q.ORDERS, DLQ_SQL))
def dlq_events(t: Tables) -> DataFrame:
    return events.dlq_fields(failures(t), TEST_SECRET).select(
        F.col("orderId").alias("order_id"), "region", F.col("customerRef").alias("customer_ref"),
        F.col("failedStep").alias("failed_step"), F.col("errorCode").alias("error_code"), "category", "compensated",
        F.array_join("releasedReservationIds", ",").alias("released"),
        F.col("attempts")["order"].alias("order_attempts"), F.col("attempts")["confirm"].alias("confirm_attempts"),
        F.col("occurredAt").alias("occurred_at"))


@query("dlq_completeness", q.with_("""
SELECT missing, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT concat_ws(',', CASE WHEN ref_out IS NULL THEN 'customerRef' END,
                   CASE WHEN occurred_at IS NULL THEN 'occurredAt' END) AS missing FROM dlq) GROUP BY missing""",
                                   *q.ORDERS, DLQ_SQL))
def dlq_completeness(t: Tables) -> DataFrame:
    return events.dlq_missing(events.dlq_fields(failures(t), TEST_SECRET)).groupBy(
        F.array_join("missing", ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("kafka_frames", q.with_(f"""
SELECT external_order_ref AS key, order_id, 'correlationId=' || correlation_id || ';region=' || region ||
       ';failedStep=' || failed_step || ';errorCode=' || {_DLQ_CODE} || ';eventType=ORDER_SAGA_FAILED' AS headers
FROM dlq UNION ALL
SELECT r.order_id, r.order_id, 'correlationId=' || correlation_id || ';region=' || region || ';eventType=ORDER_CONFIRMED'
FROM order_rows r WHERE r.order_id IN (SELECT order_id FROM silver_lines GROUP BY order_id HAVING count(*) <= 50)""",
                               *q.ORDERS, DLQ_SQL, q.LINE_VERSIONS, q.SILVER_LINES))
def kafka_frames(t: Tables) -> DataFrame:
    """Key, value and headers of both topics, as the message sink takes them."""
    dlq = events.dlq_messages(events.dlq_fields(failures(t), TEST_SECRET))
    sent = dlq.unionByName(events.success_messages(assembled_orders(t), TEST_SECRET))
    shown = F.array_join(F.transform("headers", lambda h: F.concat(
        h["key"], F.lit("="), F.decode(h["value"], "UTF-8"))), ";")
    return sent.select("key", F.get_json_object("value", "$.orderId").alias("order_id"), shown.alias("headers"))


# ----------------------------------------------------------------------------------------- stock

RESERVED_SQL = f"""
checked AS (
  SELECT r.*, s.on_hand, CASE
      WHEN kind = 'reserve' AND quantity < 1 THEN 'BAD_QUANTITY'
      WHEN kind = 'reserve' AND r.store_id NOT IN {KNOWN_STORES_SQL} THEN 'UNKNOWN_STORE'
      WHEN kind = 'reserve' AND s.on_hand IS NULL THEN 'UNKNOWN_SKU'
      WHEN s.on_hand IS NULL THEN 'UNKNOWN_RESERVATION' END AS rejected
  FROM stock_requests r LEFT JOIN stock s ON s.store_id = r.store_id AND s.sku_id = r.sku_id),
ord AS (
  SELECT *, row_number() OVER (PARTITION BY store_id, sku_id ORDER BY ts_ms, kind, seq) AS rn
  FROM checked WHERE rejected IS NULL),
fold AS (
  SELECT store_id, sku_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS hold_id,
         CAST(NULL AS BIGINT) AS ts_ms, CAST(NULL AS VARCHAR) AS outcome, 0 AS moved, 0 AS available,
         CAST(NULL AS BOOLEAN) AS fully_released,
         CAST([] AS STRUCT(u BIGINT, h VARCHAR, n INTEGER)[]) AS holds
  FROM ord GROUP BY store_id, sku_id
  UNION ALL
  SELECT store_id, sku_id, rn, kind, hold_id, ts_ms, outcome, moved,
         CASE WHEN outcome = 'RESERVED' THEN free - moved WHEN outcome = 'RELEASED' THEN free + moved ELSE free END,
         CASE WHEN outcome = 'RELEASED' THEN moved = held END,
         CASE WHEN outcome = 'RESERVED' THEN list_append(live, {{'u': ts_ms + 86400000, 'h': hold_id, 'n': quantity}})
              WHEN outcome = 'RELEASED' THEN list_filter(
                list_transform(live, lambda x: CASE WHEN x.h = hold_id THEN {{'u': x.u, 'h': x.h, 'n': x.n - moved}} ELSE x END),
                lambda x: x.n > 0)
              ELSE live END
  FROM (SELECT *, CASE WHEN outcome = 'RESERVED' THEN quantity
                       WHEN outcome = 'RELEASED' THEN CASE WHEN quantity IS NULL OR quantity < 1 THEN held
                                                           ELSE least(quantity, held) END ELSE 0 END AS moved
        FROM (SELECT *, CASE WHEN kind = 'reserve' THEN CASE WHEN quantity > free THEN 'INSUFFICIENT' ELSE 'RESERVED' END
                             WHEN held IS NULL THEN 'UNKNOWN_RESERVATION' ELSE 'RELEASED' END AS outcome
              FROM (SELECT o.store_id, o.sku_id, o.rn, o.kind, o.hold_id, o.ts_ms, o.quantity, l.live,
                           CAST(o.on_hand - coalesce(list_sum([x.n for x in l.live]), 0) AS INTEGER) AS free,
                           list_filter(l.live, lambda x: x.h = o.hold_id)[1].n AS held
                    FROM fold f JOIN ord o ON o.store_id = f.store_id AND o.sku_id = f.sku_id AND o.rn = f.rn + 1,
                    LATERAL (SELECT list_filter(f.holds, lambda x: x.u >= o.ts_ms) AS live) l)))),
outcomes AS (
  SELECT store_id, sku_id, kind, hold_id, ts_ms, outcome, moved, CAST(available AS INTEGER) AS available, fully_released
  FROM fold WHERE rn > 0
  UNION ALL SELECT store_id, sku_id, kind, hold_id, ts_ms, rejected, 0, NULL, NULL FROM checked
  WHERE rejected IS NOT NULL),
per_hold AS (
  SELECT store_id, sku_id, hold_id, max(CASE WHEN outcome = 'RESERVED' THEN ts_ms + 86400000 END) AS until,
         sum(CASE WHEN outcome = 'RESERVED' THEN moved ELSE -moved END) AS qty
  FROM outcomes WHERE outcome IN ('RESERVED', 'RELEASED') AND ts_ms <= @AS_OF GROUP BY ALL)"""
AS_OF_MS = 888_883_200_000  # 1998-03-03 00:00 UTC
STOCK_CTES = (q.ORDER_BASE, q.LINE_VERSIONS, q.STOCK, q.STOCK_REQUESTS)


def allocation(t: Tables, slices: int | None = None) -> DataFrame:
    return stock.allocate(t.stock_requests(), t.stock(), is_known_store(F.col("store_id")), slices)


@query("stock_allocation", q.with_("SELECT * FROM outcomes", *STOCK_CTES, RESERVED_SQL.replace("@AS_OF", str(AS_OF_MS)),
                                   recursive=True))
def stock_allocation(t: Tables) -> DataFrame:
    return allocation(t).select("store_id", "sku_id", "kind", "hold_id", "ts_ms", "outcome", "moved", "available",
                                "fully_released")


@query("stock_position", q.with_("""
SELECT s.store_id, s.sku_id, s.on_hand, CAST(coalesce(r, 0) AS INTEGER) AS reserved,
       CAST(s.on_hand - coalesce(r, 0) AS INTEGER) AS available
FROM stock s LEFT JOIN (SELECT store_id, sku_id, sum(qty) AS r FROM per_hold WHERE qty > 0 AND until >= %d
                        GROUP BY ALL) h ON h.store_id = s.store_id AND h.sku_id = s.sku_id""" % AS_OF_MS,
                                 *STOCK_CTES, RESERVED_SQL.replace("@AS_OF", str(AS_OF_MS)), recursive=True))
def stock_position(t: Tables) -> DataFrame:
    return stock.position(t.stock(), stock.open_holds(allocation(t), AS_OF_MS))


@query("stock_expiry", q.with_("""
SELECT store_id, sku_id, CAST(count(*) AS BIGINT) AS holds, CAST(sum(qty) AS BIGINT) AS quantity
FROM per_hold WHERE qty > 0 AND until < %d GROUP BY ALL""" % 2_000_000_000_000, *STOCK_CTES,
                               RESERVED_SQL.replace("@AS_OF", "2000000000000"), recursive=True))
def stock_expiry(t: Tables) -> DataFrame:
    return stock.expired_holds(allocation(t), 2_000_000_000_000)


@query("stock_release_targets", q.with_("""
SELECT CASE WHEN hold_id NOT LIKE 'none-%' THEN store_id END AS store_id,
       CASE WHEN hold_id NOT LIKE 'none-%' THEN sku_id END AS sku_id, CAST(count(*) AS BIGINT) AS releases
FROM stock_requests WHERE kind = 'release' GROUP BY ALL""", *STOCK_CTES))
def stock_release_targets(t: Tables) -> DataFrame:
    """Releases that name only a hold, with the stock row of that hold; an unknown hold has none."""
    requests = t.stock_requests()
    named = requests.where("kind = 'release'").select("hold_id", "kind", "ts_ms", "quantity", "seq", "store_id", "sku_id")
    return stock.release_targets(named, requests).groupBy("store_id", "sku_id").agg(
        F.count(F.lit(1)).alias("releases"))


# ---------------------------------------------------------------------------------------- claims

@query("idempotent_requests", q.with_("""
SELECT key, request_id, status, original_order_id FROM fold WHERE rn > 0""", """
req AS (SELECT 'K-' || user_id AS key, event_id AS request_id, epoch_us(ts) // 1000 AS ts_ms,
               event_type IN ('signup', 'purchase') AS ok, 'ORD-' || event_id AS oid,
               row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
fold AS (
  SELECT DISTINCT key, CAST(NULL AS BIGINT) AS request_id, CAST(0 AS BIGINT) AS rn, 0 AS status,
         CAST(NULL AS VARCHAR) AS original_order_id, CAST(NULL AS BIGINT) AS until, CAST(NULL AS VARCHAR) AS held FROM req
  UNION ALL
  SELECT r.key, r.request_id, r.rn,
         CASE WHEN r.ts_ms < f.until THEN 409 WHEN r.ok THEN 201 ELSE 503 END,
         CASE WHEN r.ts_ms < f.until THEN f.held WHEN r.ok THEN r.oid END,
         CASE WHEN r.ts_ms < f.until THEN f.until WHEN r.ok THEN r.ts_ms + 86400000 END,
         CASE WHEN r.ts_ms < f.until THEN f.held WHEN r.ok THEN r.oid END
  FROM fold f JOIN req r ON r.key = f.key AND r.rn = f.rn + 1)""", recursive=True))
def idempotent_requests(t: Tables) -> DataFrame:
    return claims.dedupe_requests(t.api_requests()).select("key", "request_id", "status", "original_order_id")


# ------------------------------------------------------------------------ directories valid in time

#: Noon of the replayed day, in milliseconds.
NOON_MS = 1_789_214_400_000
HOUR_MS = 3_600_000


@query("orders_by_store_directory", q.with_(f"""
SELECT order_id, CASE WHEN store_id LIKE '%-02' THEN ingested_at_ms >= {NOON_MS}
                      WHEN store_id LIKE '%-01' THEN NOT ingested_at_ms BETWEEN {NOON_MS - 2 * HOUR_MS} AND {NOON_MS - 1}
                      ELSE true END AS known,
       CASE WHEN store_id LIKE '%-02' AND ingested_at_ms >= {NOON_MS} THEN 'new'
            WHEN store_id LIKE '%-01' AND ingested_at_ms >= {NOON_MS} THEN 'reopened'
            WHEN store_id LIKE '%-02' OR (store_id LIKE '%-01' AND ingested_at_ms >= {NOON_MS - 2 * HOUR_MS}) THEN NULL
            ELSE 'old' END AS note
FROM order_rows""", *q.ORDERS))
def orders_by_store_directory(t: Tables) -> DataFrame:
    """Whether an order's store was in the directory when the order came.

    Stores that end in 02 open at noon, those in 01 are closed for the two hours before; the others always were there.
    """
    rows = t.order_rows().select("order_id", "store_id", "ingested_at_ms")
    stores = rows.select("store_id").distinct()
    opens, closes = F.lit(NOON_MS).cast("bigint"), F.lit(NOON_MS - 2 * HOUR_MS).cast("bigint")
    ever = F.lit(None).cast("bigint")
    entry = lambda since, until, note: F.struct(
        since.alias("since"), until.alias("until"), F.lit(note).alias("note"))
    directory = stores.select("store_id", F.explode(
        F.when(F.col("store_id").endswith("-02"), F.array(entry(opens, ever, "new")))
        .when(F.col("store_id").endswith("-01"), F.array(entry(ever, closes, "old"), entry(opens, ever, "reopened")))
        .otherwise(F.array(entry(ever, ever, "old")))).alias("e")).select("store_id", "e.*")
    found = asof.as_of_join(rows, directory, ("store_id",), "ingested_at_ms", "since", "until")
    return found.select("order_id", F.col("version").isNotNull().alias("known"), F.col("version.note").alias("note"))


@query("lines_by_price_version", q.with_(f"""
SELECT currency, CASE WHEN source_ts_ms < {NOON_MS} THEN 'morning' ELSE 'afternoon' END AS list,
       CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(quantity * unit_price_minor * CASE WHEN source_ts_ms < {NOON_MS} THEN 100 ELSE 103 END) AS BIGINT)
         AS hundredths
FROM line_versions GROUP BY ALL""", *q.LINES))
def lines_by_price_version(t: Tables) -> DataFrame:
    """Order lines under a price list whose factors change at noon; the three currencies are three hot keys."""
    lines = t.line_versions().select("currency", "source_ts_ms", "quantity", "unit_price_minor")
    turn = F.lit(NOON_MS).cast("bigint")
    ever = F.lit(None).cast("bigint")
    versions = lines.select("currency").distinct().select("currency", F.explode(F.array(
        F.struct(ever.alias("since"), turn.alias("until"), F.lit("morning").alias("list"), F.lit(100).alias("percent")),
        F.struct(turn.alias("since"), ever.alias("until"), F.lit("afternoon").alias("list"), F.lit(103).alias("percent"))
    )).alias("e")).select("currency", "e.*")
    found = asof.as_of_join(lines, versions, ("currency",), "source_ts_ms", "since", "until")
    amount = F.col("quantity").cast("bigint") * F.col("unit_price_minor") * F.col("version.percent")
    return found.groupBy("currency", F.col("version.list").alias("list")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(amount).alias("hundredths"))
