"""SQL twins of the adapters: common table expressions the oracle statements start from."""

from __future__ import annotations

from tidemark.functions import masking
from tidemark.sources.adapters import REPLAY_MS, REPLAY_ORIGIN, TEST_SECRET


def with_(select: str, *ctes: str, recursive: bool = False) -> str:
    """A statement from common table expressions and the final select."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


def region(n: str) -> str:
    return f"CASE {n} % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'SG' ELSE 'CN' END"


def currency(r: str) -> str:
    return f"CASE {r} WHEN 'CA' THEN 'CAD' WHEN 'SG' THEN 'SGD' WHEN 'CN' THEN 'CNY' END"


def padded(prefix: str, n: str, width: int) -> str:
    return f"'{prefix}' || lpad(CAST({n} AS VARCHAR), {width}, '0')"


def minor(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,2)) * 100 AS BIGINT)"


def replay(ts: str) -> str:
    return f"CAST({REPLAY_MS} + date_diff('day', DATE '{REPLAY_ORIGIN}', CAST({ts} AS DATE)) * 1000 AS BIGINT)"


def mask(ref: str, reg: str) -> str:
    inner, outer = (p.hex() for p in masking.hmac_pads(TEST_SECRET.encode()))
    mac = f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({ref}))))"
    return f"CASE WHEN {reg} = 'CN' AND trim({ref}) <> '' THEN 'msk-' || substr({mac}, 1, 12) ELSE {ref} END"


def ms_text(ms: str) -> str:
    return f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%d %H:%M:%S')"


ORDER_BASE = f"""
order_base AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, region,
         {currency('region')} AS currency
  FROM (SELECT *, {region('n_regionkey')} AS region
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey))"""

ORDER_ROWS = f"""
order_rows AS (
  SELECT {padded('ORD-', 'o_orderkey', 12)} AS order_id, 'WEB-' || o_orderkey AS external_order_ref,
         'WEB_STORE_' || region AS source_system,
         'ST-' || region || '-0' || (o_custkey % 3 + 1) AS store_id, region,
         'cust-' || lower(region) || '-' || o_custkey AS customer_ref_clear,
         {mask("'cust-' || lower(region) || '-' || o_custkey", 'region')} AS customer_ref,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'EDI' WHEN '2' THEN 'PHONE' WHEN '3' THEN 'POS'
              ELSE 'WEB_STORE' END AS channel,
         CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'P' THEN 'PICKING' ELSE 'SUBMITTED' END AS status,
         {padded('RES-', 'o_orderkey', 12)} AS reservation_id,
         {minor('o_totalprice')} AS total_amount_minor, currency, 'corr-' || o_orderkey AS correlation_id,
         CAST(o_orderkey % 8 AS INTEGER) AS kafka_partition, o_orderkey AS kafka_offset,
         {replay('o_orderdate')} AS ingested_at_ms, o_orderstatus, o_orderpriority, o_orderkey, o_custkey
  FROM order_base)"""

ORDER_VERSIONS = """
order_versions AS (
  SELECT r.* EXCLUDE (status), CASE WHEN v.n = 0 THEN 'SUBMITTED' ELSE r.status END AS status, v.n, v.op,
         r.ingested_at_ms + v.n * 1000 AS source_ts_ms, r.kafka_partition AS part, r.o_orderkey * 4 + v.n AS off
  FROM order_rows r JOIN (VALUES (0, 'c'), (1, 'u'), (2, 'd')) v(n, op)
    ON v.n = 0 OR (v.n = 1 AND r.o_orderstatus IN ('F', 'P'))
       OR (v.n = 2 AND r.o_orderstatus = 'P' AND r.o_orderpriority = '5-LOW'))"""

SILVER_ORDERS = """
silver_orders AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY source_ts_ms DESC, part DESC, off DESC)
                 AS rn FROM order_versions) WHERE rn = 1 AND op <> 'd')"""

OMS_ORDERS = """
oms_orders AS (SELECT * FROM order_rows WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW'))"""

LINE_VERSIONS = f"""
line_versions AS (
  SELECT {padded('ORD-', 'l_orderkey', 12)} AS order_id, l_linenumber AS line_no,
         {padded('SKU-', '(l_partkey % 50 + 1)', 4)} AS sku_id, CAST(l_quantity AS INTEGER) AS quantity,
         {minor('p_retailprice')} AS unit_price_minor, currency, region,
         CASE l_returnflag WHEN 'N' THEN 'c' WHEN 'A' THEN 'u' ELSE 'd' END AS op,
         {replay('l_shipdate')} AS source_ts_ms, CAST(l_orderkey % 8 AS INTEGER) AS part,
         l_partkey * 1000000 + l_suppkey AS off, CAST(l_quantity AS INTEGER) AS position,
         l_orderkey, l_partkey, l_suppkey, l_shipdate, o_custkey
  FROM lineitem JOIN order_base ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""

SILVER_LINES = """
silver_lines AS (
  SELECT *, CAST(quantity AS BIGINT) * unit_price_minor AS line_total_minor
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line_no
               ORDER BY source_ts_ms DESC, part DESC, off DESC, position DESC) AS rn FROM line_versions)
  WHERE rn = 1 AND op <> 'd')"""

EVENT_CHANGES = f"""
event_changes AS (
  SELECT 'oms.cdc' AS topic, CAST(user_id % 4 AS INTEGER) AS part, event_id AS off,
         event_id % 97 = 0 AS tombstone,
         CASE WHEN event_id % 101 = 0 THEN 'EU' ELSE {region('user_id')} END AS region,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'oms_order' ELSE 'oms_order_line' END AS tbl,
         CASE event_type WHEN 'purchase' THEN 'c' WHEN 'view' THEN 'c' WHEN 'signup' THEN 'r' WHEN 'click' THEN 'u'
              ELSE 'd' END AS op,
         CASE WHEN event_id % 103 <> 0 THEN epoch_us(ts) // 1000 END AS ts_ms,
         strftime(ts, '%Y%m%d') AS dt, user_id, event_id, value
  FROM events)"""

TRANSCRIPT = f"""
transcript AS (
  SELECT ts, event_id AS n, CASE WHEN event_id % 5 = 0 THEN 'replay' ELSE 'probe' END AS kind,
         'R-' || user_id AS ref, status, {minor('value')} AS time_ms,
         CASE status WHEN 409 THEN 'DUPLICATE' WHEN 422 THEN 'ORD-DUP-REF' WHEN 503 THEN 'UPSTREAM-UNAVAILABLE' END
           AS error_code,
         CASE status WHEN 201 THEN 'ORD-' || event_id WHEN 409 THEN 'ORD-' || (event_id - event_id % 2) END AS order_id
  FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_type IN ('signup', 'purchase') THEN 201
                       WHEN event_type = 'view' THEN 409 WHEN event_type = 'click' THEN 422 ELSE 503 END AS status
        FROM events))"""

AUDIT = """
audit AS (
  SELECT 'evt-' || event_id AS event_id, ts AS event_time,
         CASE user_id % 3 WHEN 0 THEN 'kms.example.test' WHEN 1 THEN 'oss.example.test' ELSE 'ram.example.test' END
           AS event_source,
         CASE event_type WHEN 'signup' THEN 'CreateKey' WHEN 'purchase' THEN 'PutBucketPolicy'
              WHEN 'view' THEN 'GetObject' WHEN 'click' THEN 'UpdateRotationPolicy'
              ELSE CASE WHEN event_id % 4 = 0 THEN 'StopLogging' ELSE 'DeleteTrail' END END AS event_name,
         CASE user_id % 3 WHEN 0 THEN 'KEY' WHEN 1 THEN 'BUCKET' ELSE 'POLICY' END AS resource_type,
         'res-' || (user_id % 20) AS resource_name,
         CASE WHEN user_id % 50 = 0 THEN 'cn-beijing' ELSE 'ap-southeast-1' END AS region,
         CASE WHEN user_id % 2 = 0 THEN 'ram-user' ELSE 'assumed-role' END AS identity_type,
         'user-' || user_id AS identity_name, '10.0.' || (user_id % 250) || '.1' AS source_ip,
         CASE WHEN user_id % 2 = 0 THEN 'cli/3' ELSE 'terraform/1' END AS user_agent,
         CASE WHEN event_type = 'error' THEN 'SubUserForbiddenError' END AS error_code,
         'req-' || event_id AS request_id, props AS request_params
  FROM events)"""

STOCK = f"""
stock AS (
  SELECT store_id, {padded('SKU-', 'sku', 4)} AS sku_id,
         CAST(sum(5 + (s_suppkey * 31 + sku) % 96) // count(*) AS INTEGER) AS on_hand
  FROM (SELECT s_suppkey, 'ST-' || {region('n_regionkey')} || '-0' || (s_suppkey % 3 + 1) AS store_id
        FROM supplier JOIN nation ON n_nationkey = s_nationkey) s, range(1, 50) k(sku)
  WHERE store_id <> 'ST-CN-03' GROUP BY 1, 2)"""

STOCK_REQUESTS = """
stock_requests AS (
  SELECT store_id, sku_id, kind, CASE WHEN kind = 'release' AND l_partkey % 13 = 0 THEN 'none-' || seq ELSE seq END
           AS hold_id,
         epoch_ms(l_shipdate) + CASE WHEN kind = 'release' THEN 43200000 ELSE 0 END AS ts_ms,
         CASE WHEN kind = 'reserve' THEN CASE WHEN l_partkey % 61 = 0 THEN 0 ELSE quantity END
              WHEN line_no % 3 = 0 THEN NULL WHEN line_no % 3 = 1 THEN quantity // 2 ELSE quantity + 5 END AS quantity,
         seq
  FROM (SELECT *, 'ST-' || region || '-0' || (o_custkey % 3 + 1) AS store_id,
               concat_ws('-', l_orderkey, line_no, l_partkey, l_suppkey) AS seq FROM line_versions) l
  JOIN (VALUES ('reserve'), ('release')) k(kind) ON kind = 'reserve' OR op = 'd')"""

ORDERS = (ORDER_BASE, ORDER_ROWS)
LINES = (ORDER_BASE, LINE_VERSIONS)
LAKE = (ORDER_BASE, ORDER_ROWS, ORDER_VERSIONS, SILVER_ORDERS, LINE_VERSIONS, SILVER_LINES)
