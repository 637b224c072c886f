"""Adapters that read the generated test tables as retail inputs (orders, changes, logs).

Each adapter is a plain projection or equi-join of whole tables, so its work grows with them. The
SQL twins used by the oracle checks live in `tidemark.queries.sql`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, masking, money

#: Source days are replayed one per second into this day, so that whole tables fall on one `dt`
#: while their order in time is kept.
REPLAY_DATE = dt.date(2026, 9, 12)
REPLAY_DT = REPLAY_DATE.strftime("%Y%m%d")
REPLAY_MS = int(dt.datetime(2026, 9, 12, tzinfo=dt.timezone.utc).timestamp() * 1000)
REPLAY_ORIGIN = "1992-01-01"
CDC_TOPIC = "oms.cdc"
ORDERS_TOPIC = "orders.events"
DLQ_TOPIC = "orders.dlq"

ORDER_FIELDS = ("order_id", "external_order_ref", "source_system", "store_id", "region", "customer_ref", "channel",
                "status", "reservation_id", "total_amount_minor", "currency", "correlation_id")
LINE_FIELDS = ("order_id", "line_no", "sku_id", "quantity", "unit_price_minor", "currency", "region")


def padded(prefix: str, number: Column, width: int) -> Column:
    """A prefixed number with leading zeros."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def sku_of_part(part: Column) -> Column:
    return padded("SKU-", part % 50 + 1, 4)


def region_by(number: Column) -> Column:
    """Region of a number modulo 3."""
    return F.when(number % 3 == 0, "CA").when(number % 3 == 1, "SG").otherwise("CN")


#: Secret of the pseudonyms in the test tables.
TEST_SECRET = "sim-egress-secret"


def replay_ms(ts: Column) -> Column:
    """Commit time of a source timestamp on the replayed day."""
    days = F.datediff(ts.cast("date"), F.lit(REPLAY_ORIGIN).cast("date"))
    return F.lit(REPLAY_MS).cast("bigint") + days.cast("bigint") * 1000


def materialized(df: DataFrame, **columns: Column) -> DataFrame:
    """Add computed columns behind a generator, so that each is computed once however often it is read."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


class Tables:
    """The given tables of one folder, and the retail frames derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---------------------------------------------------------------- orders

    def order_base(self) -> DataFrame:
        """orders ⋈ customer ⋈ nation with the retail region and currency."""
        return (
            self.table("orders")
            .join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation").select("n_nationkey", "n_regionkey"),
                  F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumn("region", region_by(F.col("n_regionkey")))
            .withColumn("currency", money.currency_of_region(F.col("region")))
            .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate",
                    "region", "currency")
        )

    def order_rows(self) -> DataFrame:
        """One row per order in the shape of `oms_order`, with the clear and the masked reference."""
        key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
        clear = F.concat(F.lit("cust-"), F.lower("region"), F.lit("-"), cust)
        priority = F.substring("o_orderpriority", 1, 1)
        return self.order_base().select(
            padded("ORD-", key, 12).alias("order_id"),
            F.concat(F.lit("WEB-"), key.cast("string")).alias("external_order_ref"),
            F.concat(F.lit("WEB_STORE_"), F.col("region")).alias("source_system"),
            F.concat(F.lit("ST-"), F.col("region"), F.lit("-0"), (F.col("o_custkey") % 3 + 1).cast("string"))
            .alias("store_id"),
            F.col("region"),
            clear.alias("customer_ref_clear"),
            masking.mask_customer_ref(clear, F.col("region"), TEST_SECRET).alias("customer_ref"),
            F.when(priority == "1", "EDI").when(priority == "2", "PHONE").when(priority == "3", "POS")
            .otherwise("WEB_STORE").alias("channel"),
            F.when(F.col("o_orderstatus") == "F", "DELIVERED").when(F.col("o_orderstatus") == "P", "PICKING")
            .otherwise("SUBMITTED").alias("status"),
            padded("RES-", key, 12).alias("reservation_id"),
            money.to_minor(F.col("o_totalprice")).alias("total_amount_minor"),
            F.col("currency"),
            F.concat(F.lit("corr-"), key.cast("string")).alias("correlation_id"),
            (key % 8).cast("int").alias("kafka_partition"),
            key.alias("kafka_offset"),
            replay_ms(F.col("o_orderdate")).alias("ingested_at_ms"),
            F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_custkey"),
        )

    def order_versions(self) -> DataFrame:
        """Order changes: a create, an update when delivered or picking, a delete for low-priority picking."""
        rows = self.order_rows()
        created = F.struct(F.lit(0).alias("n"), F.lit("c").alias("op"), F.lit("SUBMITTED").alias("status"))
        updated = F.when(F.col("o_orderstatus").isin("F", "P"),
                         F.struct(F.lit(1).alias("n"), F.lit("u").alias("op"), F.col("status").alias("status")))
        deleted = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"),
                         F.struct(F.lit(2).alias("n"), F.lit("d").alias("op"), F.col("status").alias("status")))
        return (
            rows.withColumn("v", F.explode(F.filter(F.array(created, updated, deleted), lambda x: x.isNotNull())))
            .withColumn("status", F.col("v.status"))
            .withColumn("op", F.col("v.op"))
            .withColumn("source_ts_ms", F.col("ingested_at_ms") + F.col("v.n") * 1000)
            .withColumn("partition", F.col("kafka_partition"))
            .withColumn("offset", F.col("o_orderkey") * 4 + F.col("v.n"))
            .withColumn("position", F.lit(0))
            .select(*ORDER_FIELDS, "op", "source_ts_ms", "partition", "offset", "position")
        )

    def oms_orders(self) -> DataFrame:
        """`oms_order` at the end of the replayed day (deleted orders are gone)."""
        gone = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
        return self.order_rows().where(~gone).select(
            *ORDER_FIELDS, "kafka_partition", "kafka_offset",
            F.timestamp_millis("ingested_at_ms").alias("ingested_at"))

    def order_lines(self) -> DataFrame:
        """lineitem ⋈ orders with the retail region and currency."""
        base = self.order_base().select("o_orderkey", "o_custkey", "region", "currency")
        return self.table("lineitem").join(base, F.col("l_orderkey") == F.col("o_orderkey"))

    def line_versions(self) -> DataFrame:
        """Line changes: lineitem rows of one (order, line) are versions, the return flag is the op."""
        part = self.table("part").select("p_partkey", "p_retailprice")
        flag = F.col("l_returnflag")
        return (
            self.order_lines()
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                padded("ORD-", F.col("l_orderkey"), 12).alias("order_id"),
                F.col("l_linenumber").alias("line_no"),
                sku_of_part(F.col("l_partkey")).alias("sku_id"),
                F.col("l_quantity").cast("int").alias("quantity"),
                money.to_minor(F.col("p_retailprice")).alias("unit_price_minor"),
                F.col("currency"),
                F.col("region"),
                F.when(flag == "N", "c").when(flag == "A", "u").otherwise("d").alias("op"),
                replay_ms(F.col("l_shipdate")).alias("source_ts_ms"),
                (F.col("l_orderkey") % 8).cast("int").alias("partition"),
                (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("offset"),
                F.col("l_quantity").cast("int").alias("position"),
                F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate"), F.col("o_custkey"),
            )
        )

    # ------------------------------------------------------------- envelopes

    def order_changes(self) -> DataFrame:
        """Order changes as change-event messages."""
        return envelope_frame(self.order_versions(), ORDER_FIELDS, "oms_order")

    def line_changes(self) -> DataFrame:
        """Line changes as change-event messages."""
        return envelope_frame(self.line_versions(), LINE_FIELDS, "oms_order_line")

    def event_changes(self) -> DataFrame:
        """The events table as a change stream over 30 days, faults included.

        Every 97th value is a tombstone, every 101st region is outside the allow-list, every 103rd
        commit time is missing.
        """
        kind, eid = F.col("event_type"), F.col("event_id")
        region = F.when(eid % 101 == 0, "EU").otherwise(region_by(F.col("user_id")))
        op = (F.when(kind.isin("purchase", "view"), "c").when(kind == "signup", "r").when(kind == "click", "u")
              .otherwise("d"))
        clear = F.concat(F.lit("cust-"), F.lower(region), F.lit("-"), F.col("user_id").cast("string"))
        image = F.struct(
            F.concat(F.lit("ORD-E"), eid.cast("string")).alias("order_id"),
            region.alias("region"),
            masking.mask_customer_ref(clear, region, TEST_SECRET).alias("customer_ref"),
            money.to_minor(F.col("value")).alias("amount_minor"),
        )
        ts_ms = dates.epoch_ms(F.col("ts"))
        body = F.struct(
            F.when(op != "c", image).alias("before"),
            F.when(op != "d", image).alias("after"),
            F.struct(
                F.when(eid % 103 != 0, ts_ms).alias("ts_ms"),
                F.when(kind.isin("purchase", "signup"), "oms_order").otherwise("oms_order_line").alias("table"),
            ).alias("source"),
            op.alias("op"),
            ts_ms.alias("ts_ms"),
        )
        value = F.when(eid % 97 != 0, F.to_json(body, {"ignoreNullFields": "false"}))
        return materialized(self.table("events"), value_=value).select(
            F.lit(CDC_TOPIC).alias("topic"),
            (F.col("user_id") % 4).cast("int").alias("partition"),
            eid.alias("offset"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.col("value_").alias("value"),
        )

    # ---------------------------------------------------------- order events

    def order_events(self) -> DataFrame:
        """Success events as JSON messages built from line rows, faults injected by a row number."""
        rows = self.line_versions().withColumn("fault", (F.col("l_partkey") + F.col("line_no")) % 32)
        fault = F.col("fault")
        price = F.col("unit_price_minor")
        other = padded("SKU-", F.col("l_partkey") % 47 + 1, 4)
        none_price = F.when(~fault.isin(6, 7), price.cast("string"))
        shown = F.when(fault == 12, F.lit("abc")).otherwise(none_price)
        first = F.struct(
            F.col("sku_id").alias("skuId"),
            F.when(fault == 5, 0).otherwise(F.col("quantity")).alias("quantity"),
            shown.alias("unitPriceMinor"),
            F.when(~fault.isin(6, 7), F.col("currency")).alias("currency"),
        )
        second = F.struct(
            F.when(fault != 9, other).alias("skuId"),
            F.lit(1).alias("quantity"),
            (price + 1).cast("string").alias("unitPriceMinor"),
            F.col("currency").alias("currency"),
        )
        offer = lambda amount: F.struct(
            F.col("sku_id").alias("skuId"), amount.alias("amountMinor"), F.col("currency").alias("currency"))
        body = F.struct(
            F.when(fault != 2, F.concat(F.col("order_id"), F.lit("-"), F.col("line_no").cast("string")))
            .alias("orderId"),
            F.lit("CONFIRMED").alias("status"),
            F.when(fault == 3, F.lit(" ")).otherwise(
                F.concat_ws("-", F.lit("WEB"), F.col("l_orderkey").cast("string"), F.col("line_no").cast("string")))
            .alias("externalOrderRef"),
            F.concat(F.lit("ST-"), F.col("region"), F.lit("-0"), (F.col("o_custkey") % 3 + 1).cast("string"))
            .alias("storeId"),
            F.col("region").alias("region"),
            F.struct((price * F.col("quantity")).alias("amountMinor"), F.col("currency").alias("currency"))
            .alias("totalAmount"),
            F.when(fault.isin(7, 12, 17), F.array(offer(price + 100), offer(price + 7)))
            .otherwise(F.filter(F.array(offer(price)), lambda _: F.lit(False))).alias("unitPrices"),
            F.struct(
                F.when(fault != 4, F.concat(F.lit("WEB_STORE_"), F.col("region"))).alias("sourceSystem"),
                F.concat(F.lit("corr-"), F.col("l_orderkey").cast("string")).alias("correlationId"),
            ).alias("audit"),
            F.when(fault == 8, F.filter(F.array(first), lambda _: F.lit(False)))
            .otherwise(F.array(first, second)).alias("lines"),
        )
        # Prices are built as text so that one of them can be a word; the quotes of the numbers go again.
        text = F.regexp_replace(F.to_json(body), r'"unitPriceMinor":"([0-9]+)"', r'"unitPriceMinor":$1')
        # numbers with fractions, a number in quotes, and a price that is JSON null
        head = r'("lines":\[\{"skuId":"[^"]*","quantity":)([0-9]+)'
        text = replaced(text, fault, {
            13: (head, "$1$2.5"), 14: (head + r'(,"unitPriceMinor":[0-9]+)', "$1$2$3.7"), 15: (head, '$1"$2"'),
            16: (head, "$10.5"), 17: (head + ',"unitPriceMinor":[0-9]+', '$1$2,"unitPriceMinor":null')})
        value = (
            F.when(fault == 0, F.lit(None).cast("string")).when(fault == 1, "{not json").when(fault == 10, "   ")
            .when(fault == 11, "[1]").otherwise(text)
        )
        return materialized(rows, value=value).select(
            F.lit(ORDERS_TOPIC).alias("topic"), "partition", "offset",
            F.timestamp_millis("source_ts_ms").alias("timestamp"), "value")

    # ------------------------------------------------------------------ logs

    def transcript(self) -> DataFrame:
        """The events table as a probe transcript."""
        kind, eid = F.col("event_type"), F.col("event_id")
        status = (
            F.when(eid % 7 == 0, 0).when(kind.isin("signup", "purchase"), 201).when(kind == "view", 409)
            .when(kind == "click", 422).otherwise(503)
        )
        user = F.col("user_id").cast("string")
        code = (F.when(F.col("status") == 409, "DUPLICATE").when(F.col("status") == 422, "ORD-DUP-REF")
                .when(F.col("status") == 503, "UPSTREAM-UNAVAILABLE"))
        order_id = F.when(F.col("status") == 201, F.concat(F.lit("ORD-"), eid.cast("string"))).when(
            F.col("status") == 409, F.concat(F.lit("ORD-"), (eid - eid % 2).cast("string")))
        return (
            self.table("events")
            .withColumn("status", status)
            .select(
                F.col("ts"), eid.alias("n"),
                F.when(eid % 5 == 0, "replay").otherwise("probe").alias("kind"),
                F.concat(F.lit("R-"), user).alias("ref"),
                F.col("status"),
                money.to_minor(F.col("value")).alias("time_ms"),
                code.alias("error_code"),
                order_id.alias("order_id"),
                F.when(F.col("status") == 0, "curl:28").alias("error"),
            )
        )

    def audit_events(self) -> DataFrame:
        """The events table as management audit events."""
        kind, eid, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
        tamper = F.when(eid % 4 == 0, "StopLogging").otherwise("DeleteTrail")
        name = (F.when(kind == "signup", "CreateKey").when(kind == "purchase", "PutBucketPolicy")
                .when(kind == "view", "GetObject").when(kind == "click", "UpdateRotationPolicy").otherwise(tamper))
        failed = kind == "error"
        return self.table("events").select(
            F.concat(F.lit("evt-"), eid.cast("string")).alias("event_id"),
            F.col("ts").alias("event_time"),
            F.when(user % 3 == 0, "kms.example.test").when(user % 3 == 1, "oss.example.test")
            .otherwise("ram.example.test").alias("event_source"),
            name.alias("event_name"),
            F.when(user % 3 == 0, "KEY").when(user % 3 == 1, "BUCKET").otherwise("POLICY").alias("resource_type"),
            F.concat(F.lit("res-"), (user % 20).cast("string")).alias("resource_name"),
            F.when(user % 50 == 0, "cn-beijing").otherwise("ap-southeast-1").alias("region"),
            F.when(user % 2 == 0, "ram-user").otherwise("assumed-role").alias("identity_type"),
            F.concat(F.lit("user-"), user.cast("string")).alias("identity_name"),
            F.concat(F.lit("10.0."), (user % 250).cast("string"), F.lit(".1")).alias("source_ip"),
            F.when(user % 2 == 0, "cli/3").otherwise("terraform/1").alias("user_agent"),
            F.when(failed, "SubUserForbiddenError").alias("error_code"),
            F.when(failed, "not authorized").alias("error_message"),
            F.concat(F.lit("req-"), eid.cast("string")).alias("request_id"),
            F.col("props").alias("request_params"),
        )

    def metric_events(self) -> DataFrame:
        """View events as freshness metrics."""
        return self.table("events").where("event_type = 'view'").select(
            F.col("ts"), F.lit("cdc_freshness_seconds").alias("metric"),
            F.floor(money.to_minor(F.col("value")) / 100).cast("bigint").alias("value"), F.lit("cdc").alias("pipeline"))

    # --------------------------------------------------------------- catalog

    def stock(self) -> DataFrame:
        """Stock rows of the known stores: suppliers set the level, SKU 50 is not stocked."""
        region = region_by(F.col("n_regionkey"))
        level = 5 + (F.col("s_suppkey") * 31 + F.col("sku")) % 96
        return (
            self.table("supplier")
            .join(self.table("nation").select("n_nationkey", "n_regionkey"),
                  F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumn("store_id", F.concat(F.lit("ST-"), region, F.lit("-0"),
                                             (F.col("s_suppkey") % 3 + 1).cast("string")))
            .where(F.col("store_id") != "ST-CN-03")
            .withColumn("sku", F.explode(F.sequence(F.lit(1), F.lit(49))))
            .groupBy("store_id", padded("SKU-", F.col("sku"), 4).alias("sku_id"))
            .agg(F.floor(F.sum(level) / F.count(F.lit(1))).cast("int").alias("on_hand"))
        )

    def stock_requests(self) -> DataFrame:
        """Reserve and release requests in ship-date order.

        Every line reserves its quantity; a returned line also releases its hold 12 hours later (all
        of it, a part, more than is outstanding, or a hold that does not exist).
        """
        lines = self.line_versions()
        day_ms = dates.epoch_ms(F.col("l_shipdate"))
        rid = F.concat_ws("-", "l_orderkey", "line_no", "l_partkey", "l_suppkey")
        reserve = F.struct(
            F.lit("reserve").alias("kind"), rid.alias("hold_id"), day_ms.alias("ts_ms"),
            F.when(F.col("l_partkey") % 61 == 0, 0).otherwise(F.col("quantity")).alias("quantity"))
        part = (F.when(F.col("line_no") % 3 == 0, F.lit(None).cast("int"))
                .when(F.col("line_no") % 3 == 1, (F.col("quantity") / 2).cast("int")).otherwise(F.col("quantity") + 5))
        release = F.struct(
            F.lit("release").alias("kind"),
            F.when(F.col("l_partkey") % 13 == 0, F.concat(F.lit("none-"), rid)).otherwise(rid).alias("hold_id"),
            (day_ms + 43_200_000).alias("ts_ms"), part.alias("quantity"))
        return (
            lines.withColumn("r", F.explode(F.when(F.col("op") == "d", F.array(reserve, release))
                                            .otherwise(F.array(reserve))))
            .select(
                F.concat(F.lit("ST-"), F.col("region"), F.lit("-0"), (F.col("o_custkey") % 3 + 1).cast("string"))
                .alias("store_id"),
                "sku_id", F.col("r.kind").alias("kind"), F.col("r.hold_id").alias("hold_id"),
                F.col("r.ts_ms").alias("ts_ms"), F.col("r.quantity").alias("quantity"),
                rid.alias("seq"))
        )

    def api_requests(self) -> DataFrame:
        """Order requests with a client key, an arrival time and what executing them would yield."""
        kind, eid = F.col("event_type"), F.col("event_id")
        return self.table("events").select(
            F.concat(F.lit("K-"), F.col("user_id").cast("string")).alias("key"),
            eid.alias("request_id"), dates.epoch_ms(F.col("ts")).alias("ts_ms"),
            kind.isin("signup", "purchase").alias("succeeds"),
            F.concat(F.lit("ORD-"), eid.cast("string")).alias("order_id"))


def replaced(text: Column, code: Column, faults: dict[int, tuple[str, str]]) -> Column:
    """A text with the replacement that belongs to its code, if any; the text stands in the plan once."""
    pattern, by = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for at, (found, put) in faults.items():
        pattern, by = pattern.when(code == at, F.lit(found)), by.when(code == at, F.lit(put))
    return F.regexp_replace(text, pattern.otherwise(F.lit("$^")), by.otherwise(F.lit("")))


def envelope_frame(versions: DataFrame, fields: tuple[str, ...], table: str) -> DataFrame:
    """Row versions as change-event messages with message coordinates."""
    image = F.struct(*[F.col(f) for f in fields])
    body = F.struct(
        F.when(F.col("op") != "c", image).alias("before"),
        F.when(F.col("op") != "d", image).alias("after"),
        F.struct(F.col("source_ts_ms").alias("ts_ms"), F.lit("oms").alias("db"), F.lit(table).alias("table"))
        .alias("source"),
        F.col("op").alias("op"),
        F.col("source_ts_ms").alias("ts_ms"),
    )
    return materialized(versions, value=F.to_json(body, {"ignoreNullFields": "false"})).select(
        F.lit(CDC_TOPIC).alias("topic"), F.col("partition"), F.col("offset"), F.col("position"),
        F.timestamp_millis("source_ts_ms").alias("timestamp"), "value")
