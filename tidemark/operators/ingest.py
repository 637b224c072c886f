"""Order-event ingest: parse, route, first-wins storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import line_total
from tidemark.functions.text import is_blank
from tidemark.functions.variants import cast_to, once, text, whole
from tidemark.operators.latest import first_per_key

# Routes and outcomes; below, the reasons of the order-event contract.
TOMBSTONE, POISON, STORED, REPLAY = "TOMBSTONE", "POISON", "STORED", "REPLAY"
BUSINESS_KEY = ("source_system", "external_order_ref")
ARRIVAL = ("timestamp", "partition", "offset")


#: What a message is read as, by one cast for each array or object: values, and variants that know the JSON types.
_OFFERS = "array<struct<skuId:string,amountMinor:bigint,currency:string>>"
_OFFER_TYPES = "array<struct<skuId:variant,amountMinor:variant,currency:variant>>"
_LINES = "array<struct<skuId:string,quantity:int,unitPriceMinor:bigint,currency:string>>"
_LINE_TYPES = "array<struct<skuId:variant,quantity:variant,unitPriceMinor:variant,currency:variant>>"
_HEAD = ("struct<storeId:string,region:string,customerRef:string,channel:string,status:string,reservationId:string,"
         "totalAmount:struct<amountMinor:variant,currency:string>,audit:struct<correlationId:string>>")


def _offer(offer: Column, types: Column) -> Column:
    return F.struct(
        text(types["skuId"], found=offer["skuId"]).alias("sku_id"),
        whole(types["amountMinor"], "", "bigint", offer["amountMinor"]).alias("amount"),
        text(types["currency"], found=offer["currency"]).alias("currency"))


def _line(line: Column, types: Column) -> Column:
    return F.struct(
        text(types["skuId"], found=line["skuId"]).alias("sku_id"),
        whole(types["quantity"], "", "int", line["quantity"]).alias("quantity"),
        types["unitPriceMinor"].isNotNull().alias("priced"),
        whole(types["unitPriceMinor"], "", "bigint", line["unitPriceMinor"]).alias("price"),
        text(types["currency"], found=line["currency"]).alias("currency"))


def _resolved_line(line: Column, offers: Column) -> Column:
    """A line with its price: an absent price or currency is taken from the last offer of the SKU.

    A price that is there but is no number stays null; it is not replaced.
    """
    offer = F.try_element_at(F.filter(offers, lambda o: o["sku_id"] == line["sku_id"]), F.lit(-1))
    return F.struct(
        line["sku_id"].alias("sku_id"), line["quantity"].alias("quantity"),
        F.when(line["priced"], line["price"]).otherwise(offer["amount"]).alias("unit_price_minor"),
        F.coalesce(line["currency"], offer["currency"]).alias("currency"), (~line["priced"]).alias("from_offer"))


def _line_reason(line: Column, i: Column) -> Column:
    at = F.concat(F.lit("lines["), i.cast("string"), F.lit("] "))
    return (
        F.when(is_blank(line["sku_id"]) | line["quantity"].isNull(),
               F.concat(at, F.lit("is missing skuId or quantity")))
        .when(line["quantity"] < 1, F.concat(at, F.lit("quantity must be >= 1, got "),
                                             line["quantity"].cast("string")))
        .when(line["unit_price_minor"].isNull() | line["currency"].isNull(),
              F.concat(at, F.lit("is missing unitPriceMinor/currency (and no unitPrices fallback)")))
    )


def parse_events(records: DataFrame, value: str = "value") -> DataFrame:
    """Messages with their parsed fields, the resolved `lines`, and `reason` for poison.

    A message is parsed once, into a variant. Numbers lose their fraction; a number in quotes is none.

    Tombstones (null values) have neither fields nor a reason. The first reason in checking order
    wins: blank, not JSON, not an object, business keys, then lines by position.
    """
    parsed = once(records, _doc=F.try_parse_json(value))
    doc = F.col("_doc")
    e = lambda path: text(doc, path)
    head = lambda path: text(doc, path, F.col(f"_head.{path}"))
    # Lambdas are interpreted, with all that stands beside them, so they get a step of their own.
    read = once(
        parsed, _offers=cast_to(doc, _OFFERS, "unitPrices"), _offer_types=cast_to(doc, _OFFER_TYPES, "unitPrices"),
        _lines=cast_to(doc, _LINES, "lines"), _line_types=cast_to(doc, _LINE_TYPES, "lines"), _json=doc.isNotNull(),
        _object=cast_to(doc, "struct<orderId:variant>").isNotNull(), order_id=e("orderId"),
        external_order_ref=e("externalOrderRef"), source_system=e("audit.sourceSystem"))
    offers = F.coalesce(F.zip_with("_offers", "_offer_types", _offer),
                        F.array().cast("array<struct<sku_id:string,amount:bigint,currency:string>>"))
    keys = once(read, lines=F.zip_with("_lines", "_line_types", lambda line, types: _resolved_line(
        _line(line, types), offers)))
    # What the reason does not need is a plain projection, so that a query that does not ask for it does not read it.
    staged = keys.withColumn("_head", cast_to(doc, _HEAD)).select(
        *records.columns, "_json", "_object", "order_id", "external_order_ref", "source_system",
        head("storeId").alias("store_id"), head("region").alias("region"), head("customerRef").alias("customer_ref"),
        head("channel").alias("channel"), head("status").alias("status"), head("reservationId").alias("reservation_id"),
        whole(F.col("_head.totalAmount.amountMinor"), "", "bigint").alias("total_amount_minor"),
        head("totalAmount.currency").alias("currency"), head("audit.correlationId").alias("correlation_id"), "lines")
    line_reasons = F.filter(F.transform("lines", _line_reason), lambda r: r.isNotNull())
    reason = (
        F.when(F.col(value).isNull(), F.lit(None).cast("string"))
        .when(is_blank(F.col(value)), "event payload is null or blank")
        .when(~F.col("_json"), "event payload is not valid JSON")
        .when(~F.col("_object"), "event payload is not a JSON object")
        .when(is_blank(F.col("order_id")) | is_blank(F.col("external_order_ref")) | is_blank(F.col("source_system")),
              "event is missing required business key(s): orderId, externalOrderRef, audit.sourceSystem")
        .otherwise(F.try_element_at(line_reasons, F.lit(1)))
    )
    return staged.withColumn("reason", reason).drop("_json", "_object")


def routed(events: DataFrame, value: str = "value") -> DataFrame:
    """Add `route`: TOMBSTONE, POISON or OK."""
    return events.withColumn("route", F.when(F.col(value).isNull(), TOMBSTONE)
                             .when(F.col("reason").isNotNull(), POISON).otherwise("OK"))


def first_events(events: DataFrame) -> DataFrame:
    """The first event of each business key by arrival; later ones are replays."""
    return first_per_key(events, BUSINESS_KEY, ARRIVAL)


def not_stored(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose business key the store does not hold yet."""
    return events.join(stored.select(*BUSINESS_KEY), list(BUSINESS_KEY), "left_anti")


def replays(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose business key the store already holds."""
    return events.join(stored.select(*BUSINESS_KEY), list(BUSINESS_KEY), "left_semi")


def order_rows(events: DataFrame, value: str = "value") -> DataFrame:
    """Rows of `oms_order`; the ingest time is the message time."""
    return events.select(
        "order_id", "external_order_ref", "source_system", "store_id", "region", "customer_ref", "channel", "status",
        "reservation_id", "total_amount_minor", "currency", "correlation_id",
        F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"),
        F.col(value).alias("raw_event"), F.col("timestamp").alias("ingested_at"))


def line_rows(events: DataFrame) -> DataFrame:
    """Rows of `oms_order_line`, numbered from 0 by position; an event without lines has none."""
    exploded = events.select("order_id", "region", F.posexplode("lines").alias("line_no", "line"))
    return exploded.select(
        "order_id", "line_no", "line.sku_id", "line.quantity", "line.unit_price_minor", "line.currency",
        line_total(F.col("line.quantity"), F.col("line.unit_price_minor")).alias("line_total_minor"), "region",
        F.col("line.from_offer").alias("from_offer"))
