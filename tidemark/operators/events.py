"""Outgoing events: order success and failed-order (dead-letter) messages, masked and with headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.masking import mask_customer_ref, needs_mask
from tidemark.functions.outcomes import SAGA_STEPS
from tidemark.operators.orders import MAX_LINES

# Fixed values of the event contract.
CONFIRMED = "ORDER_CONFIRMED"
FAILED = "ORDER_SAGA_FAILED"
DLQ_REQUIRED = ("eventType", "externalOrderRef", "sourceSystem", "storeId", "region", "customerRef", "correlationId",
                "failedStep", "attempts", "errorCode", "category", "compensated", "releasedReservationIds", "occurredAt")


def assemble(orders: DataFrame, lines: DataFrame, most: int = MAX_LINES) -> tuple[DataFrame, DataFrame]:
    """Orders with 1 to `most` lines and their `lines` array in line order, and the rest with their true `line_count`.

    The lines of an order are counted first, partially in every task; only lines of orders within the contract are
    nested, so no array can grow beyond `most` entries. The rest is returned to be published or booked, not dropped.
    """
    counts = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("line_count"))
    fitting = lines.join(counts.where(F.col("line_count") <= most).select("order_id"), "order_id", "left_semi")
    item = F.struct("line_no", F.col("sku_id").alias("skuId"), "quantity",
                    F.col("unit_price_minor").alias("unitPriceMinor"), "currency")
    nested = fitting.groupBy("order_id").agg(F.sort_array(F.collect_list(item)).alias("lines"))
    counted = orders.join(counts, "order_id", "left").withColumn(
        "line_count", F.coalesce("line_count", F.lit(0).cast("bigint")))
    rest = counted.where(~F.col("line_count").between(1, most))
    return orders.join(nested, "order_id"), rest


def attempts_map(step_attempts: dict[str, Column]) -> Column:
    """Attempts per step with all four steps present, 0 for a step that never ran."""
    pairs = []
    for step in SAGA_STEPS:
        pairs += [F.lit(step), F.coalesce(step_attempts.get(step, F.lit(None)), F.lit(0)).cast("int")]
    return F.create_map(*pairs)


def success_payload(secret: str) -> Column:
    """The success event of an assembled order row; `secret` keys the pseudonyms."""
    money = F.struct(F.col("total_amount_minor").alias("amountMinor"), F.col("currency").alias("currency"))
    no_order = lambda x: F.struct(x["skuId"], x["quantity"], x["unitPriceMinor"], x["currency"])
    return F.struct(
        F.col("order_id").alias("orderId"), F.col("status"), F.col("external_order_ref").alias("externalOrderRef"),
        F.col("store_id").alias("storeId"), F.col("region"), F.col("channel"),
        F.col("reservation_id").alias("reservationId"), money.alias("totalAmount"),
        F.transform("lines", lambda x: F.struct(
            x["skuId"].alias("skuId"), x["unitPriceMinor"].alias("amountMinor"), x["currency"].alias("currency"))
        ).alias("unitPrices"),
        F.array(*[F.struct(F.lit(s).alias("step"), F.lit("COMPLETED").alias("status")) for s in SAGA_STEPS])
        .alias("saga"),
        F.col("attempts"),
        F.struct(F.col("region").alias("region"),
                 needs_mask(F.col("customer_ref"), F.col("region")).alias("customerRefMasked")).alias("route"),
        F.struct(F.col("source_system").alias("sourceSystem"), F.col("correlation_id").alias("correlationId"))
        .alias("audit"),
        mask_customer_ref(F.col("customer_ref"), F.col("region"), secret).alias("customerRef"),
        F.transform("lines", no_order).alias("lines"),
    )


def headers(**values: Column) -> Column:
    """Message headers as the array the message sink takes; null values are left out."""
    pairs = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value")))
             for k, v in values.items()]
    return F.filter(F.array(*pairs), lambda h: h.isNotNull())


def success_messages(assembled: DataFrame, secret: str) -> DataFrame:
    """Frames (key, value, headers) of success events."""
    return assembled.select(
        F.col("order_id").alias("key"), F.to_json(success_payload(secret)).alias("value"),
        headers(correlationId=F.col("correlation_id"), region=F.col("region"), eventType=F.lit(CONFIRMED))
        .alias("headers"))


def dlq_fields(failures: DataFrame, secret: str) -> DataFrame:
    """The 15 fields of a failed order, the customer reference masked.

    Input: order columns plus failed_step, error_code, business (a contract fault), attempts,
    released_ids, message, occurred_at.
    """
    released = F.coalesce(F.col("released_ids"), F.array().cast("array<string>"))
    return failures.select(
        F.lit(FAILED).alias("eventType"), F.col("order_id").alias("orderId"),
        F.col("external_order_ref").alias("externalOrderRef"), F.col("source_system").alias("sourceSystem"),
        F.col("store_id").alias("storeId"), F.col("region"),
        mask_customer_ref(F.col("customer_ref"), F.col("region"), secret).alias("customerRef"),
        F.col("correlation_id").alias("correlationId"), F.col("failed_step").alias("failedStep"),
        F.col("attempts"), F.col("error_code").alias("errorCode"),
        F.when(F.col("business"), "BUSINESS").otherwise("RECEIVER").alias("category"),
        (F.size(released) > 0).alias("compensated"), released.alias("releasedReservationIds"), F.col("message"),
        F.col("occurred_at").alias("occurredAt"))


def dlq_required(business: Column, after_reserve: Column, breaker_open: Column, released: Column) -> Column:
    """Whether a failure is published: never for a business fault up to the reserve step; with an open
    breaker only when something was released; otherwise always."""
    return (F.when(business, after_reserve).when(breaker_open, F.size(released) > 0).otherwise(F.lit(True)))


def dlq_messages(fields: DataFrame) -> DataFrame:
    """Frames (key, value, headers) of failed orders; null fields are left out of the JSON."""
    return fields.select(
        F.col("externalOrderRef").alias("key"), F.to_json(F.struct(*fields.columns)).alias("value"),
        headers(correlationId=F.col("correlationId"), region=F.col("region"), failedStep=F.col("failedStep"),
                errorCode=F.col("errorCode"), eventType=F.col("eventType")).alias("headers"))


def dlq_missing(fields: DataFrame) -> DataFrame:
    """Add `missing`: contract fields without a value, in contract order."""
    holes = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in DLQ_REQUIRED])
    return fields.withColumn("missing", F.filter(holes, lambda x: x.isNotNull()))
