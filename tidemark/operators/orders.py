"""Order requests: canonical validation, order rules, pricing."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import money
from tidemark.functions.text import is_blank
from tidemark.functions.variants import fields, is_number, is_string, is_there, items, kind, leaf, once, text_of
from tidemark.operators.sequence import number_rows
from tidemark.operators.sequence import order_id as erp_order_id

# Fixed values of the canonical order contract.
STORE_PATTERN = r"^ST-(CA|SG|CN)-[0-9]{2}$"
SKU_PATTERN = r"^SKU-[0-9]{4}$"
CHANNELS = ("WEB_STORE", "POS", "PHONE", "EDI")
MAX_TEXT = 64
MAX_LINES = 50
MAX_QUANTITY = 999
DATE_TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
ORDER_KEYS = ("externalOrderRef", "sourceSystem", "storeId", "channel", "customerRef", "lines", "audit")
LINE_KEYS = ("skuId", "quantity")
AUDIT_KEYS = ("sourceSystem", "receivedAt", "correlationId")


def _fault(found: Column, path: Column, *faults: tuple[Column, str], required: bool = True) -> Column:
    """The message of a field, null for a good one: its first fault."""
    first = F.when(~is_there(found), F.concat(path, F.lit(": required")) if required else F.lit(None).cast("string"))
    for bad, say in faults:
        first = first.when(bad, F.concat(path, F.lit(f": {say}")))
    return first


def _string(found: Column, path: Column, minimum: int = 0, most: int | None = MAX_TEXT, pattern: str | None = None,
            say: str = "does not match the pattern", required: bool = True) -> Column:
    """The message of a text field: its JSON type first; lengths and patterns only concern texts."""
    faults = [(~is_string(found), "string expected")]
    if minimum:
        faults.append((F.length(found["text"]) < minimum, f"must be at least {minimum} characters long"))
    if most is not None:
        faults.append((F.length(found["text"]) > most, f"must be at most {most} characters long"))
    if pattern is not None:
        faults.append((~found["text"].rlike(pattern), say))
    return _fault(found, path, *faults, required=required)


def _none() -> Column:
    return F.array().cast("array<string>")


def _extra(found: Column, allowed: tuple[str, ...], path: Column) -> Column:
    """Messages for unknown names. They are only looked for where the known ones are not all the fields."""
    known = functools.reduce(operator.add, [found[k].isNotNull().cast("int") for k in allowed])
    unknown = F.array_except(F.map_keys(found), F.array(*[F.lit(k) for k in allowed]))
    said = F.transform(unknown, lambda k: F.concat(path, F.lit("."), k, F.lit(": not allowed")))
    return F.when(found.isNull() | (F.size(found) == known), _none()).otherwise(said)


def _present(messages: list[Column]) -> Column:
    """The messages that are there. All differ; a filter's lambda would have them interpreted instead of compiled."""
    return F.array_except(F.array(*messages), F.array(F.lit(None).cast("string")))


def _line(line: Column) -> Column:
    """What the rules ask of a line."""
    return F.struct(fields(line).alias("has"), leaf(line, "skuId").alias("sku"), leaf(line, "quantity").alias("quantity"))


def _line_errors(line: Column, i: Column) -> Column:
    at = F.concat(F.lit("$.lines["), i.cast("string"), F.lit("]"))
    sku, quantity = line["sku"], line["quantity"]
    in_line = lambda name: F.concat(at, F.lit(f".{name}"))
    number = F.when(is_number(quantity), quantity["text"].try_cast("double"))
    own = _present([
        _string(sku, in_line("skuId"), most=None, pattern=SKU_PATTERN),
        _fault(quantity, in_line("quantity"), (number.isNull() | (number != F.floor(number)), "integer expected")),
        _fault(quantity, in_line("quantity"), (number < 1, "must be at least 1"),
               (number > MAX_QUANTITY, f"must be at most {MAX_QUANTITY}"), required=False)])
    return F.when(line["has"].isNull(), F.array(F.concat(at, F.lit(": object expected")))).otherwise(
        F.concat(own, _extra(line["has"], LINE_KEYS, at)))


#: Text fields of an order and of its audit block, by the name of their leaf.
_FIELDS = {"ref": "externalOrderRef", "system": "sourceSystem", "store": "storeId", "channel": "channel",
           "customer": "customerRef"}
_STAMP_FIELDS = {"stamp_system": "sourceSystem", "received": "receivedAt", "correlation": "correlationId"}

#: JSON type of an array of lines of which none has another name or type; a line or field may still be null or missing.
_PLAIN_LINES = "ARRAY<OBJECT<quantity: BIGINT, skuId: STRING>>"


def canonical_errors(df: DataFrame, value: str = "value") -> DataFrame:
    """Add `errors`: the sorted messages of the closed canonical schema, empty for a valid order.

    Checked are JSON types, required fields, lengths, patterns, enums, 1 to 50 lines, whole quantities from 1 to 999
    (2.0 is whole), the receive time and unknown fields at every level. A message is parsed once, into a variant, whose
    objects are opened once. Lines whose common type and values are right are not read one by one.
    """
    parsed = once(df, _doc=F.try_parse_json(value))
    opened = once(parsed, _json=F.col("_doc").isNotNull(), _has=fields(F.col("_doc")))
    has, stamp_has = F.col("_has"), F.col("_stamp_has")
    opened = once(opened, _stamp_has=fields(has["audit"]), _lines_kind=kind(has["lines"]))
    leaves = {f"_{name}": F.struct(kind(found[key]).alias("kind"), text_of(found[key]).alias("text"))
              for found, keys in ((has, _FIELDS), (stamp_has, _STAMP_FIELDS)) for name, key in keys.items()}
    read = once(opened, _size=F.when(F.col("_lines_kind").startswith("ARRAY"), F.size(items(has["lines"]))),
                _plain=F.when(F.col("_lines_kind") == _PLAIN_LINES,
                              F.try_variant_get(has["lines"], "$", "array<struct<skuId:string,quantity:bigint>>")),
                **leaves)
    c = {name: F.col(f"_{name}") for name in (*_FIELDS, *_STAMP_FIELDS)}
    path = {name: F.lit(f"$.{key}") for name, key in _FIELDS.items()} | {
        name: F.lit(f"$.audit.{key}") for name, key in _STAMP_FIELDS.items()}
    stamped, size = stamp_has.isNotNull(), F.col("_size")
    enumerated = is_string(c["channel"]) & F.coalesce(c["channel"]["text"].isin(*CHANNELS), F.lit(False))

    own = _present([
        _string(c["ref"], path["ref"], 1), _string(c["system"], path["system"], 1),
        _string(c["store"], path["store"], most=None, pattern=STORE_PATTERN),
        _fault(c["channel"], path["channel"], (~enumerated, "not in the enumeration")),
        _string(c["customer"], path["customer"], required=False),
        F.when(has["lines"].isNull(), F.lit("$.lines: required")).when(size.isNull(), F.lit("$.lines: array expected"))
        .when(size == 0, F.lit("$.lines: must have at least 1 item"))
        .when(size > MAX_LINES, F.lit(f"$.lines: must have at most {MAX_LINES} items")),
        F.when(has["audit"].isNull(), F.lit("$.audit: required")).when(~stamped, F.lit("$.audit: object expected")),
        *[F.when(stamped, m) for m in (
            _string(c["stamp_system"], path["stamp_system"], 1), _string(c["correlation"], path["correlation"], 1),
            _string(c["received"], path["received"], most=None, pattern=DATE_TIME_PATTERN, say="date-time expected"))],
    ])
    good = F.forall("_plain", lambda x: F.coalesce(
        x["skuId"].rlike(SKU_PATTERN) & x["quantity"].between(1, MAX_QUANTITY), F.lit(False)))
    read_lines = F.transform(F.transform(items(has["lines"]), _line), _line_errors)
    in_lines = F.when(F.coalesce(size, F.lit(0)) == 0, _none()).when(good, _none()).otherwise(F.flatten(read_lines))
    found = F.concat(own, in_lines, _extra(has, ORDER_KEYS, F.lit("$")), _extra(stamp_has, AUDIT_KEYS, F.lit("$.audit")))
    errors = (F.when(~F.col("_json"), F.array(F.lit("request body is not valid JSON")))
              .when(has.isNull(), F.array(F.lit("$: object expected"))).otherwise(F.sort_array(found)))
    return read.select(*df.columns, errors.alias("errors"))


# Order fault codes in the order they are checked.
MISSING_AUDIT, BAD_REF, UNKNOWN_STORE = "ORD-MISSING-AUDIT", "ORD-BAD-REF", "ORD-UNKNOWN-STORE"
UNKNOWN_SKU, BAD_QUANTITY, DUPLICATE_REF = "ORD-UNKNOWN-SKU", "ORD-BAD-QUANTITY", "ORD-DUP-REF"


def line_faults(lines: DataFrame, skus: DataFrame) -> DataFrame:
    """First faulty line of each order by line number: unknown SKU before bad quantity on one line.

    One aggregate row per order, combined before the shuffle. An order without lines has no row.
    """
    known = skus.select(F.col("sku_id").alias("_sku")).distinct()
    joined = lines.join(known, F.col("sku_id") == F.col("_sku"), "left")
    code = F.when(F.col("_sku").isNull(), UNKNOWN_SKU).when(F.coalesce("quantity", F.lit(0)) < 1, BAD_QUANTITY)
    marked = joined.withColumn("_code", code)
    return marked.groupBy("order_id").agg(
        F.min(F.when(F.col("_code").isNotNull(), F.struct("line_no", "_code"))).alias("_first"),
        F.count(F.lit(1)).alias("line_count"),
    ).select("order_id", "line_count", F.col("_first._code").alias("line_fault"))


def first_fault(orders: DataFrame, lines: DataFrame, skus: DataFrame, known_store: Column) -> DataFrame:
    """Add `fault`, the first failing rule of every order request, null for an accepted order.

    Audit, then reference, store, lines by position, and last a repeated reference: within
    (source_system, external_order_ref) only the first request that passes everything else by
    (received_at, order_id) is accepted.
    """
    checked = orders.join(line_faults(lines, skus), "order_id", "left")
    own = (
        F.when(is_blank(F.col("audit_source")) | is_blank(F.col("correlation_id")) | F.col("received_at").isNull(),
               MISSING_AUDIT)
        .when(is_blank(F.col("external_order_ref")), BAD_REF)
        .when(~known_store, UNKNOWN_STORE)
        .when(F.coalesce("line_count", F.lit(0)) == 0, BAD_QUANTITY)
        .otherwise(F.col("line_fault"))
    )
    staged = checked.withColumn("_own", own)
    ref = ("source_system", "external_order_ref")
    winners = staged.where("_own is null").groupBy(*ref).agg(
        F.min(F.struct("received_at", "order_id")).alias("_win"))
    winners = winners.select(*[F.col(c).alias(f"_{c}") for c in ref], F.col("_win.order_id").alias("_winner"))
    # A request that already failed has no winner to find; its own id spreads it over the join.
    spread = F.when(F.col("_own").isNull(), F.col("external_order_ref")).otherwise(F.col("order_id"))
    on = (F.col("source_system") == F.col("_source_system")) & (F.col("_ref") == F.col("_external_order_ref"))
    fault = F.coalesce(F.col("_own"), F.when(F.col("_winner") != F.col("order_id"), F.lit(DUPLICATE_REF)))
    return staged.withColumn("_ref", spread).join(winners, on, "left").withColumn("fault", fault).withColumn(
        "original_order_id", F.when(F.col("fault") == DUPLICATE_REF, F.col("_winner"))).drop(
        "_own", "_ref", "_winner", *[f"_{c}" for c in ref], "line_fault")


def price_lines(lines: DataFrame, skus: DataFrame) -> DataFrame:
    """Lines with the unit price in their currency and the line amount; lines of unknown SKUs drop out."""
    unit = money.convert_from_cad(F.col("base_price_cad_minor"), F.col("currency"))
    return lines.join(skus.select("sku_id", "base_price_cad_minor"), "sku_id").withColumn(
        "unit_price_minor", unit).withColumn(
        "amount_minor", money.line_total(F.col("quantity"), F.col("unit_price_minor")))


def order_totals(priced: DataFrame) -> DataFrame:
    """Order total per order and currency."""
    return priced.groupBy("order_id", "currency").agg(
        F.sum("amount_minor").alias("total_amount_minor"), F.count(F.lit(1)).alias("line_count"))


def applied_price_list(wanted_code: Column) -> Column:
    """The price list that applies: there is only one, so any other code falls back to it."""
    return F.when(wanted_code == money.PRICE_LIST_CODE, wanted_code).otherwise(F.lit(money.PRICE_LIST_CODE))


def take_orders(orders: DataFrame, lines: DataFrame, skus: DataFrame, known_store: Column) -> tuple[DataFrame, DataFrame]:
    """The whole order job: validate, then price, total and number the accepted orders by (received_at, order_id).

    `lines` has a currency and `skus` a base price. Returns the accepted orders with total, lines and number, and the
    refused ones with their fault. Only lines of accepted orders are priced.
    """
    judged = first_fault(orders, lines, skus, known_store).drop("line_count")
    accepted = judged.where("fault is null")
    totals = order_totals(price_lines(lines.join(accepted.select("order_id"), "order_id", "left_semi"), skus))
    numbered = number_rows(accepted.join(totals, "order_id"), ("received_at", "order_id"))
    return (numbered.withColumn("erp_order_id", erp_order_id(F.col("row_no"))).drop("fault", "original_order_id"),
            judged.where("fault is not null"))
