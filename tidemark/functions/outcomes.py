"""Outcome classes of requests and faults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fault codes by subsystem.
ORDER_CODES = ("ORD-UNKNOWN", "ORD-UNKNOWN-STORE", "ORD-UNKNOWN-SKU", "ORD-BAD-QUANTITY", "ORD-BAD-REF",
               "ORD-DUP-REF", "ORD-MISSING-AUDIT")
INVENTORY_CODES = ("INV-OUT-OF-STOCK", "INV-UNKNOWN-STORE", "INV-UNKNOWN-SKU", "INV-BAD-QUANTITY",
                   "INV-UNKNOWN-RESERVATION")
PRICING_CODES = ("PRC-SKU-UNKNOWN",)
UPSTREAM_UNAVAILABLE = "UPSTREAM-UNAVAILABLE"
CIRCUIT_OPEN = "CIRCUIT-OPEN"
SAGA_STEPS = ("order", "reserve", "pricing", "confirm")


def outcome_class(status: Column) -> Column:
    """Who has to act on a response status: SUCCESS, SENDER, BUSINESS, RECEIVER, NETWORK or OTHER."""
    return (
        F.when(status == 201, "SUCCESS")
        .when(status.isin(400, 409), "SENDER")
        .when(status == 422, "BUSINESS")
        .when(status.isin(500, 503), "RECEIVER")
        .when(status == 0, "NETWORK")
        .otherwise("OTHER")
    )


def fault_class(code: Column) -> Column:
    """BUSINESS for a contract fault code, INFRA for any other code, null without a code."""
    known = [*ORDER_CODES, *INVENTORY_CODES, *PRICING_CODES]
    return F.when(code.isNull(), F.lit(None).cast("string")).when(code.isin(*known), "BUSINESS").otherwise("INFRA")


def fault_subsystem(code: Column) -> Column:
    """Subsystem that raised a contract fault code, null for other codes."""
    return (
        F.when(code.isin(*ORDER_CODES), "ORDERS")
        .when(code.isin(*INVENTORY_CODES), "INVENTORY")
        .when(code.isin(*PRICING_CODES), "PRICING")
    )
