"""Money is an integer count of minor units plus a currency code; no floating point anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Region to currency, and the factors of the one price list (base currency CAD).
CURRENCY_BY_REGION = {"CA": "CAD", "SG": "SGD", "CN": "CNY"}
FX_FROM_CAD = {"CAD": "1.00", "SGD": "0.98", "CNY": "5.13"}
PRICE_LIST_CODE = "STD-2026"
PRICE_LIST_FROM = "2026-01-01"
PRICE_LIST_UNTIL = "2026-12-31"


def currency_of_region(region: Column) -> Column:
    """Currency code of a region; null for an unknown region."""
    out = F.lit(None).cast("string")
    for code, currency in CURRENCY_BY_REGION.items():
        out = F.when(region == code, currency).otherwise(out)
    return out


def fx_factor(currency: Column) -> Column:
    """Price-list factor of a currency as DECIMAL(6,2); null for an unsupported currency."""
    out = F.lit(None).cast("decimal(6,2)")
    for code, factor in FX_FROM_CAD.items():
        out = F.when(currency == code, F.lit(factor).cast("decimal(6,2)")).otherwise(out)
    return out


def convert_from_cad(base_minor: Column, currency: Column) -> Column:
    """Base CAD minor units times the factor, rounded half up to a whole minor unit."""
    product = base_minor.cast("decimal(20,0)") * fx_factor(currency)
    return F.round(product, 0).cast("bigint")


def to_minor(amount: Column) -> Column:
    """A two-digit amount column as integer minor units."""
    return (amount.cast("decimal(18,2)") * 100).cast("bigint")


def line_total(quantity: Column, unit_price_minor: Column) -> Column:
    """Quantity times unit price in 64-bit integers; null instead of an error on overflow."""
    return F.try_multiply(quantity.cast("bigint"), unit_price_minor.cast("bigint"))


def sum_minor(amount: Column) -> Column:
    """Sum of minor units, 0 for no rows or only nulls."""
    return F.coalesce(F.sum(amount), F.lit(0).cast("bigint"))
