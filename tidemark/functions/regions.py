"""Regions and store codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
REGIONS = ("CA", "SG", "CN")
STORES_PER_REGION = {"CA": 3, "SG": 3, "CN": 2}
STORE_PREFIX = "ST-"


def region_of_store(store_id: Column) -> Column:
    """Region code inside a store id (`ST-CA-01`), case-insensitive; null when the id is malformed."""
    upper = F.upper(store_id)
    code = F.substring(upper, 4, 2)
    well_formed = (F.length(store_id) >= 8) & upper.startswith(STORE_PREFIX) & code.isin(*REGIONS)
    return F.when(well_formed, code)


def is_known_store(store_id: Column) -> Column:
    """Membership in the fixed store directory."""
    known = [f"ST-{r}-{n:02d}" for r, count in STORES_PER_REGION.items() for n in range(1, count + 1)]
    return F.coalesce(store_id.isin(*known), F.lit(False))
