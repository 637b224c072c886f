"""Stock reservations: allocation in arrival order, release, expiry, position."""

from __future__ import annotations

import json
from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fold import Fold, ordered_fold

# Fixed value: a hold lasts 24 hours.
HOLD_MS = 24 * 3600 * 1000


class StockFold(Fold):
    """Reserve and release on one store and SKU.

    The state is the queue of open holds, which run out in the order in which they were made, and the quantity they hold
    together. Every hold enters and leaves the queue once, so a row takes constant time on average.
    """

    inputs = ("kind", "hold_id", "ts_ms", "quantity", "on_hand", "rejected")
    outputs = "outcome string, moved int, available int, fully_released boolean"
    horizon_ms = HOLD_MS

    def start(self) -> dict:
        return {"holds": OrderedDict(), "held": 0}

    def dump(self, state) -> str:
        return json.dumps([[hold, *end] for hold, end in state["holds"].items()])

    def load(self, text: str) -> dict:
        holds = OrderedDict((hold, end) for hold, *end in json.loads(text))
        return {"holds": holds, "held": sum(quantity for _, quantity in holds.values())}

    def step(self, state, kind, hold_id, ts_ms, quantity, on_hand, rejected=None):
        if rejected is not None:
            return rejected, 0, None, None
        holds = state["holds"]
        while holds:
            until, held = next(iter(holds.values()))
            if until >= ts_ms:
                break
            holds.popitem(last=False)
            state["held"] -= held
        free = int(on_hand) - state["held"]
        if kind == "reserve":
            wanted = int(quantity)
            if wanted > free:
                return "INSUFFICIENT", 0, free, None
            if hold_id in holds:  # a hold made anew runs out anew
                state["held"] -= holds.pop(hold_id)[1]
            holds[hold_id] = [int(ts_ms) + HOLD_MS, wanted]
            state["held"] += wanted
            return "RESERVED", wanted, free - wanted, None
        if hold_id not in holds:
            return "UNKNOWN_RESERVATION", 0, free, None
        held = holds[hold_id][1]
        freed = held if quantity is None or quantity < 1 else min(int(quantity), held)
        if freed == held:
            del holds[hold_id]
        else:
            holds[hold_id][1] -= freed
        state["held"] -= freed
        return "RELEASED", freed, free + freed, freed == held


def attach_stock(requests: DataFrame, stock: DataFrame, known_store: Column) -> DataFrame:
    """Requests with `on_hand` and a `rejected` code for what never reaches the stock row.

    Quantity first, then store, then SKU. An unknown store or SKU only concerns reserves: a release
    there refers to a hold that cannot exist.
    """
    joined = requests.join(stock.select("store_id", "sku_id", "on_hand"), ["store_id", "sku_id"], "left")
    reserve = F.col("kind") == "reserve"
    code = (
        F.when(reserve & (F.col("quantity") < 1), "BAD_QUANTITY")
        .when(reserve & ~known_store, "UNKNOWN_STORE")
        .when(reserve & F.col("on_hand").isNull(), "UNKNOWN_SKU")
        .when(F.col("on_hand").isNull(), "UNKNOWN_RESERVATION")
    )
    return joined.withColumn("rejected", code)


def allocate(requests: DataFrame, stock: DataFrame, known_store: Column, slices: int | None = None,
             folds: list[int] | None = None) -> DataFrame:
    """Outcome of every request, in order of (ts_ms, kind, seq) per store and SKU.

    A reserve is accepted if and only if its quantity is available at that moment; a rejected one
    consumes nothing; expired holds return before each request. Outcomes: RESERVED, INSUFFICIENT,
    RELEASED, UNKNOWN_RESERVATION, UNKNOWN_STORE, UNKNOWN_SKU, BAD_QUANTITY.
    """
    checked = attach_stock(requests, stock, known_store)
    order = ("ts_ms", "kind", "seq")
    return ordered_fold(checked, ("store_id", "sku_id"), order, StockFold(), slices, folds).drop("rejected")


def release_targets(releases: DataFrame, reserves: DataFrame) -> DataFrame:
    """Releases with the store and SKU of the hold they name; an unknown hold keeps nulls."""
    return releases.drop("store_id", "sku_id").join(
        reserves.where("kind = 'reserve'").select("hold_id", "store_id", "sku_id"), "hold_id", "left")


def open_holds(outcomes: DataFrame, as_of_ms: int) -> DataFrame:
    """Reserved quantity per store and SKU at an instant; expired holds are out.

    Accepted reserves count until they expire, releases of a hold reduce it.
    """
    live = outcomes.where(F.col("ts_ms") <= as_of_ms)
    per_hold = live.where(F.col("outcome").isin("RESERVED", "RELEASED")).groupBy("store_id", "sku_id", "hold_id").agg(
        F.max(F.when(F.col("outcome") == "RESERVED", F.col("ts_ms") + HOLD_MS)).alias("reserved_until"),
        F.sum(F.when(F.col("outcome") == "RESERVED", F.col("moved")).otherwise(-F.col("moved"))).alias("quantity"))
    return per_hold.where((F.col("quantity") > 0) & (F.col("reserved_until") >= as_of_ms)).groupBy(
        "store_id", "sku_id").agg(F.sum("quantity").alias("reserved"))


def position(stock: DataFrame, holds: DataFrame) -> DataFrame:
    """On hand, reserved and available per stock row."""
    reserved = F.coalesce(F.col("reserved"), F.lit(0)).cast("int")
    return stock.join(holds, ["store_id", "sku_id"], "left").select(
        "store_id", "sku_id", "on_hand", reserved.alias("reserved"), (F.col("on_hand") - reserved).alias("available"))


def expired_holds(outcomes: DataFrame, as_of_ms: int) -> DataFrame:
    """Holds that ran out by an instant with a quantity still open, per store and SKU."""
    per_hold = outcomes.where(F.col("outcome").isin("RESERVED", "RELEASED")).groupBy(
        "store_id", "sku_id", "hold_id").agg(
        F.max(F.when(F.col("outcome") == "RESERVED", F.col("ts_ms") + HOLD_MS)).alias("reserved_until"),
        F.sum(F.when(F.col("outcome") == "RESERVED", F.col("moved")).otherwise(-F.col("moved"))).alias("quantity"))
    return per_hold.where((F.col("quantity") > 0) & (F.col("reserved_until") < as_of_ms)).groupBy(
        "store_id", "sku_id").agg(F.count(F.lit(1)).alias("holds"), F.sum("quantity").alias("quantity"))
