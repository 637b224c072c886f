"""Idempotent requests: the first claim of a key wins for 24 hours, a failed outcome releases it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.fold import Fold, ordered_fold

# Fixed value: a claim lasts 24 hours.
CLAIM_MS = 24 * 3600 * 1000


class ClaimFold(Fold):
    """One key: the state is the active claim and the order it committed."""

    inputs = ("ts_ms", "succeeds", "order_id")
    outputs = "status int, original_order_id string"
    horizon_ms = CLAIM_MS

    def start(self) -> dict:
        return {"until": None, "order": None}

    def step(self, state, ts_ms, succeeds, order_id):
        if state["until"] is not None and ts_ms < state["until"]:
            return 409, state["order"]
        if succeeds:
            state["until"], state["order"] = int(ts_ms) + CLAIM_MS, order_id
            return 201, order_id
        state["until"], state["order"] = None, None
        return 503, None


def dedupe_requests(requests: DataFrame, slices: int | None = None) -> DataFrame:
    """Status of every request (key, request_id, ts_ms, succeeds, order_id) and the order it refers to.

    201 executes and claims, 409 is a duplicate and carries the original order, 503 executed, failed
    and released its claim.
    """
    return ordered_fold(requests, ("key",), ("ts_ms", "request_id"), ClaimFold(), slices)
