"""Streaming request claims: keyed state with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.claims import CLAIM_MS, ClaimFold

OUTPUT = "key string, request_id long, status int, original_order_id string"
STATE = "until long, order_id string"


def _claim(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The claim rule of the batch fold over the rows of a key in this batch, the claim kept as state.

    The claim carries its own end by request time. The state itself times out on the clock after two
    claim lengths without a request, so that abandoned keys leave the store.
    """
    if state.hasTimedOut:
        state.remove()
        return
    fold = ClaimFold()
    held = fold.start()
    if state.exists:
        held["until"], held["order"] = state.get
    pdf = pd.concat(list(rows)).sort_values(["ts_ms", "request_id"])
    results = [fold.step(held, int(ts), bool(ok), str(order))
               for ts, ok, order in zip(pdf["ts_ms"], pdf["succeeds"], pdf["order_id"])]
    if held["until"] is None:
        if state.exists:
            state.remove()
    else:
        state.update((held["until"], held["order"]))
        state.setTimeoutDuration(2 * CLAIM_MS)
    yield pd.DataFrame({
        "key": [key[0]] * len(pdf), "request_id": pdf["request_id"].tolist(),
        "status": [r[0] for r in results], "original_order_id": [r[1] for r in results]})


def claim_requests(requests: DataFrame) -> DataFrame:
    """Streaming form of `dedupe_requests`: a claim, its duplicates and its release after a failure.

    The rows of a key in one batch are bounded by the trigger's row limit.
    """
    return requests.groupBy("key").applyInPandasWithState(
        _claim, outputStructType=OUTPUT, stateStructType=STATE, outputMode="append",
        timeoutConf=GroupStateTimeout.ProcessingTimeTimeout)


def write_claims(requests: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Claim outcomes appended to a table.

    State with a clock time-out asks for a further, empty batch after every batch, so a run that
    should end when the input is read turns such batches off.
    """
    conf, name = requests.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    former = conf.get(name)
    if once:
        conf.set(name, "false")
    try:
        writer = claim_requests(requests).writeStream.format("parquet").outputMode("append").option(
            "path", out).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
    finally:
        if once:
            conf.set(name, former)
