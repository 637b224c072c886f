"""Ordered folds against plain Python, with hot keys cut into several slices."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.claims import ClaimFold, dedupe_requests
from tidemark.operators.sequence import number_rows, rolling_rate
from tidemark.operators.stock import StockFold, allocate

HOUR = 3_600_000


def requests(n, hot_share, seed, gap):
    rnd, rows, holds = random.Random(seed), [], []
    for i in range(n):
        key = "SKU-0001" if rnd.random() < hot_share else f"SKU-{rnd.randint(2, 9):04d}"
        ts = i * gap
        if holds and rnd.random() < 0.3:
            hold, key = rnd.choice(holds)
            rows.append(("ST-CA-01", key, "release", hold, ts, rnd.choice([None, 0, 1, 50]), f"{i:06d}"))
        else:
            holds.append((f"h{i}", key))
            rows.append(("ST-CA-01", key, "reserve", f"h{i}", ts, rnd.randint(1, 12), f"{i:06d}"))
    return rows


def brute(rows, on_hand):
    """The rule from its words: all open holds are looked at for every request."""
    states, out = {}, {}
    for store, sku, kind, hold, ts, qty, seq in sorted(rows, key=lambda r: (r[0], r[1], r[4], r[2], r[6])):
        live = states[sku] = {h: v for h, v in states.get(sku, {}).items() if v[0] >= ts}
        free = on_hand - sum(v[1] for v in live.values())
        if kind == "reserve":
            out[seq] = ("INSUFFICIENT", 0, free, None) if qty > free else ("RESERVED", qty, free - qty, None)
            if qty <= free:
                live[hold] = (ts + 24 * HOUR, qty)
        elif hold not in live:
            out[seq] = ("UNKNOWN_RESERVATION", 0, free, None)
        else:
            until, held = live.pop(hold)
            freed = held if qty is None or qty < 1 else min(qty, held)
            if freed < held:
                live[hold] = (until, held - freed)
            out[seq] = ("RELEASED", freed, free + freed, freed == held)
    return out


@pytest.mark.parametrize("slices,hot,gap", [(1, 0.4, HOUR), (7, 0.4, HOUR), (12, 0.95, HOUR // 2), (9, 1.0, HOUR * 30)])
def test_stock_fold_is_exact_for_any_slicing(spark, slices, hot, gap):
    rows = requests(900, hot, slices, gap)
    frame = spark.createDataFrame(rows, "store_id string, sku_id string, kind string, hold_id string, ts_ms bigint, "
                                        "quantity int, seq string")
    stock = spark.createDataFrame([("ST-CA-01", f"SKU-{k:04d}", 20) for k in range(1, 10)],
                                  "store_id string, sku_id string, on_hand int")
    got = allocate(frame, stock, F.lit(True), slices=slices).collect()
    want = brute(rows, 20)
    assert len(got) == len(rows)
    assert {r.seq: (r.outcome, r.moved, r.available, r.fully_released) for r in got} == want


@pytest.mark.parametrize("gap,every", [(HOUR // 2, 0), (HOUR // 2, 90), (HOUR * 25, 1)])
def test_one_hot_key_is_folded_at_most_twice(spark, gap, every):
    """One key over 16 slices: without idle time, with some, and idle after every request."""
    rnd, rows, ts = random.Random(gap + every), [], 0
    for i in range(1600):
        ts += gap + (26 * HOUR if every and i % every == 0 else 0)
        rows.append(("ST-CA-01", "SKU-0001", "reserve", f"h{i}", ts, rnd.randint(1, 4), f"{i:06d}"))
    frame = spark.createDataFrame(rows, "store_id string, sku_id string, kind string, hold_id string, ts_ms bigint, "
                                        "quantity int, seq string")
    stock = spark.createDataFrame([("ST-CA-01", "SKU-0001", 40)], "store_id string, sku_id string, on_hand int")
    passes = []
    got = allocate(frame, stock, F.lit(True), slices=16, folds=passes).collect()
    assert {r.seq: (r.outcome, r.moved, r.available, r.fully_released) for r in got} == brute(rows, 40)
    assert len(got) == len(rows) and passes[0] > 8 and sum(passes[1:]) < passes[0]
    if every == 1:  # all states are empty at the borders
        assert len(passes) == 1
    elif every:  # a gap inside every slice settles its end, so all heads are folded in one wave
        assert len(passes) == 2
    else:  # a chain: one slice a wave
        assert passes[1:] == [1] * (passes[0] - 1)


def test_reserve_ten(spark):
    rows = [("ST-CA-01", "SKU-0001", "reserve", f"h{i}", i, q, str(i)) for i, q in enumerate((4, 6, 1))]
    frame = spark.createDataFrame(rows, "store_id string, sku_id string, kind string, hold_id string, ts_ms bigint, "
                                        "quantity int, seq string")
    stock = spark.createDataFrame([("ST-CA-01", "SKU-0001", 10)], "store_id string, sku_id string, on_hand int")
    got = {r.seq: (r.outcome, r.available) for r in allocate(frame, stock, F.lit(True)).collect()}
    assert got == {"0": ("RESERVED", 6), "1": ("RESERVED", 0), "2": ("INSUFFICIENT", 0)}


@pytest.mark.parametrize("slices", [1, 5, 11])
def test_claims_for_any_slicing(spark, slices):
    rnd = random.Random(slices)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randint(1, 5)}", i, i * 2 * HOUR, rnd.random() < 0.5, f"o{i}")
            for i in range(600)]
    fold, states, want = ClaimFold(), {}, {}
    for key, rid, ts, ok, order in rows:
        want[rid] = fold.step(states.setdefault(key, fold.start()), ts, ok, order)
    frame = spark.createDataFrame(rows, "key string, request_id bigint, ts_ms bigint, succeeds boolean, order_id string")
    got = {r.request_id: (r.status, r.original_order_id) for r in dedupe_requests(frame, slices).collect()}
    assert got == want


def test_failed_request_releases_its_claim():
    fold = ClaimFold()
    state = fold.start()
    assert fold.step(state, 0, False, "a") == (503, None)
    assert fold.step(state, 1, True, "b") == (201, "b")
    assert fold.step(state, 2, True, "c") == (409, "b")
    assert fold.step(state, 1 + 24 * HOUR, True, "d") == (201, "d")


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(5000).withColumn("k", F.xxhash64("id"))
    got = number_rows(df, ("k",)).orderBy("k").select("row_no").collect()
    assert [r.row_no for r in got] == list(range(1, 5001))


def test_rolling_rate_crosses_chunks(spark):
    rows = [(i, i % 3 == 0 or 40 < i < 60) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "row_no bigint, bad boolean")
    got = {r.row_no: (r.calls, r.failures) for r in rolling_rate(df, "row_no", F.col("bad"), chunk=16).collect()}
    flags = [b for _, b in rows]
    for i in range(1, 201):
        seen = flags[max(0, i - 10):i]
        assert got[i] == (len(seen), sum(seen))
