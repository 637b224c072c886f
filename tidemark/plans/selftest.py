"""Rule self-test: known violations, and every rule has to catch its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import dq

ORDER_SCHEMA = "seq int, order_id string, store_id string, region string, total_amount_minor bigint, currency string"
LINE_SCHEMA = ("seq int, order_id string, line_no int, sku_id string, quantity int, unit_price_minor bigint, "
               "currency string")
STORES, ORDERS = ("north", "south"), ("A", "B", "C")

SOUND_ORDER = {"order_id": "A", "store_id": "north", "region": "SG", "total_amount_minor": 700, "currency": "SGD"}
SOUND_LINE = {"order_id": "A", "line_no": 1, "sku_id": "tea", "quantity": 7, "unit_price_minor": 100, "currency": "SGD"}

#: What each row changes in a sound one. The keys A and (A, 1) stand thrice and twice, so the later ones are repeats.
ORDER_CHANGES = ({}, {"order_id": "B", "currency": None}, {"order_id": "C", "store_id": "west"}, {}, {},
                 {"order_id": "D", "store_id": None}, {"order_id": None})
LINE_CHANGES = ({}, {"line_no": 2, "quantity": -1}, {"order_id": "B", "sku_id": None}, {"order_id": "Z"}, {},
                {"order_id": None}, {"line_no": None}, {"order_id": "C", "quantity": None})


def rows_of(sound: dict, changes: tuple[dict, ...]) -> list[tuple]:
    """Numbered rows: the sound one with each of the changes."""
    return [(i, *(sound | change).values()) for i, change in enumerate(changes)]


def selftest_results(spark: SparkSession) -> DataFrame:
    """Counters of all six rule checks over the self-test rows."""
    orders = spark.createDataFrame(rows_of(SOUND_ORDER, ORDER_CHANGES), ORDER_SCHEMA)
    lines = spark.createDataFrame(rows_of(SOUND_LINE, LINE_CHANGES), LINE_SCHEMA)
    known = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    order_rules = dq.order_rules(("seq",), known(STORES, "store_id"))
    line_rules = dq.line_rules(("seq",), known(ORDERS, "order_id"))
    return dq.results([(dq.judged(orders, order_rules), order_rules), (dq.judged(lines, line_rules), line_rules)])


def run_selftest(spark: SparkSession) -> int:
    """0 when every rule found something, 2 otherwise."""
    rows = selftest_results(spark).collect()
    for r in sorted(rows):
        print(f"DQ-SELFTEST rule={r.rule_id} table={r.table_name} checked={r.checked} violations={r.violations} "
              f"caught={str(r.violations > 0).lower()}")
    return 0 if rows and all(r.violations > 0 for r in rows) else 2
