"""Bench the headline queries: one JSON line with the seconds of every query, their sum, and DuckDB's on the same SQL.

Every query runs once on the smallest tables first, so that start-up and code generation are not counted.
"""

from __future__ import annotations

import contextlib
import json
import os
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import oracle  # noqa: E402

from tidemark.queries import ORACLES, QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "silver_orders", "silver_lines_latest", "silver_lines_latest_maxby", "silver_line_totals_by_currency",
    "bronze_envelope_decode", "bronze_inventory", "dq_unique_lines", "dq_referential_lines", "dq_results",
    "gold_fact_orders", "gold_fact_order_lines", "recon_by_currency", "daily_batch_full", "mask_customer_ref",
    "order_pricing", "order_validation_first_error", "canonical_validation", "order_ids_sequential",
    "poison_routing", "price_fallback_lines", "success_events", "dlq_events", "stock_allocation",
    "idempotent_requests", "transcript_violations", "transcript_durations", "load_step_percentiles",
    "rolling_failure_rate", "audit_q2", "dashboard_p95_minute_full", "alert_dlq_sliding", "freshness_heartbeat",
    "stream_land_bronze", "stream_minute_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="tidemark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    small = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    con = oracle.connect(sf_dir)
    con.execute(f"SET threads = {os.environ.get('BENCH_CPUS', '8')}")
    seconds, duckdb_seconds = {}, {}

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        with contextlib.redirect_stdout(sys.stderr):
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in wanted:
        run(name, small)  # compiles the plan's code; not counted
        seconds[name] = run(name, sf_dir)
        start = time.perf_counter()
        con.sql(ORACLES[name]).to_arrow_table()
        duckdb_seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], duckdb_seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "duckdb": duckdb_seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
