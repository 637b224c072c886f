"""Stepped load runs: steps by elapsed time, status counters, percentiles, breaking point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.percentiles import exact_percentiles

# Latency budget and tolerated infrastructure failures.
BUDGET_MS = 300
MAX_INFRA_PERCENT = 1


@dataclass(frozen=True)
class Profile:
    """Start of a run and its step lengths in seconds."""

    start: str
    step_s: int = 45
    ramp_s: int = 15


def tag_steps(log: DataFrame, profile: Profile) -> DataFrame:
    """Add step (from 1) and phase (ramp or hold)."""
    elapsed = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit(profile.start).cast("timestamp"))
    in_step = F.pmod(elapsed, F.lit(profile.step_s))
    return log.withColumn("step", (F.floor(elapsed / profile.step_s) + 1).cast("int")).withColumn(
        "phase", F.when(in_step < profile.ramp_s, "ramp").otherwise("hold"))


def counters(stepped: DataFrame) -> DataFrame:
    """Requests per step by status class; 503 also counts as 5xx."""
    s = F.col("status")
    named = s.isin(0, 201, 409, 422) | (s >= 500)
    return stepped.groupBy("step").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(s == 201).alias("n201"), F.count_if(s == 422).alias("n422"), F.count_if(s == 409).alias("n409"),
        F.count_if(s == 503).alias("n503"), F.count_if(s >= 500).alias("n5xx"), F.count_if(s == 0).alias("network"),
        F.count_if(~named).alias("other"))


def percentiles(stepped: DataFrame) -> DataFrame:
    """p95 and p99 per step over the 201 responses."""
    return exact_percentiles(stepped.where("status = 201"), ["step"], "time_ms", {"p95": 0.95, "p99": 0.99})


def report(stepped: DataFrame, budget_ms: int = BUDGET_MS, infra_percent: float = MAX_INFRA_PERCENT) -> DataFrame:
    """Counters and percentiles per step, and whether the step breaches a limit."""
    joined = counters(stepped).join(percentiles(stepped).select("step", "p95", "p99"), "step", "left")
    infra = (F.col("n5xx") + F.col("network")) * 100
    breached = (infra > F.col("requests") * infra_percent) | F.coalesce(F.col("p95") > budget_ms, F.lit(False))
    return joined.withColumn("breached", breached)


def breaking_point(steps: DataFrame) -> DataFrame:
    """The first breached step, null when none is."""
    return steps.agg(F.min(F.when(F.col("breached"), F.col("step"))).alias("breaking_step"),
                     F.count(F.lit(1)).alias("steps"))
