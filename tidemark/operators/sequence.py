"""Dense row numbers over a whole table, without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_path

_SLOT_BITS = 33


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Add a dense 1-based number in the given order, which must be total over the table.

    Rows are range-partitioned and sorted once and written with their partition and position, so that
    later reads see the same partitions even when executors are lost. The offsets are a running sum
    over one count per partition; that small frame (a row per partition) is what gets broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "numbered")
    columns = [F.col(c) for c in order]
    (
        df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        .withColumn("_slot", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    position = F.col("_slot") - F.shiftleft(F.col("_part"), _SLOT_BITS)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + position + 1).cast("bigint"))
        .drop("_slot", "_part", "_before")
    )


def formatted_id(prefix: str, number: Column, digits: int = 6) -> Column:
    """`<prefix>000001`; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0")))


def order_id(number: Column) -> Column:
    return formatted_id("ORD-2026-", number)


def reservation_id(number: Column) -> Column:
    return formatted_id("RES-2026-", number)


def rolling_rate(df: DataFrame, row_no: str, failed: Column, calls: int = 10, minimum: int = 6,
                 threshold: float = 0.5, chunk: int = 10_000) -> DataFrame:
    """Failure rate over the last `calls` rows of a numbered log, and whether it trips the breaker.

    The log is cut into chunks of consecutive numbers; each chunk also gets the last rows of the one
    before, so the frame is complete and no window spans more than a chunk. A chunk must hold the tail
    that is copied.
    """
    if chunk < calls - 1:
        raise ValueError(f"a chunk of {chunk} rows cannot hold the {calls - 1} rows that the next one needs")
    no = F.col(row_no)
    own = F.floor((no - 1) / chunk).cast("bigint")
    tail = F.pmod(no - 1, F.lit(chunk)) >= chunk - (calls - 1)
    copies = F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)))
    spread = df.withColumn("_own", own).withColumn("_failed", failed.cast("int")).withColumn("_chunk", copies)
    frame = Window.partitionBy("_chunk").orderBy(row_no).rowsBetween(-(calls - 1), 0)
    seen, bad = F.count(F.lit(1)).over(frame), F.sum("_failed").over(frame)
    return (
        spread.withColumn("calls", seen).withColumn("failures", bad)
        .where("_chunk = _own")
        .withColumn("tripped", (F.col("calls") >= minimum)
                    & (F.col("failures") >= F.col("calls") * F.lit(threshold)))
        .drop("_own", "_failed", "_chunk")
    )
