"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add computed columns behind a one-row generator: each is computed once, however often it is read."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared scratch folder and read it back, which cuts its lineage."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this process has freed to the system; without it a reused worker keeps the most it ever took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other C libraries return memory themselves
    if trim is not None:
        trim(0)


def giving_back(rows: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """An Arrow function whose worker gives back the memory of its task when this ends."""
    @functools.wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run
