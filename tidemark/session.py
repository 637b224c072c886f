"""Session settings and the shared scratch area."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runtime settings every job relies on: time zones are explicit (UTC), `dt` stays text on
#: read-back, a write replaces only the partitions it carries, and the batches that Python workers
#: get are bounded by bytes, whatever the length of a row. Of repeated fields in a JSON object the last counts.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "tidemark", memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return configure(builder.getOrCreate())


@functools.lru_cache(maxsize=None)
def _local_scratch(_app_id: str) -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and stream checkpoints.

    A cluster names it in `spark.checkpoint.dir`. Only a local session may fall back to a folder of
    its own machine; anywhere else the setting is required, because executors must all see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    return _local_scratch(spark.conf.get("spark.app.id", "local"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the scratch folder and read it back: its plan ends there, and it is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runtime settings for the time of a block; those before come back at its end."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: For jobs of many steps: what a step has shuffled is removed from disk when the step ends, not when the driver's memory
#: happens to be cleaned; and a step that makes or parses messages, which are little to shuffle but much to compute, gets
#: tasks by small slices, so that the last wave does not idle the cluster.
LONG_JOB = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
}


@contextmanager
def written_for(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """As `written`, on disk only and as small as it gets, for the time of a block: its space is given back at the end."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).write.mode(
            "overwrite").option("partitionOverwriteMode", "static").parquet(path)
