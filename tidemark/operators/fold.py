"""Ordered folds per key for rules whose outcome depends on every earlier outcome of the key.

Stock allocation and request claims are sequential per key, yet one key may hold a third of all rows. The rows are
range-partitioned by key *and* order, so a hot key is cut into many slices of about equal size, and all slices are folded
at once from an empty state. Two facts settle most of them:

* A slice that begins with a new key, or later than the rule's `horizon_ms` after the row before it, begins with an empty
  state: whatever was held has run out. Only its borders have to be known.
* A slice that has such a place inside, a new key or a gap, ends in a state that does not depend on how it began. Only its
  head, the rows before the first such place, does.

The heads of the other slices are folded a second time, each once, when the state before them is final: at first all those
after a settled slice, at once, then those after these. A chain of slices without a gap takes as many waves as it has
slices, as its rule is sequential, but no slice is folded more than twice.

States stay in tables and reach the slices that need them as rows. The driver gets one record per slice: its first and
last key and time and whether it is settled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from tidemark.session import scratch_path


class Fold:
    """A step rule: `outputs` as DDL, `start` for an unseen key, `step` for one row.

    `step` gets the state and the values of `inputs`, changes the state in place and returns the output values. A row
    more than `horizon_ms` after the row before it, by the input `time`, must do what it would do on the empty state.
    `dump` and `load` give the state as text and back; it must be bounded by what a key holds within the horizon.
    """

    inputs: tuple[str, ...] = ()
    outputs: str = ""
    time: str = "ts_ms"
    horizon_ms: int | None = None

    def output_names(self) -> list[str]:
        return [field.split()[0] for field in self.outputs.split(",")]

    def start(self):
        raise NotImplementedError

    def step(self, state, *values) -> tuple:
        raise NotImplementedError

    def dump(self, state) -> str:
        return json.dumps(state, sort_keys=True)

    def load(self, text: str):
        return json.loads(text)

    def forgets(self, before: int | None, now: int | None) -> bool:
        """Whether nothing of the state is left after the time between two rows of a key."""
        return self.horizon_ms is not None and before is not None and now is not None and (
            now - before > self.horizon_ms)


#: Columns beside the rows: slice, whether the row is in its head, the record of a slice, its end state, the state before.
SLICE, HEAD, RECORD, STATE, SEED = "_slice", "_head", "_record", "_state", "_seed"


def _fold_slices(fold: Fold, keys: Sequence[str], schema: pa.Schema, seeded: bool):
    """Partition function: rows sorted by (slice, key, order) in, rows with outputs and one record per slice out.

    With `seeded`, the first row of a slice carries the state to begin with and is no row of its own.
    """
    names = fold.output_names()
    out_fields = [schema.field(i) for i in range(len(schema)) if schema.field(i).name in names]
    carried = [schema.field(i) for i in range(len(schema)) if schema.field(i).name not in
               (*names, HEAD, RECORD, STATE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, key, first, state, head, at, rows = None, None, None, None, True, None, 0

        def record() -> pa.RecordBatch:
            text = json.dumps({"first": first, "last": [key, at], "settled": not head})
            filled = {SLICE: current, RECORD: text, STATE: fold.dump(state)}
            return pa.RecordBatch.from_arrays(
                [pa.array([filled.get(f.name)], f.type) for f in schema], schema=schema)

        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023,E731
            results, heads, kept, done = [], [], [], []
            seeds = column(SEED) if seeded else [None] * len(batch)
            values = zip(column(SLICE), seeds, zip(*[column(c) for c in keys]), column(fold.time),
                         *[column(c) for c in fold.inputs])
            for i, (s, seed, k, now, *row) in enumerate(values):
                if s != current:
                    if current is not None and rows:
                        done.append(record())
                    current, first, head, state, rows = s, None, True, fold.start(), 0
                if seed is not None:
                    state = fold.load(seed)
                    continue
                if first is None:
                    first = [k, now]
                elif k != key or fold.forgets(at, now):
                    head, state = False, fold.start()
                key, at, rows = k, now, rows + 1
                results.append(fold.step(state, *row))
                heads.append(head)
                kept.append(i)
            if kept:
                taken = batch if len(kept) == len(batch) else batch.take(pa.array(kept))
                outputs = [pa.array(list(values), f.type) for f, values in zip(out_fields, zip(*results))]
                arrays = [*(taken.column(f.name) for f in carried), *outputs, pa.array(heads, pa.bool_()),
                          pa.nulls(len(kept), pa.string()), pa.nulls(len(kept), pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            yield from done
        if current is not None and rows:
            yield record()

    return run


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold,
                 slices: int | None = None, folds: list[int] | None = None) -> DataFrame:
    """Rows of `df` with the outputs of `fold`, folded per key in the given (total) order.

    `folds`, if given, is filled with the number of slices that each pass folded.
    """
    spark = df.sparkSession
    out_fields = StructType.fromDDL(fold.outputs).fields
    sort = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(slices, *sort) if slices else df.repartitionByRange(*sort)
    ranged = ranged.sortWithinPartitions(*sort).withColumn(SLICE, F.spark_partition_id())
    schema = StructType([
        *[StructField(f.name, f.dataType) for f in df.schema.fields], StructField(SLICE, IntegerType()), *out_fields,
        StructField(HEAD, BooleanType()), StructField(RECORD, StringType()), StructField(STATE, StringType())])
    arrow_schema = to_arrow_schema(schema)
    root = scratch_path(spark, "fold")

    def write(rows: DataFrame, wave: int, seeded: bool) -> DataFrame:
        path = f"{root}/wave-{wave}"
        rows.mapInArrow(_fold_slices(fold, keys, arrow_schema, seeded), schema).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    base = write(ranged, 0, False)
    records = {r[SLICE]: json.loads(r[RECORD]) for r in base.where(F.col(RECORD).isNotNull()).select(
        SLICE, RECORD).toLocalIterator()}  # one small record per slice, without its state
    before = _chained(records, fold)
    final_in = {s: base for s in records if s not in before or records[s]["settled"]}
    waiting, waves, passes = dict(before), [], folds if folds is not None else []
    passes.append(len(records))
    while waiting:
        ready = {s: p for s, p in waiting.items() if p in final_in}
        pairs = spark.createDataFrame(sorted(ready.items()), f"{SLICE} int, _before int")
        rows = base.where(F.col(HEAD)).join(F.broadcast(pairs.select(SLICE)), SLICE).select(*df.columns, SLICE)
        states = _states(final_in, set(ready.values())).withColumnRenamed(SLICE, "_before").join(
            F.broadcast(pairs), "_before").select(SLICE, F.col(STATE).alias(SEED))
        seeded = rows.withColumn(SEED, F.lit(None).cast("string")).unionByName(states, allowMissingColumns=True)
        dealt = seeded.repartition(len(ready), SLICE).sortWithinPartitions(SLICE, F.col(SEED).isNull(), *sort)
        again = write(dealt, len(waves) + 1, True)
        waves.append(again)
        passes.append(len(ready))
        for s in ready:
            final_in.setdefault(s, again)
            del waiting[s]

    columns = [*df.columns, *fold.output_names()]
    rows = base.where(F.col(RECORD).isNull())
    if not waves:
        return rows.select(*columns)
    redone = spark.createDataFrame([(s,) for s in sorted(before)], f"{SLICE} int").withColumn(HEAD, F.lit(True))
    kept = rows.join(F.broadcast(redone), [SLICE, HEAD], "left_anti").select(*columns)
    fixed = spark.read.schema(schema).parquet(*[f"{root}/wave-{i + 1}" for i in range(len(waves))])
    return kept.unionByName(fixed.where(F.col(RECORD).isNull()).select(*columns))


def _chained(records: dict[int, dict], fold: Fold) -> dict[int, int]:
    """The slices that begin in a state left by the slice before them, with that slice."""
    indexes = sorted(records)
    found = {}
    for before, here in zip(indexes, indexes[1:]):
        (last_key, last_at), (first_key, first_at) = records[before]["last"], records[here]["first"]
        if last_key == first_key and not fold.forgets(last_at, first_at):
            found[here] = before
    return found


def _states(final_in: dict[int, DataFrame], wanted: set[int]) -> DataFrame:
    """Final end states (slice, state) of the wanted slices, from the tables that hold them."""
    tables = {id(final_in[s]): final_in[s] for s in wanted}
    parts = []
    for key, table in tables.items():
        mine = sorted(s for s in wanted if id(final_in[s]) == key)
        names = table.sparkSession.createDataFrame([(s,) for s in mine], f"{SLICE} int")
        parts.append(table.where(F.col(RECORD).isNotNull()).select(SLICE, STATE).join(F.broadcast(names), SLICE))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
