"""Packing token pieces into sequences by minimum bin slack.

Every document is its token ids and an end id. Documents above the capacity are cut into pieces of the capacity, of which
the first may be shorter, so at most one piece of a document does not fill a sequence alone. The pieces that do are
sequences; for the others only their lengths matter, and a histogram of at most `capacity` lengths tells all about them.

Minimum bin slack works on that histogram: the longest length left opens a bin, and a subset-sum over the lengths that are
left, kept as the bits of a number (bit s: the sum s can be reached), finds the combination that fills it best. The same
combination is taken as often as the counts allow and its pieces are removed. Every round uses up a length or leaves too
few pieces of it for another bin alike, so the number of rounds is bounded by the capacity, not by the corpus.

The plan says which ranks of each length go into which sequences. Ranks are given in Spark: a piece's rank among those of
its length in its task is counted while the texts are encoded, and sums of the counts of the tasks before are added. The
plan has at most some thousand entries and is looked up by length and rank; no piece ever meets another one.

Cases: a null or empty text is one piece, the end id alone; a null id is carried; repeated rows are packed as often as they
come; an empty table gives an empty result; a very long text is encoded in parts at safe places and gives many pieces. Equal
lengths are packed in order of task and place in it. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stored
from tidemark.llm.token_counts import SPECIAL, encoding, safe_parts

CAPACITY, END_ID, SPECIAL_ID = 1024, 2, 50256


# ----------------------------------------------------------------- minimum bin slack over a histogram

def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths with the greatest sum of at most `room`, as (length, how many).

    Longer lengths are offered first, and the search stops at a combination without slack.
    """
    mask, target = (1 << (room + 1)) - 1, 1 << room
    reachable, steps = 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0 and not reachable & target:  # amounts 1, 2, 4, ... and the rest
            amount = min(take, left)
            grown = (reachable | reachable << (amount * length)) & mask
            steps.append((length, amount, reachable))
            reachable, left, take = grown, left - amount, take * 2
        if reachable & target:
            break
    total, used = reachable.bit_length() - 1, {}
    for length, amount, before in reversed(steps):
        if not before >> total & 1:
            total -= amount * length
            used[length] = used.get(length, 0) + amount
    return sorted(used.items(), reverse=True)


@dataclass(frozen=True)
class Bin:
    """A filling, as (length, how many), and the number of sequences that have it."""

    filling: tuple[tuple[int, int], ...]
    times: int


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bin]:
    """Fillings for all pieces of a histogram of lengths."""
    left = {length: n for length, n in counts.items() if n}
    bins = []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = dict(fullest(left, capacity - longest))
        left[longest] += 1
        rest[longest] = rest.get(longest, 0) + 1
        times = min(left[length] // n for length, n in rest.items())
        bins.append(Bin(tuple(sorted(rest.items(), reverse=True)), times))
        for length, n in rest.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return bins


def plan_places(bins: list[Bin]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces a sequence, offset of the first piece), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for b in bins:
        offset = 0
        for length, n in b.filling:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, n, offset))
            used[length] = rank + n * b.times
            offset += n * length
        sequence += b.times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def placed(places: dict[int, np.ndarray], lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == length)
        plan = places[length]
        row = plan[np.searchsorted(plan[:, 0], ranks[mine], side="right") - 1]
        nth = ranks[mine] - row[:, 0]
        sequence[mine] = row[:, 1] + nth // row[:, 2]
        offset[mine] = row[:, 3] + nth % row[:, 2] * length
    return sequence, offset


# ------------------------------------------------------------------------------------------ Spark jobs

def token_ids(encoder, text: str, end: int = END_ID) -> np.ndarray:
    """The ids of a text, the special string as its own id, and the end id."""
    found = []
    for i, segment in enumerate(text.split(SPECIAL)):
        if i:
            found.append(np.array([SPECIAL_ID], np.uint32))
        found += [encoder.encode_to_numpy(part, disallowed_special=()) for part in safe_parts(segment) if part]
    return np.concatenate([*found, np.array([end], np.uint32)]).astype("<u4", copy=False)


def pieces(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, its `task` and `rank` among the task's pieces of its length.

    `with_ids` adds the token ids. The ranks depend on the order in which a task reads its rows, so the result must be
    written before it is used twice.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    ids_type = pa.list_(pa.int32())

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks_path, pattern)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                tokens = token_ids(encoder, text.as_py() or "")
                n = len(tokens)
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = tokens[a:b]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part.tobytes()))
                    rank.append(int(seen[b - a]))
                    seen[b - a] += 1
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = [batch["id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                       pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, ids_type)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = (f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
           + (", ids array<int>" if with_ids else ""))
    return source.mapInArrow(cut_texts, out).withColumnRenamed("id", id_col)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a written table of `pieces`) with `sequence_id` and `offset`; `task` and `rank` are gone.

    What reaches the driver is the histogram: at most `capacity` counts.
    """
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select(F.col("length").alias("_length"), F.col("task").alias("_task"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan_places(plan_bins(counts, capacity))

    others = [c for c in cut.columns if c not in ("task", "rank")]
    ranked = cut.join(bases, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task"))).select(
        F.struct(*others).alias("row"), "length", (F.col("rank") + F.col("_base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = placed(places, batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(sequence), pa.array(offset)],
                                             ["row", "sequence_id", "offset"])

    kind = ranked.schema["row"].dataType.simpleString()
    return ranked.mapInArrow(place, f"row {kind}, sequence_id bigint, offset bigint").select(
        "row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from packed pieces with ids: `sequence_id`, `ids` and the pieces' (id, offset), by offset."""
    id_col = packed.columns[0]
    part = F.struct("offset", F.col(id_col).alias("id"), "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
                       F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["offset"].alias("offset"))).alias(
                           "pieces"))


def packed_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack(stored(pieces(docs, ranks_path, pattern, id_col, text_col), "pieces"))
