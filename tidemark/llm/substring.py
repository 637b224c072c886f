"""Removal of repeated passages with suffix trees that are partitioned by variable-length prefixes.

Suffixes are word suffixes, cut at `WINDOW` words, since only nodes that deep matter: the suffixes below such a node
repeat a window of that many words. A prefix of one word is extended word by word while too many suffixes begin with it,
so that frequent words split and no group of prefixes outgrows the memory of a task; the prefixes to extend are estimated
on the windows of at most `SAMPLE_DOCS` documents, which only affects the balance. Light prefixes are packed into groups
by hash. Labels of nodes are 64-bit hashes of their words. In each group the suffixes are sorted by the label of their
node at depth `WINDOW`; a node with two suffixes or more is a repeat, and its first suffix in the order of documents is
the one that stays.

A passage that many documents share is one node that no prefix can split. Blocks of documents therefore send only the
first suffix of each node they have, so a node never has more suffixes than there are blocks. What comes back to a block
is the list of its windows that start earlier elsewhere; neither texts nor windows of other blocks reach it.

The input is read twice and must be a table (a file scan), so that its blocks are the same both times; this is checked.

Cases: a null or empty text has no words and keeps the empty text; a null id comes after all others; rows that repeat an
id are documents of their own, of which the one read first counts as earlier; an empty table gives an empty result. Only
id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import (Windows, cut, list_lengths, mixed, packed, packed_numbers, unpacked,
                                 unpacked_numbers, window_starts, with_words, word_hashes)
from tidemark.llm.common import whole_text

WINDOW, GROUP_SUFFIXES, SAMPLE_DOCS, SAMPLE_CHARS = 20, 2_000_000, 2000, 50_000

#: Bytes of text per word, to size the groups, and the least sampled suffixes that make a prefix heavy.
WORD_BYTES, LEAST_SAMPLED = 6, 32

LAST = np.iinfo(np.int64).max


def heavy_prefixes(docs: DataFrame, window: int = WINDOW) -> tuple[int, list[np.ndarray]]:
    """Number of groups, and by length the sorted hashes of the prefixes to extend. Both follow from sizes and a sample.

    The collected table has at most (sampled windows / LEAST_SAMPLED) entries per length.
    """
    total = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WORD_BYTES
    groups = 1 + total // GROUP_SUFFIXES
    groups = max(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = docs.filter(F.length("text") <= SAMPLE_CHARS).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_words(batches):
            lists = batch["words"]
            windows, starts = Windows(word_hashes(lists.flatten())), window_starts(list_lengths(lists), window)
            for size in range(1, window):  # only a prefix that is not rare can have an extension that is heavy
                prefix, at, n = np.unique(windows.hash(starts, size), return_inverse=True, return_counts=True)
                often = n >= LEAST_SAMPLED // 8
                starts = starts[often[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(often.sum(), size, np.int32)), pa.array(prefix[often].view(np.int64)),
                     pa.array(n[often])], ["size", "prefix", "n"])

    counted = sample.select("text").mapInArrow(
        count, "size int, prefix bigint, n bigint").groupBy("size", "prefix").agg(F.sum("n").alias("n"))
    counted = counted.filter(F.col("n") >= LEAST_SAMPLED).collect()
    sampled = max(1, sum(r.n for r in counted if r.size == 1))  # nearly all: words seen less often are left out
    most = GROUP_SUFFIXES // 4
    heavy: list[list[int]] = [[] for _ in range(window)]
    for r in counted:
        if r.n / sampled * total > most:
            heavy[r.size].append(r.prefix)
    return groups, [np.sort(np.array(h, np.int64).view(np.uint64)) for h in heavy]


def prefix_groups(windows: Windows, starts: np.ndarray, heavy: list[np.ndarray], groups: int) -> np.ndarray:
    """The group of every suffix: that of its shortest prefix that is not heavy."""
    group, rest = np.zeros(len(starts), np.int64), np.arange(len(starts))
    for size in range(1, len(heavy) + 1):
        prefix = windows.hash(starts[rest], size)
        group[rest] = (mixed(prefix + np.uint64(size)) % np.uint64(groups)).view(np.int64)
        if size == len(heavy) or not len(heavy[size]):
            break
        at = np.minimum(np.searchsorted(heavy[size], prefix), len(heavy[size]) - 1)
        rest = rest[heavy[size][at] == prefix]
    return group


def document_order(ids: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """The id of every word's document, null as the last."""
    order = pc.fill_null(ids.cast(pa.int64()), LAST).to_numpy(zero_copy_only=False)
    return np.repeat(order, lengths)


def first_of_nodes(batch: pa.RecordBatch, window: int) -> tuple[Windows, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: windows, sorted node labels, first suffix of each node in document order, and the later suffixes."""
    lengths = list_lengths(batch["words"])
    windows, starts = Windows(word_hashes(batch["words"].flatten())), window_starts(lengths, window)
    label = windows.hash(starts, window)
    at = np.argsort(label)
    label, starts = label[at], starts[at]
    first = np.ones(len(label), bool)
    first[1:] = label[1:] != label[:-1]
    shared = ~first
    shared[:-1] |= ~first[1:]
    if shared.any():  # only suffixes that share a node need their order
        some, order = starts[shared], document_order(batch["id"], lengths)
        starts[shared] = some[np.lexsort((some, order[some], label[shared]))]
    return windows, label[first], starts[first], starts[~first]


def deep_nodes(rows: list[dict]) -> Iterator[tuple[str, np.ndarray]]:
    """Of one group: for every block the suffixes whose node has an earlier suffix in another block."""
    if len(rows) < 2:
        return
    label = np.concatenate([np.frombuffer(r["labels"], np.uint64) for r in rows])
    at = np.argsort(label)
    same = label[at][1:] == label[at][:-1]
    member = np.zeros(len(at), bool)
    member[1:] |= same
    member[:-1] |= same
    at = at[member]  # suffixes of nodes with several
    label = label[at]
    block = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])[at]
    order = np.concatenate([np.cumsum(unpacked_numbers(r["orders"], r["n"], np.int64)) for r in rows])[at]
    start = np.concatenate([np.cumsum(unpacked_numbers(r["starts"], r["n"], np.uint32), dtype=np.uint32)
                            for r in rows])[at]
    sorted_at = np.lexsort((start, block, order, label))
    label, block, start = label[sorted_at], block[sorted_at], start[sorted_at]
    later = np.zeros(len(label), bool)
    later[1:] = label[1:] == label[:-1]
    for b in np.unique(block[later]):
        yield rows[b]["block"], np.sort(start[later & (block == b)])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """Per document: id, n_words, n_removed, kept (kept words joined by one space), spans (start and length of what goes).

    A word goes if it lies in a window of `window` words that also starts earlier: in a document with a smaller id, or
    earlier in the same one. Windows are judged on the input. Ids are integers.
    """
    source = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    groups, heavy = heavy_prefixes(source, window)
    split = source.select("id", "text")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("labels", pa.binary()),
                            ("orders", pa.binary()), ("starts", pa.binary())])
        for name, batch in cut(with_words(batches)):
            windows, label, start, _ = first_of_nodes(batch, window)
            order = document_order(batch["id"], list_lengths(batch["words"]))
            by_start = np.argsort(start)
            label, start = label[by_start], start[by_start]
            group = prefix_groups(windows, start, heavy, groups)
            # keeps the starts sorted within a group; numbers of two bytes are sorted by counting
            at = np.argsort(group.astype(np.uint16) if groups < 1 << 16 else group, kind="stable")
            ends = np.searchsorted(group[at], np.arange(groups + 1))
            for g in np.flatnonzero(np.diff(ends)):
                mine = at[ends[g]:ends[g + 1]]
                yield pa.RecordBatch.from_pylist([{
                    "block": name, "part": int(g), "n": len(mine), "labels": label[mine].tobytes(),
                    "orders": packed_numbers(np.diff(order[start[mine]], prepend=0)),
                    "starts": packed_numbers(np.diff(start[mine], prepend=0).astype(np.uint32))}], schema)

    def repeats(table: pa.Table) -> pa.Table:
        rows = [{"block": b, "starts": packed_numbers(s), "n": len(s)} for b, s in deep_nodes(
            sorted(table.to_pylist(), key=lambda r: block_order(r["block"])))]
        return pa.Table.from_pylist(rows, pa.schema([("block", pa.string()), ("starts", pa.binary()),
                                                     ("n", pa.int64())]))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, batch in cut(with_words(batches)):
            _, _, _, later = first_of_nodes(batch, window)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), *(pa.array([packed(c)], pa.binary()) for c in (
                    batch["id"], pc.list_value_length(batch["words"]), pc.binary_join(batch["words"], " "),
                    pa.array(np.sort(later))))], ["block", "ids", "lengths", "texts", "later"])

    def remove(block: pa.Table, found: pa.Table) -> pa.Table:
        if not len(block):
            raise RuntimeError("the input changed between two reads; remove repeats from a stored table")
        row = block.to_pylist()[0]
        ids, lengths = unpacked(row["ids"]), unpacked(row["lengths"]).to_numpy(zero_copy_only=False)
        lines = unpacked(row["texts"])
        words = pc.split_pattern(lines.filter(pa.array(lengths > 0)), " ").flatten()
        later = [unpacked(row["later"]).to_numpy(), *(
            unpacked_numbers(r["starts"], r["n"], np.uint32).astype(np.int64) for r in found.to_pylist())]
        cover = np.zeros(len(words) + window + 1, np.int32)
        for starts in later:
            if len(starts) and starts[-1] + window > len(words):
                raise RuntimeError("the input changed between two reads; remove repeats from a stored table")
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
        gone = np.cumsum(cover)[:len(words)] > 0
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        removed = np.concatenate([[0], np.cumsum(gone)])[ends]
        kept = pa.ListArray.from_arrays(pa.array(ends - removed, pa.int32()), words.filter(pa.array(~gone)))
        # a span starts at a removed word that follows a kept one or begins a document
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        begin[ends[:-1][lengths > 0]] |= gone[ends[:-1][lengths > 0]]
        at = np.flatnonzero(begin)
        per_doc = np.concatenate([[0], np.cumsum(begin)])[ends]
        total = np.concatenate([[0], np.cumsum(gone)])
        size = np.diff(np.concatenate([total[at], total[-1:]]))
        from_start = at - ends[np.searchsorted(ends, at, side="right") - 1]
        spans = pa.StructArray.from_arrays([pa.array(from_start, pa.int64()), pa.array(size, pa.int64())],
                                           ["start", "length"])
        return pa.table({
            "id": ids, "n_words": pa.array(lengths, pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()),
            "kept": pc.binary_join(kept, " "),
            "spans": pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), spans)})

    found = split.mapInArrow(
        suffixes, "block string, part bigint, n bigint, labels binary, orders binary, starts binary").groupBy(
        "part").applyInArrow(repeats, "block string, starts binary, n bigint")
    blocks = split.mapInArrow(texts, "block string, ids binary, lengths binary, texts binary, later binary")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        remove, f"id {kind}, n_words bigint, n_removed bigint, kept string, "
                "spans array<struct<start:bigint,length:bigint>>").withColumnRenamed("id", id_col)


def block_order(name: str) -> tuple[int, ...]:
    """Blocks in the order in which they are read, for ties."""
    return tuple(map(int, name.split("-")))
