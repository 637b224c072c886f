"""Blocks of documents in Arrow functions: cutting them, packing columns, and hashes of word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_WORDS = 2 << 20

#: Odd multiplier of the polynomial window hash and its inverse modulo 2^64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def ascii_words(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def list_lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def split_words(texts: pa.Array) -> pa.ListArray:
    """The same words in an Arrow function."""
    trimmed = pc.ascii_trim_whitespace(texts)
    lists = pc.ascii_split_whitespace(trimmed)
    lengths = list_lengths(lists) - pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    words = lists.flatten()
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()),
                                    words.filter(pc.greater(pc.binary_length(words), 0)))


def with_words(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches with `words` in the place of the text."""
    for batch in batches:
        others = [n for n in batch.schema.names if n != text]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in others), split_words(batch[text])], [*others, "words"])


def cut(batches: Iterator[pa.RecordBatch], column: str = "words",
        most: int = BLOCK_WORDS) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Runs of rows with at most `most` list elements (or one longer row), named by task and number."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        lengths, start = list_lengths(batch[column]), 0
        while start < len(batch):
            stop = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:]), most, side="right")))
            yield f"{task}-{number}", batch.slice(start, stop - start)
            start, number = stop, number + 1


def packed(column: pa.Array) -> bytes:
    """One Arrow column as a compressed message."""
    out = pa.BufferOutputStream()
    batch = pa.record_batch([column], ["c"])
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Array:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch().column(0)


def packed_numbers(values: np.ndarray) -> bytes:
    """Numbers by byte planes, which compress well where the high bytes agree."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked_numbers(data: bytes, count: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, count * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, count).T).view(kind).reshape(count)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash, so that each of its bits depends on all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word; distinct words are hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64,
                        len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)


class Windows:
    """Hashes of the windows of any size over a run of word hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        powers = np.full(n + 1, STEP, np.uint64)
        powers[0] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(powers)[:-1])])
        backs = np.full(n + 1, BACK, np.uint64)
        backs[0] = 1
        self.backs = np.cumprod(backs)

    def hash(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        length = np.asarray(size).astype(np.uint64)
        return mixed((self.sums[starts + size] - self.sums[starts]) * self.backs[starts] + length)


def window_starts(lengths: np.ndarray, size: int) -> np.ndarray:
    """First words of all windows of `size` words that lie within one document."""
    return ragged(np.cumsum(lengths) - lengths, np.maximum(lengths - size + 1, 0))
