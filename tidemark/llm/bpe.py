"""BPE encoding and decoding over a table of distinct words.

Spark splits every text into the words of the vocabulary's split pattern. A block is a run of documents of at most
`BLOCK_WORDS` words (or one longer document). Of a block, only its distinct words are shuffled, by hash; there each
distinct word is encoded once and its ids are sent back to the blocks that have it, where they are joined to the places
of the word. The places travel as indexes into the block's distinct words, so a text itself is never shuffled and a word
that holds a third of a corpus is one entry per block. Decoding joins the ids with the table of pieces, whose size is the
vocabulary's, and puts the bytes of each document together.

The split runs in the JVM. A text with a character that the JVM's tables do not know, or with the special string, is
split by the tokenizer library itself; the result is the library's in any case.

The input is read twice and must be a table (a file scan): its blocks have to be the same both times, which is checked.

Cases: a null or empty text has no ids and decodes to the empty text; a null id is carried; repeated rows give repeated
rows; an empty table gives an empty result. Only id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import BLOCK_WORDS, cut, list_lengths, packed, ragged, unpacked
from tidemark.llm.common import giving_back, whole_text

PARTS, NEAR = 64, 256

#: Words of a block, and distinct words whose ids a task keeps at hand; together they bound the memory of a worker.
BLOCK, CACHED = BLOCK_WORDS, 2_000_000
SPECIAL = "<|endoftext|>"

#: Fixed value: the split pattern of the vocabulary, in the JVM's syntax.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=1)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.lru_cache(maxsize=1)
def piece_bytes(path: str) -> pa.Array:
    """The bytes of every piece by id. In the file each byte is written as a printable character."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    table = {i: bytes(byte[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if i not in added} | added
    return pa.array([table.get(i) for i in range(max(table) + 1)], pa.binary())


def library_words(path: str, text: str) -> list[str]:
    """The words of a text as the library splits it; the special string is a word of its own."""
    split = tokenizer(path).pre_tokenizer.pre_tokenize_str
    words: list[str] = []
    for i, segment in enumerate(text.split(SPECIAL)):
        words += [SPECIAL] * bool(i)
        words += [segment[a:b] for _, (a, b) in split(segment)]
    return words


def blocks(batches: Iterator[pa.RecordBatch], path: str, most: int) -> Iterator[tuple[str, pa.Array, pa.ListArray]]:
    """Blocks of a task's documents: name, ids and word lists of at most `most` words, or one longer document."""
    def split() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["words"]
            if batch["text"].null_count < len(batch):  # texts that only the library splits right
                lists = pa.array([w if t is None else library_words(path, t) for w, t in zip(
                    lists.to_pylist(), batch["text"].to_pylist())], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch["id"], lists], ["id", "words"])

    for name, batch in cut(split(), most=most):
        yield name, batch["id"], batch["words"]


def distinct_words(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Index of every word of a block into its distinct words, these words, and the part of each."""
    coded = lists.flatten().dictionary_encode()
    part = np.array([zlib.crc32(w.encode()) % PARTS for w in coded.dictionary.to_pylist()], np.uint8)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary, part


# ------------------------------------------------------------------ Spark jobs

def split_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    odd = text.contains(SPECIAL) | text.rlike(r"\p{Cn}")
    return docs.select(F.col(id_col).alias("id"), F.when(odd, text).alias("text"),
                       F.when(odd, F.array().cast("array<string>")).otherwise(
                           F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))).alias("words"))


def decoded_texts(lists: pa.ListArray, path: str) -> list[str]:
    """The texts of lists of ids: ids are joined with the table of pieces, and bytes that are no UTF-8 are replaced."""
    counts = list_lengths(lists)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    found = pa.ListArray.from_arrays(offsets, piece_bytes(path).take(lists.flatten()))
    return [t.decode("utf-8", "replace") for t in pc.binary_join(found, b"").to_pylist()]


@functools.lru_cache(maxsize=1)
def decimal_ids(count: int) -> pa.Array:
    return pa.array([f"{i}," for i in range(count)], pa.large_binary())


def ids_digests(lists: pa.ListArray, count: int) -> list[str]:
    """SHA-256 of the decimal ids of every list, joined by commas; all ids are below `count`."""
    ends = np.concatenate([[0], np.cumsum(list_lengths(lists))])
    shown = decimal_ids(count).take(lists.flatten())
    if not len(shown):
        return [hashlib.sha256(b"").hexdigest()] * len(lists)
    at = np.frombuffer(shown.buffers()[1], np.int64)[ends].tolist()
    text = memoryview(shown.buffers()[2])
    return [hashlib.sha256(text[lo:max(lo, hi - 1)]).hexdigest() for lo, hi in zip(at, at[1:])]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and `ids`, the token ids of the whole text."""
    return encoded_blocks(docs, path, id_col, text_col, lambda ids: {"ids": ids}, "ids array<int>")


def encoded_blocks(docs: DataFrame, path: str, id_col: str, text_col: str,
                   finish: Callable[[pa.ListArray], dict[str, pa.Array]], columns: str, block: int = BLOCK,
                   cached: int = CACHED) -> DataFrame:
    """Per document: id and the `columns` that `finish` makes of the token ids of a block's documents, where these meet.

    Smaller blocks and fewer cached words take less memory and more shuffle.
    """
    split = split_words(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    @giving_back
    def words_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, lists in blocks(batches, path, block):
            _, words, part = distinct_words(lists)
            near = int(name.split("-")[0]) // NEAR
            rows = [{"block": name, "near": near, "part": p, "words": packed(words.take(pa.array(at)))}
                    for p in range(PARTS) if len(at := np.flatnonzero(part == p))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("block", pa.string()), ("near", pa.int32()), ("part", pa.int32()), ("words", pa.binary())]))

    @giving_back
    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                words = unpacked(row["words"]).to_pylist()
                if len(known) > cached:
                    known.clear()
                new = [w for w in words if w not in known]
                for word, coded in zip(new, tokenizer(path).encode_batch_fast(new, add_special_tokens=False)):
                    known[word] = coded.ids
                ids = pa.array([known[w] for w in words], pa.list_(pa.int32()))
                rows.append({"block": row["block"], "part": row["part"], "ids": packed(ids)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("block", pa.string()), ("part", pa.int32()), ("ids", pa.binary())]))

    @giving_back
    def places_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, lists in blocks(batches, path, block):
            index, words, part = distinct_words(lists)
            lengths = pc.list_value_length(lists)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([packed(ids)], pa.binary()), pa.array([packed(lengths)], pa.binary()),
                 pa.array([packed(pa.array(index))], pa.binary()), pa.array([packed(pa.array(part))], pa.binary())],
                ["block", "docs", "lengths", "places", "parts"])

    def join_back(block: pa.Table, coded: pa.Table) -> pa.Table:
        if not len(block):
            raise RuntimeError("the input changed between two reads; encode a stored table")
        row = block.to_pylist()[0]
        docs, lengths = unpacked(row["docs"]), unpacked(row["lengths"]).to_numpy(zero_copy_only=False)
        places, part = unpacked(row["places"]).to_numpy(), unpacked(row["parts"]).to_numpy()
        lists = [unpacked(r["ids"]) for r in sorted(coded.to_pylist(), key=lambda r: r["part"])]
        ids = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
        if len(ids) != len(part):
            raise RuntimeError("the input changed between two reads; encode a stored table")
        flat = ids.flatten().to_numpy()
        size = list_lengths(ids)
        first = np.cumsum(size) - size
        # the parts hold the words in the block's order, so a stable sort by part says where each word went
        order = np.argsort(part, kind="stable")
        word_first, word_size = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        word_first[order], word_size[order] = first, size
        out, totals, at = [], [], 0
        for n in lengths:
            here = places[at:at + n]
            found = flat[ragged(word_first[here], word_size[here])] if n else flat[:0]
            out.append(found)
            totals.append(len(found))
            at += n
        offsets = pa.array(np.concatenate([[0], np.cumsum(totals)]), pa.int32())
        values = pa.array(np.concatenate([flat[:0], *out]), pa.int32())
        return pa.table({"id": docs, **finish(pa.ListArray.from_arrays(offsets, values))})

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = split.mapInArrow(words_of_blocks, "block string, near int, part int, words binary")
    coded = words.repartition(tasks, "near", "part").mapInArrow(encode_words, "block string, part int, ids binary")
    places = split.mapInArrow(
        places_of_blocks, "block string, docs binary, lengths binary, places binary, parts binary")
    joined = places.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(
        join_back, f"id {kind}, {columns}")
    return joined.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add `decoded`, the text of `ids`, to the other columns: ids are joined with the table of pieces."""
    row = F.struct(*encoded.columns).alias("row")
    rows = encoded.select(row, F.col("ids").alias("todo"))

    @giving_back
    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = decoded_texts(batch["todo"], path)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], ["row", "decoded"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(join_pieces, f"row {kind}, decoded string").select("row.*", "decoded")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
            cached: int = CACHED) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256 and decoded_sha256. Ids are decoded where they are joined back."""
    def finish(ids: pa.ListArray) -> dict[str, pa.Array]:
        texts = decoded_texts(ids, path)
        return {"n_tokens": pa.array(list_lengths(ids)), "ids_sha256": pa.array(ids_digests(ids, len(piece_bytes(path)))),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())}

    return encoded_blocks(docs, path, id_col, text_col, finish,
                          "n_tokens bigint, ids_sha256 string, decoded_sha256 string", block, cached)
