"""Alignment of the tokens of two tokenizers over the bytes of a text.

Tokenizer A is the byte-level vocabulary, B the vocabulary of pieces. Both cut the same bytes, a space and the text, and the
places where tokens of both end cut the tokens into groups. An A token and a B token are linked if their bytes overlap. Of
an A and a B boundary that follow each other, exactly one pair of tokens covers the bytes between, so the links of a text
are the distinct boundaries of both, one link each, and never more than the tokens of both together.

How many documents hold a pair of ids linked is counted in two ways. A table as long as vocabulary A gives for every A id
the B id with the same bytes. Pairs of that table, which are those of exact one-to-one groups, are counted in a vector of
that length per task, and only the sums of these vectors are shuffled. All other pairs come from irregular groups; each block
of documents sends its distinct ones, with the number of its documents that hold them, to the pair's count, and gets the
counts back. A pair that a third of all documents hold is one row per block.

The texts are read and encoded once. A block keeps its documents' results and, packed, the distinct pairs of each document
with their numbers of links, in a table in the shared scratch folder. The vector and the best count of every A id are the
only things that reach the driver, bounded by the vocabulary.

Cases: a text that is null or empty, or whose tokens do not give back a space and the text (characters that B normalises),
has no tokens: zeros and an empty `groups_sha256`. A null id is carried; repeated rows count as often as they come; an empty
table gives an empty result; a very long text is a block of its own. Ties for the highest count all count as best. Only the
named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import packed, packed_numbers, unpacked, unpacked_numbers
from tidemark.llm.common import stored, whole_text
from tidemark.llm.token_counts import encoding, safe_parts

#: Bytes of text of a block of documents.
BLOCK_BYTES = 6 << 20

META = ("n_a", "n_b", "n_groups", "n_links")
DONE = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


# ----------------------------------------------------------------------------------- vocabularies

@dataclass(frozen=True)
class Vocabulary:
    """The bytes of every id, and how many they are."""

    pieces: pa.Array
    sizes: np.ndarray


def _vocabulary(pieces: list[bytes]) -> Vocabulary:
    return Vocabulary(pa.array(pieces, pa.binary()), np.array([len(p) for p in pieces], np.int64))


@functools.lru_cache(maxsize=1)
def pieces_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=1)
def vocabularies(ranks_path: str, pattern: str, model_path: str) -> tuple[Vocabulary, Vocabulary, np.ndarray]:
    """A, B, and for every A id the B id with the same bytes, -1 if there is none.

    Bytes that B has both as a piece and as a byte token belong to the piece.
    """
    encoder, model = encoding(ranks_path, pattern), pieces_model(model_path)
    a = [encoder.decode_single_token_bytes(i) for i in range(encoder.n_vocab)]
    b, same = [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            b.append(bytes([int(piece[3:5], 16)]))
            same.setdefault(b[-1], i)
        elif model.is_control(i) or model.is_unknown(i):
            b.append(b"")
        else:
            b.append(piece.replace("▁", " ").encode())
            same[b[-1]] = i
    return _vocabulary(a), _vocabulary(b), np.array([same.get(p, -1) for p in a], np.int64)


@functools.lru_cache(maxsize=1)
def shown_ids(n_a: int, n_b: int) -> pa.Array:
    """Decimal ids with what follows them in the text of the groups: A with `,` and with `|`, B with `,`, `;` and nothing."""
    ids = lambda n, end: [f"{i}{end}" for i in range(n)]
    return pa.array(ids(n_a, ",") + ids(n_a, "|") + ids(n_b, ",") + ids(n_b, ";") + ids(n_b, ""), pa.large_binary())


# ---------------------------------------------------------------------------- one block of documents

@dataclass
class Aligned:
    """The alignment of a block: tokens of both sides, their ends in the block's bytes, documents by end."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    doc_ends: np.ndarray  # of documents with tokens
    docs: np.ndarray  # their places in the block

    def __post_init__(self):
        self.common = np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)
        self.cuts = np.union1d(self.ends_a, self.ends_b)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A id, B id and document (by order) of every link."""
        return (self.a[np.searchsorted(self.ends_a, self.cuts)], self.b[np.searchsorted(self.ends_b, self.cuts)],
                np.searchsorted(self.doc_ends, self.cuts))

    def per_doc(self, ends: np.ndarray) -> np.ndarray:
        """How many of the ends lie in each document."""
        return np.diff(np.searchsorted(ends, self.doc_ends, side="right"), prepend=0)

    def group_texts(self, n_a: int, n_b: int) -> list[memoryview]:
        """`a1,a2|b1;a3|b2,b3` of every document."""
        group_a, group_b = np.searchsorted(self.common, self.ends_a), np.searchsorted(self.common, self.ends_b)
        last_a = np.diff(group_a, append=len(self.common)) > 0
        last_b = np.diff(group_b, append=len(self.common)) > 0
        ends_doc = np.isin(self.ends_b, self.doc_ends, assume_unique=True)
        # a group's A tokens come before its B tokens and after all tokens of the groups before
        upto_a = np.searchsorted(group_a, np.arange(len(self.common)), side="right")
        before_b = np.searchsorted(group_b, np.arange(len(self.common)), side="left")
        row = np.empty(len(self.a) + len(self.b), np.int64)
        row[np.arange(len(self.a)) + before_b[group_a]] = self.a + np.where(last_a, n_a, 0)
        row[np.arange(len(self.b)) + upto_a[group_b]] = 2 * n_a + self.b + n_b * (last_b.astype(np.int64) + ends_doc)
        if not len(row):
            return []
        shown = shown_ids(n_a, n_b).take(pa.array(row))
        starts = np.frombuffer(shown.buffers()[1], np.int64)[:len(row) + 1]
        at = np.concatenate([[0], np.cumsum(self.per_doc(self.ends_a) + self.per_doc(self.ends_b))])
        text = memoryview(shown.buffers()[2])
        return [text[starts[i]:starts[j]] for i, j in zip(at[:-1], at[1:])]


def align(texts: list[str], ranks_path: str, pattern: str, model_path: str) -> Aligned:
    """Align the tokens of some texts."""
    a_vocab, b_vocab, _ = vocabularies(ranks_path, pattern, model_path)
    encoder, model = encoding(ranks_path, pattern), pieces_model(model_path)
    a_ids, b_ids, docs, sizes = [], [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        whole = b" " + text.encode()
        b = np.array(model.encode(text), np.int64)
        if int(b_vocab.sizes[b].sum()) != len(whole) or _joined(b_vocab, b) != whole:
            continue
        parts = [encoder.encode_to_numpy(part, disallowed_special=()) for part in safe_parts(" " + text)]
        a = np.concatenate(parts).astype(np.int64)
        if int(a_vocab.sizes[a].sum()) != len(whole) or _joined(a_vocab, a) != whole:
            continue
        a_ids.append(a)
        b_ids.append(b)
        docs.append(i)
        sizes.append(len(whole))
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *a_ids]), np.concatenate([none, *b_ids])
    return Aligned(a, b, np.cumsum(a_vocab.sizes[a]), np.cumsum(b_vocab.sizes[b]), np.cumsum(sizes, dtype=np.int64),
                   np.array(docs, np.int64))


def _joined(vocab: Vocabulary, ids: np.ndarray) -> memoryview | bytes:
    taken = vocab.pieces.take(pa.array(ids))
    data = taken.buffers()[2]
    # Arrow's buffers are of signed bytes, which differ from those of a bytes object
    return memoryview(data).cast("B")[:int(vocab.sizes[ids].sum())] if data is not None else b""


def document_pairs(aligned: Aligned, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (A id * n_b + B id) of a block; then, by document, places in them, numbers of links, and how
    many entries each document has."""
    a, b, doc = aligned.links()
    pair = a * n_b + b
    known, place = np.unique(pair, return_inverse=True)
    entries, links = np.unique(doc * len(known) + place, return_counts=True) if len(pair) else (pair, pair)
    owner = entries // max(len(known), 1)
    return known, entries - owner * len(known), links, np.bincount(owner, minlength=len(aligned.docs))


# ------------------------------------------------------------------------------------------ Spark jobs

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, list[str]]]:
    """Documents of a task in blocks of about `BLOCK_BYTES`, or one longer document."""
    task, number = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch["id"], batch["text"].to_pylist()):
            if texts and size + len(text) > BLOCK_BYTES:
                yield f"{task}-{number}", pa.array(ids, batch["id"].type), texts
                ids, texts, size, number = [], [], 0, number + 1
            ids.append(i.as_py())
            texts.append(text)
            size += len(text)
    if texts:
        yield f"{task}-{number}", pa.array(ids, batch["id"].type), texts


def blocks_of(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """A row per block of documents: ids, results known so far, and distinct pairs, all packed. To be written once."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_vocab, b_vocab, same = vocabularies(ranks_path, pattern, model_path)
        n_a, n_b = len(a_vocab.sizes), len(b_vocab.sizes)
        for name, ids, texts in _blocks(batches):
            aligned = align(texts, ranks_path, pattern, model_path)
            known, place, links, entries = document_pairs(aligned, n_b)
            meta = np.zeros((len(texts), 4), np.int64)
            for column, ends in enumerate((aligned.ends_a, aligned.ends_b, aligned.common, aligned.cuts)):
                meta[aligned.docs, column] = aligned.per_doc(ends)
            shas = [""] * len(texts)
            for doc, text in zip(aligned.docs.tolist(), aligned.group_texts(n_a, n_b)):
                shas[doc] = hashlib.sha256(text).hexdigest()
            sizes = np.zeros(len(texts), np.int64)
            sizes[aligned.docs] = entries
            # places rise within a document, so their steps are small
            steps = np.diff(place, prepend=0)
            begins = np.cumsum(entries) - entries
            steps[begins[entries > 0]] = place[begins[entries > 0]]
            exact = same[known // n_b] == known % n_b
            row = {
                "block": name, "n_docs": len(texts), "n_known": len(known), "n_entries": len(place),
                "ids": packed(ids), "shas": packed(pa.array(shas)), "meta": packed_numbers(meta.ravel()),
                "sizes": packed_numbers(sizes), "known": packed_numbers(np.diff(known, prepend=0)),
                "holders": packed_numbers(np.bincount(place, minlength=len(known)).astype(np.int64)),
                "exact": packed_numbers(exact.astype(np.uint8)),
                "steps": packed_numbers(steps.astype(np.int32)), "links": packed_numbers(links.astype(np.int32))}
            yield pa.RecordBatch.from_pylist([row], arrow)

    binary = ("ids", "shas", "meta", "sizes", "known", "holders", "exact", "steps", "links")
    arrow = pa.schema([("block", pa.string()), ("n_docs", pa.int64()), ("n_known", pa.int64()), ("n_entries", pa.int64()),
                       *((n, pa.binary()) for n in binary)])
    return rows.mapInArrow(encode, "block string, n_docs bigint, n_known bigint, n_entries bigint, "
                           + ", ".join(f"{n} binary" for n in binary))


def exact_counts(blocks: DataFrame, n_a: int, n_b: int) -> np.ndarray:
    """By A id, the number of documents that hold it linked to the B id with the same bytes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(n_a, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                known, holders, exact = _known(row)
                vector[known[exact] // n_b] += holders[exact]  # an A id has one such pair
        held = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(vector[held])], ["a", "n"])

    rows = blocks.select("n_known", "known", "holders", "exact").mapInArrow(count, "a bigint, n bigint")
    vector = np.zeros(n_a, np.int64)
    for row in rows.groupBy("a").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        vector[row.a] = row.n
    return vector


def _known(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a block, the number of its documents that hold each, and which have the same bytes."""
    n = row["n_known"]
    return (np.cumsum(unpacked_numbers(row["known"], n, np.int64)), unpacked_numbers(row["holders"], n, np.int64),
            unpacked_numbers(row["exact"], n, np.uint8).astype(bool))


def irregular_pairs(blocks: DataFrame) -> DataFrame:
    """Rows (block, pair, holders) of the pairs whose bytes differ."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known, holders, exact = _known(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * int((~exact).sum()), pa.string()), pa.array(known[~exact]),
                     pa.array(holders[~exact])], ["block", "pair", "holders"])

    return blocks.select("block", "n_known", "known", "holders", "exact").mapInArrow(
        unpack, "block string, pair bigint, holders bigint")


def pair_counts(blocks: DataFrame, same: np.ndarray, n_b: int, vector: np.ndarray | None = None) -> DataFrame:
    """All linked id pairs of a corpus (a_id, b_id, docs) from its written blocks."""
    spark = blocks.sparkSession
    vector = exact_counts(blocks, len(same), n_b) if vector is None else vector
    held = np.flatnonzero(vector)
    exact = spark.createDataFrame([(int(i), int(same[i]), int(vector[i])) for i in held],
                                  "a_id bigint, b_id bigint, docs bigint")
    others = irregular_pairs(blocks).groupBy("pair").agg(F.sum("holders").alias("docs"))
    return exact.unionByName(others.select(F.expr(f"pair div {n_b}").alias("a_id"),
                                           (F.col("pair") % n_b).alias("b_id"), "docs"))


def alignment_report(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    a_vocab, b_vocab, same = vocabularies(ranks_path, pattern, model_path)
    n_a, n_b = len(a_vocab.sizes), len(b_vocab.sizes)
    blocks = stored(blocks_of(docs, ranks_path, pattern, model_path, id_col, text_col), "aligned")
    vector = exact_counts(blocks, n_a, n_b)
    pairs = irregular_pairs(blocks)
    counts = stored(pairs.groupBy("pair").agg(F.sum("holders").alias("docs")), "pair-counts")
    best = vector.copy()
    for row in counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("docs").alias("n")).collect():
        best[row.a] = max(best[row.a], row.n)  # at most the vocabulary
    back = pairs.select("block", "pair").join(counts, "pair")
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        known, _, exact = _known(row)
        pair, n = found["pair"].to_numpy(), found["docs"].to_numpy()
        order = np.argsort(pair)
        held = vector[known // n_b]
        held[~exact] = n[order]  # both are in ascending order of the pairs
        top = held == best[known // n_b]
        sizes = unpacked_numbers(row["sizes"], row["n_docs"], np.int64)
        steps = unpacked_numbers(row["steps"], row["n_entries"], np.int32).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        # steps begin anew in every document
        rising = np.cumsum(steps)
        base = np.concatenate([[0], rising])[begins]
        place = rising - np.repeat(base, sizes)
        links = unpacked_numbers(row["links"], row["n_entries"], np.int32).astype(np.int64)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([begins, [len(x)]])])
        meta = unpacked_numbers(row["meta"], 4 * row["n_docs"], np.int64).reshape(-1, 4)
        return pa.table({
            "id": unpacked(row["ids"]), **{c: meta[:, i].copy() for i, c in enumerate(META)},
            "n_best": sums(links * top[place]), "count_sum": sums(links * held[place]),
            "groups_sha256": unpacked(row["shas"])})

    done = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, f"id {kind}, {DONE}")
    return done.withColumnRenamed("id", id_col)


def token_groups(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per document: id and `groups`, the groups of A and B ids that cover the same bytes, as (a, b), in order."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in _blocks(batches):
            x = align(texts, ranks_path, pattern, model_path)
            edges = lambda ends: pa.array(np.searchsorted(ends, np.concatenate([[0], x.common]), side="right"),
                                          pa.int32())
            lists = pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(edges(e), pa.array(t, pa.int32()))
                 for e, t in ((x.ends_a, x.a), (x.ends_b, x.b))], ["a", "b"])
            n = np.zeros(len(texts), np.int64)
            n[x.docs] = x.per_doc(x.common)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, lists)], ["id", "groups"])

    return rows.mapInArrow(group, f"id {kind}, groups array<struct<a:array<int>,b:array<int>>>").withColumnRenamed(
        "id", id_col)
