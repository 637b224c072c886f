"""Language identification with segmentation-marginalised unigrams.

Each language has a probability per piece of a fixed public vocabulary. The probability of a word is the sum over all its
segmentations into pieces of the product of their probabilities, computed by a forward pass; a document's score under a
language is the sum of the logs over its words. The piece probabilities are fitted by expectation maximisation, with the
expected piece counts of a forward and a backward pass, from the word counts of at most `TRAIN_DOCS` labelled documents
per language, drawn in `DRAWS` parts; a part is closed once it has `TRAIN_CHARS` characters, and the document that passes
this bound is taken whole, so that every label is learned, however long its documents are. That sample is the only bound;
every whole text is scored. A model takes about 0.2 MB per label.

Words are maximal runs of letters in lower case. Runs of more than `LONGEST` letters are scored in parts. Distinct words
of an Arrow batch are scored once, all words of one length together.

The reported score is the posterior of the best language under equal priors, with the evidence of a text scaled to that
of `EVIDENCE` letters at most, so that long texts do not all end at 1.

Cases: a text that is null or has no letter is `und` with score 0, and so is every text if nothing could be learned; a
null label is not learned from; a null id counts as empty text in the hold-out rule; ties go to the first language by
code point; an empty table gives an empty result. Only id, text and label are read; extra columns cannot clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import cut
from tidemark.llm.common import giving_back, whole_text

TRAIN_DOCS, TRAIN_CHARS = 1000, 1_000_000
LONGEST, MAX_PIECE, EVIDENCE, ROUNDS = 32, 8, 50, 2

#: Labels up to which the ids of the sample are broadcast.
SMALL_LABELS = 200

#: Probability of a letter that no piece covers, and the count that every piece has at least.
UNKNOWN, LEAST = 1e-7, 0.05

#: What a text without letters gets.
UNKNOWN_LANGUAGE = "und"

#: The sample of a language is drawn in so many parts, so that no task sees all its documents.
DRAWS = 50

#: Multiplier of the rolling hash that looks pieces up.
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Languages and the probabilities of every piece, one row per language."""

    vocabulary: str
    languages: tuple[str, ...]
    probabilities: np.ndarray


@functools.lru_cache(maxsize=2)
def pieces(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the letter pieces of a vocabulary file, and the index of each. The word mark is dropped."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    names = {model.id_to_piece(i).lstrip("▁").lower() for i in range(model.get_piece_size())}
    names = sorted(n for n in names if n.isalpha() and len(n) <= MAX_PIECE)
    hashes = np.array([piece_hash(n) for n in names], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order.astype(np.int64)


def piece_hash(piece: str) -> int:
    value = 0
    for c in piece:
        value = (value * int(STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return value


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words grouped by length: their places in the input and their code points as a matrix."""
    text = "".join(words.to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, codes[starts[at][:, None] + np.arange(n)]


def lookups(codes: np.ndarray, vocabulary: str) -> dict[tuple[int, int], np.ndarray]:
    """(start, size) -> piece index of that part of every word, -1 where it is no piece."""
    hashes, order = pieces(vocabulary)
    found = {}
    with np.errstate(over="ignore"):
        for i in range(codes.shape[1]):
            h = np.zeros(len(codes), np.uint64)
            for k in range(1, min(MAX_PIECE, codes.shape[1] - i) + 1):
                h = h * STEP + codes[:, i + k - 1] + np.uint64(1)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                found[i, k] = np.where(hashes[at] == h, order[at], -1)
    return found


def chances(probabilities: np.ndarray, piece: np.ndarray, size: int) -> np.ndarray:
    """Probabilities (languages x words) of a looked-up part."""
    p = np.where(piece >= 0, probabilities[:, piece], UNKNOWN if size == 1 else 0.0)
    return p


def forward(probabilities: np.ndarray, found: dict, length: int, count: int) -> list[np.ndarray]:
    """alpha[j]: summed probability of all segmentations of the first j letters."""
    alpha = [np.ones((len(probabilities), count))]
    for j in range(1, length + 1):
        alpha.append(sum(alpha[j - k] * chances(probabilities, found[j - k, k], k)
                         for k in range(1, min(MAX_PIECE, j) + 1)))
    return alpha


def word_logs(model: Model, words: pa.Array) -> np.ndarray:
    """Log probability of every word under every language (words x languages)."""
    out = np.zeros((len(words), len(model.languages)))
    for at, codes in by_length(words):
        for lo in range(0, codes.shape[1], LONGEST):
            part = codes[:, lo:lo + LONGEST]
            alpha = forward(model.probabilities, lookups(part, model.vocabulary), part.shape[1], len(at))
            out[at] += np.log(alpha[-1]).T
    return out


def fit_pieces(words: pa.Array, counts: np.ndarray, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its word counts."""
    size = len(pieces(vocabulary)[0])
    groups = []
    expected = np.full(size, LEAST)
    for at, codes in by_length(words):
        for lo in range(0, codes.shape[1], LONGEST):
            part, weight = codes[:, lo:lo + LONGEST], counts[at].astype(float)
            found = lookups(part, vocabulary)
            groups.append((part.shape[1], weight, found))
            for (_, k), piece in found.items():  # the start: every part of a word counts by its length
                hit = piece >= 0
                expected += np.bincount(piece[hit], weight[hit] * k, size)
    for _ in range(rounds):
        p = (expected / expected.sum())[None, :]
        expected = np.full(size, LEAST)
        for length, weight, found in groups:
            alpha = forward(p, found, length, len(weight))
            beta = [None] * length + [np.ones((1, len(weight)))]
            for i in range(length - 1, -1, -1):
                after = {k: chances(p, found[i, k], k) * beta[i + k] for k in range(1, min(MAX_PIECE, length - i) + 1)}
                beta[i] = sum(after.values())
                for k, rest in after.items():
                    hit = found[i, k] >= 0
                    share = weight * (alpha[i] * rest / alpha[length])[0]
                    expected += np.bincount(found[i, k][hit], share[hit], size)
    return expected / expected.sum()


# ------------------------------------------------------------------ Spark jobs

def letters(text: Column) -> Column:
    """The words of a text: runs of letters in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "lang") -> Model:
    """Fit on labelled documents that are not held out. One row per language reaches the driver."""
    labelled = docs.filter(~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("lang"), F.col(text_col).alias("text")).filter(
        "id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    first = Window.partitionBy("lang", F.pmod(F.hash("id"), F.lit(DRAWS))).orderBy(F.xxhash64("id"), "id", "size")
    before = F.coalesce(F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = labelled.select("id", "lang", F.length("text").alias("size")).withColumn(
        "nth", F.row_number().over(first)).filter(F.col("nth") <= TRAIN_DOCS // DRAWS).withColumn(
        "before", before).filter(F.col("before") < TRAIN_CHARS).select("id", "lang").distinct()
    # the sample has at most TRAIN_DOCS rows per label, so few labels prove it small; otherwise both sides shuffle
    few = labelled.select("lang").distinct().limit(SMALL_LABELS + 1).count() <= SMALL_LABELS
    words = labelled.join(F.broadcast(sample) if few else sample, ["id", "lang"]).select(
        "lang", F.explode(letters(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))

    def train(table: pa.Table) -> pa.Table:
        words = table["word"].combine_chunks()
        order = pc.sort_indices(words)  # sums in one order, whatever order the rows came in
        words, counts = words.take(order), table["n"].combine_chunks().take(order).to_numpy()
        p = fit_pieces(words, counts, vocabulary).tobytes()
        return pa.table({"lang": [table["lang"][0].as_py()], "p": pa.array([p], pa.binary())})

    rows = words.groupBy("lang").applyInArrow(train, "lang string, p binary").collect()
    rows.sort(key=lambda r: r.lang.encode())
    return Model(vocabulary, tuple(r.lang for r in rows),
                 np.array([np.frombuffer(bytes(r.p)) for r in rows]).reshape(len(rows), len(pieces(vocabulary)[0])))


def predict_batch(model: Model, lists: pa.ListArray) -> tuple[list[str], list[float]]:
    """Language and score of every list of words."""
    count = len(lists)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words = lists.flatten()
    if not len(words) or not model.languages:
        return [UNKNOWN_LANGUAGE] * count, [0.0] * count
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    known = word_logs(model, coded.dictionary)
    size = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    total = np.concatenate([np.zeros((1, known.shape[1])), np.cumsum(known[index], axis=0)])
    log = total[ends[1:]] - total[ends[:-1]]
    total = np.concatenate([[0], np.cumsum(size[index])])
    n = total[ends[1:]] - total[ends[:-1]]
    log = log / np.maximum(1.0, n / EVIDENCE)[:, None]
    odds = np.exp(log - log.max(axis=1, keepdims=True))
    best = log.argmax(axis=1)
    score = 1.0 / odds.sum(axis=1)
    return ([model.languages[b] if k else UNKNOWN_LANGUAGE for b, k in zip(best, n)],
            [float(s) if k else 0.0 for s, k in zip(score, n)])


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) as struct `row`, with lang_pred and score."""
    carried = F.struct(*(docs.columns if carry is None else carry)).alias("row")
    rows = docs.select(carried, letters(whole_text(text_col)).alias("words"))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in cut(batches):
            lang, score = predict_batch(model, batch["words"])
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["row", "lang_pred", "score"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predictions(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = fit(docs, vocabulary)
    found = identify(docs.select("doc_id", "text").withColumn("held_out", held_out()), model, carry=[
        "doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")
