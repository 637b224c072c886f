"""Token counts of whole texts: batch encoding in an Arrow function that returns lengths only.

The vocabulary is byte-level BPE given as ranks, the same ids that the library for the JSON form produces (tests compare
the two). The special string `<|endoftext|>` inside a text is one token, as that library has it by default. Arrow cuts
the batches by bytes, and texts above `LONG` characters are split before a single space between two characters that are
no white space: no piece of the split pattern spans such a place, so the counts add up exactly.

Cases: a null or empty text has 0 bytes and 0 tokens; a null id is carried; repeated rows give repeated rows; an empty
table gives an empty result. Only the id and the text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Token count above which a document does not fit a training window.
TOKEN_LIMIT = 1024

#: Characters after which a text is split, and the special string of the vocabulary.
LONG, SPECIAL = 50_000, "<|endoftext|>"

_SAFE = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    """The encoder of a rank file, made once per worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, long: int = LONG) -> list[str]:
    """Split a text into parts of about `long` characters whose encodings, joined, are the text's encoding."""
    parts, start = [], 0
    while len(text) - start > long:
        cut = _SAFE.search(text, start + long)
        if cut is None:
            break
        parts.append(text[start:cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def count_tokens(encoder, text: str) -> int:
    """Tokens of one text, special strings counted as one token each."""
    segments = text.split(SPECIAL)
    return len(segments) - 1 + sum(
        len(encoder.encode_ordinary(part)) for segment in segments for part in safe_parts(segment) if part)


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens, over_limit."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks_path, pattern)
        for batch in batches:
            counts = [count_tokens(encoder, text) if text else 0 for text in (t.as_py() for t in batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(counts, pa.int64())], ["id", "n_tokens"])

    # the byte length stays on the JVM's side of a second, cheap column
    sized = source.withColumn("id", F.struct("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
                                             .alias("n_bytes")))
    counted = sized.mapInArrow(count, f"id struct<id:{kind},n_bytes:bigint>, n_tokens bigint")
    return counted.select(F.col("id.id").alias(id_col), F.col("id.n_bytes").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
