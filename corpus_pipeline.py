"""A corpus from raw documents to tokens, in five stages over the operators of `tidemark.llm`.

Every stage gets the table that the one before it wrote and returns a frame with the columns of `documents`; the last one
returns token counts and digests. A stage works on all the rows it gets, and what it drops is gone for the next ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, jaccard, langid, mixing
from tidemark.llm.common import stored
from tidemark.session import configure

#: Posterior below which the language of a document counts as unknown.
LEAST_SCORE = 0.5

#: Words of a block and cached distinct words of the token stage, which bound the memory of its workers.
TOKEN_BLOCK, TOKEN_CACHE = 1 << 18, 200_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without letters and unclear ones go.

    Null and empty texts have no letters and go; a document without a label is judged like any other; if no label was
    learned at all, every document with a letter stays. Repeated rows and ids are judged row by row, whole texts count
    whatever their length, an empty table stays empty, and further columns are carried.
    """
    configure(spark)
    model = langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    if not model.languages:
        return docs.filter(langid.has_letter(F.col("text")))
    found = langid.identify(docs, model)
    return found.filter((found.lang_pred != langid.UNKNOWN_LANGUAGE) & (found.score >= LEAST_SCORE)).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id, null being smaller than any other.

    Null texts equal empty ones; rows that repeat text and id leave one row; an empty table stays empty; whole texts of
    any length count, and further columns are carried.
    """
    configure(spark)
    return exact_dedup.drop_equal_texts(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: the least id, null being larger than any other.

    Texts without words stay; a row that shares its id with a copy is judged by its own words; rows that repeat id and
    words leave one row; an empty table stays empty; whole texts of any length count, and further columns are carried.
    """
    configure(spark)
    return jaccard.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them.

    A null source is a source; documents without words are not taken; rows that repeat an id are documents of their own;
    a document is whole or absent whatever its length; an empty table stays empty, and further columns are carried.
    """
    configure(spark)
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text.

    A null text is empty, a null id is carried, repeated rows give repeated rows, an empty table an empty result, and
    whole texts of any length are encoded. After the mix equal documents are neighbours, so blocks are smaller here.
    """
    configure(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), block=TOKEN_BLOCK, cached=TOKEN_CACHE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("mixing", source_mix),
    ("bpe", tokens),
]

#: SQL has neither the language model nor the tokenizer; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every result but the last is written and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
