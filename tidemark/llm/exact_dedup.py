"""Exact deduplication with a two-pass Bloom filter.

Texts are equal when they are identical after lower-casing A-Z only; a null text counts as empty. The first pass sets a
few bits per text in a filter of fixed size and keeps only the bits that were set at least twice. The second pass looks
every row up: a row with a bit that was set once is certainly unique and passes straight through, without a shuffle; the
others, all repeated rows and a few false positives, meet by their digest and are decided exactly.

The filter is at most `FILTER_WORDS` 64-bit words whatever the input, so it may be broadcast. When the input outgrows it,
more rows count as possibly repeated and shuffle; the result stays the same.

Cases: of equal texts the largest id stays, and a null id is smaller than any other. Rows that repeat both the text and
the largest id leave exactly one row. An empty table gives an empty result. Extra columns are carried, whatever their
names (names that begin with `_xd_` are reserved).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import once, stored, whole_text

#: Size of the filter: 2^20 words of 64 bits, 8 MB of bits and 16 MB as rows at most.
FILTER_WORDS = 1 << 20

#: The rows of one group of equal texts are spread over so many keys when they meet their group's record.
SALTS = 32


def normalised(text: str = "text") -> Column:
    """The text with A-Z lower-cased and nothing else changed."""
    return F.translate(whole_text(text), string.ascii_uppercase, string.ascii_lowercase)


def _word_and_mask(digest: Column) -> tuple[Column, Column]:
    h = F.xxhash64(digest)
    bits = [F.shiftright(h, at).bitwiseAND(F.lit(63)).cast("int") for at in (40, 46, 52)]
    mask = F.lit(0).cast("bigint")
    for bit in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return h.bitwiseAND(F.lit(FILTER_WORDS - 1)), mask


def with_filter_place(df: DataFrame, digest: str = "_xd_digest") -> DataFrame:
    """Add the filter word of a digest and its bits in that word."""
    word, mask = _word_and_mask(F.col(digest))
    return once(df, _xd_word=word, _xd_mask=mask)


def repeated_bits(placed: DataFrame) -> DataFrame:
    """First pass: the bits that at least two rows set, one row per filter word that has any."""
    bits = F.sequence(F.lit(0), F.lit(63))
    is_set = lambda b: F.call_function("shiftright", F.col("_xd_mask"), b).bitwiseAND(F.lit(1)) == 1
    slots = placed.select("_xd_word", F.explode(F.filter(bits, is_set)).alias("bit"))
    twice = slots.groupBy("_xd_word", "bit").agg(F.count("*").alias("n")).filter("n >= 2")
    return twice.groupBy("_xd_word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("_xd_seen"))


def possibly_repeated(placed: DataFrame, bits: DataFrame) -> DataFrame:
    """Second pass: flag the rows all of whose bits were set at least twice. `bits` has at most FILTER_WORDS rows."""
    seen = F.coalesce(F.col("_xd_seen"), F.lit(0).cast("bigint")).bitwiseAND(F.col("_xd_mask"))
    return placed.join(F.broadcast(bits), "_xd_word", "left").withColumn("_xd_maybe", seen == F.col("_xd_mask"))


def _salted(groups: DataFrame) -> DataFrame:
    return groups.withColumn("_xd_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, dropped ones too: id, keep_id, group_size, kept, text_sha256 (hex of the normalised text).

    Only (id, digest) is written and shuffled, never a text.
    """
    prints = stored(docs.select(
        F.col(id_col).alias("_xd_id"), F.monotonically_increasing_id().alias("_xd_row"),
        F.unhex(F.sha2(normalised(text_col), 256)).alias("_xd_digest")), "fingerprints")
    placed = with_filter_place(prints)
    flagged = possibly_repeated(placed, repeated_bits(placed))
    sha = F.lower(F.hex("_xd_digest")).alias("text_sha256")
    single = flagged.filter(~F.col("_xd_maybe")).select(
        F.col("_xd_id").alias(id_col), F.col("_xd_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), sha)
    maybe = flagged.filter("_xd_maybe").select("_xd_id", "_xd_row", "_xd_digest")
    groups = maybe.groupBy("_xd_digest").agg(
        F.count("*").alias("_xd_size"), F.max(F.struct("_xd_id", "_xd_row")).alias("_xd_keep"))
    met = maybe.withColumn("_xd_salt", F.pmod(F.xxhash64("_xd_row"), F.lit(SALTS)).cast("int")).join(
        _salted(groups), ["_xd_digest", "_xd_salt"])
    return single.unionByName(met.select(
        F.col("_xd_id").alias(id_col), F.col("_xd_keep._xd_id").alias("keep_id"), F.col("_xd_size").alias("group_size"),
        (F.col("_xd_keep._xd_row") == F.col("_xd_row")).alias("kept"), sha))


def drop_equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Rows that the filter proves unique are not shuffled."""
    digested = docs.withColumn("_xd_digest", F.unhex(F.sha2(normalised(text_col), 256)))
    placed = with_filter_place(digested)
    bits = stored(repeated_bits(placed.select("_xd_word", "_xd_mask")), "repeated-bits")
    flagged = possibly_repeated(placed, bits)
    single = flagged.filter(~F.col("_xd_maybe")).select(*docs.columns)
    maybe = flagged.filter("_xd_maybe").drop("_xd_word", "_xd_mask", "_xd_seen", "_xd_maybe")
    groups = maybe.groupBy("_xd_digest").agg(F.max(id_col).alias("_xd_keep"))
    kept = maybe.withColumn("_xd_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(
        _salted(groups), ["_xd_digest", "_xd_salt"]).filter(F.col(id_col).eqNullSafe(F.col("_xd_keep")))
    return single.unionByName(kept.dropDuplicates(["_xd_digest"]).select(*docs.columns))
