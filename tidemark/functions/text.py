"""Small text functions: keys, blanks, truncation, row JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truncate(text: Column, size: int) -> Column:
    """At most `size` characters, the cut marked by `...`."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def bar_key(*parts: Column) -> Column:
    """Key parts joined by a bar; a null part reads `null`, so both sides of a key match agree."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def is_blank(text: Column) -> Column:
    """Null, empty or only white space."""
    return text.isNull() | ~text.rlike(r"\S")


def first_non_blank(text: Column, default: Column) -> Column:
    """The trimmed text, or the default when it is blank."""
    return F.when(is_blank(text), default).otherwise(F.trim(text))


def row_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The row as JSON with sorted keys and nulls kept."""
    names = sorted(columns or df.columns)
    return F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"})


def idempotency_key(header: Column, source_system: Column, external_ref: Column) -> Column:
    """The trimmed request header, else SHA-256 over source system and reference."""
    empty = F.lit("")
    derived = F.sha2(F.concat(F.coalesce(source_system, empty), F.coalesce(external_ref, empty)), 256)
    return first_non_blank(header, derived)
