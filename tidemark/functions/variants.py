"""Fields of a parsed JSON document (variant) by their JSON types: a message is parsed once and asked often."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What `schema_of_variant` calls numbers.
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def field(node: Column, path: str) -> Column:
    """A field below an object: null where there is none, a value of its own where it is JSON null."""
    return F.try_variant_get(node, f"$.{path}", "variant")


def kind(node: Column) -> Column:
    """The JSON type of a leaf; `VOID` is JSON null."""
    return F.schema_of_variant(node)


def leaf(node: Column, path: str) -> Column:
    """JSON type and text of a field, so that later expressions need not look into the document again."""
    return F.struct(kind(field(node, path)).alias("kind"), F.try_variant_get(node, f"$.{path}", "string").alias("text"))


def is_there(found: Column) -> Column:
    """Whether a leaf is a field of its object; JSON null is one."""
    return found["kind"].isNotNull()


def is_number(found: Column) -> Column:
    return F.coalesce(F.substring_index(found["kind"], "(", 1).isin(*_NUMBERS), F.lit(False))


def is_string(found: Column) -> Column:
    return F.coalesce(found["kind"] == "STRING", F.lit(False))


def cast_to(node: Column, schema: str, path: str = "") -> Column:
    """The node, or a field below it, as a typed value in one pass: null for another shape, at any depth for itself only.

    A leaf of type `variant` keeps its JSON type; a field that is not there is null.
    """
    return F.try_variant_get(node, f"$.{path}" if path else "$", schema)


def whole(node: Column, path: str, number: str, found: Column | None = None) -> Column:
    """A JSON number as `int` or `bigint` without its fraction; null for anything else and beyond the range.

    Without a path it is the node itself. `found` is the number as a cast gave it, if there was one.
    """
    named = F.substring_index(kind(field(node, path) if path else node), "(", 1).isin(*_NUMBERS)
    return F.when(named, cast_to(node, number, path) if found is None else found)


def text(node: Column, path: str = "", found: Column | None = None) -> Column:
    """A field, or the node itself, as text: null for JSON null, empty for objects and arrays.

    Its JSON type, which costs more than the text, is only asked for a text that may be an object or an array. `found` is
    the text as a cast gave it, if there was one.
    """
    found = cast_to(node, "string", path) if found is None else found
    named = kind(field(node, path) if path else node)
    nested = named.startswith("OBJECT") | named.startswith("ARRAY")
    return F.when(F.coalesce(F.substring(found, 1, 1), F.lit("")).isin("{", "["),
                  F.when(nested, F.lit("")).otherwise(found)).otherwise(found)


def items(node: Column, path: str = "") -> Column:
    """The elements of an array, the node itself or below an object, null for anything else."""
    return F.try_variant_get(node, f"$.{path}" if path else "$", "array<variant>")


def fields(node: Column) -> Column:
    """The fields of an object by name, null for anything else."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def text_of(node: Column) -> Column:
    """The text of a leaf."""
    return F.try_variant_get(node, "$", "string")


def once(df, **columns: Column):
    """Add computed columns behind a one-row generator, so that each is computed once however often it is read."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
