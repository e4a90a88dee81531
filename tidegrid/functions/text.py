"""Normalisation of symbols, identifiers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def trimmed(c: Column) -> Column:
    """Without surrounding blanks and tabs."""
    return F.btrim(c, F.lit(BLANKS))


def symbol_key(c: Column) -> Column:
    """Trimmed and in upper case; blank becomes null."""
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def id_key(c: Column) -> Column:
    """Trimmed and in lower case; blank becomes null."""
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def is_blank(c: Column) -> Column:
    """True for a non-null string that is empty when trimmed; false else, also for null."""
    return F.coalesce(trimmed(c) == "", F.lit(False))


def is_number(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def signal_name(c: Column) -> Column:
    """Name of an external signal: trimmed, blanks and dashes as underscores, upper case."""
    return F.upper(F.translate(F.trim(c), " -", "__"))


def strict_json_object(text: Column, kind: str) -> Column:
    """``json_object``, but null also for an object that repeats a key."""
    keys = F.json_object_keys(text)
    return F.when(F.size(keys) == F.size(F.array_distinct(keys)), json_object(text, kind))


def json_object(text: Column, kind: str) -> Column:
    """A JSON object as ``map<string,kind>``; null for null text and for text that is not wholly one object.

    Of a repeated key the last value counts.
    """
    keys = F.json_object_keys(text)
    repeated = F.size(keys) > F.size(F.array_distinct(keys))
    # the readers of objects stop at the closing brace; as the only element of an array the text is read to its end
    whole = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    read = F.from_json(text, f"map<string,{kind}>")  # keeps repeated keys
    entries = F.map_entries(read)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.when(keys.isNotNull() & whole, F.when(repeated, F.map_from_entries(last)).otherwise(read))
