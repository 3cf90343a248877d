"""Scalar functions over columns, by code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def characters(s: Column) -> Column:
    """The code points of a text as an array."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def first_char(s: Column) -> Column:
    return F.substring(s, 1, 1)


def truncated(s: Column, most: int = 14) -> Column:
    """At most `most` characters, the last three being dots where something is left out."""
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most - 3)), F.lit("..."))).otherwise(s)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * done / total).otherwise(0.0)


def clamped(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def encoded(s: Column) -> Column:
    return F.base64(s.cast("binary"))


def decoded(s: Column) -> Column:
    return F.unbase64(s).cast("string")


def cell(s: Column) -> Column:
    """A partition cell as text(width)."""
    return F.format_string("%s(%d)", s, F.length(s))
