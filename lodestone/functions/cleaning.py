"""Column functions that settle what counts as missing, and text as truth or number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """The number, or null for NaN and the infinities."""
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def filled(text: Column) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def truth(text: Column) -> Column:
    """True, false or null (for any other word) of yes/no words in any case."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def trailing_id(name: Column, prefix: str) -> Column:
    """The number after ``prefix`` at the end of a name, as a long; null if there is none."""
    return F.nullif(F.regexp_extract(name, f"{prefix}([0-9]+)$", 1), F.lit("")).cast("long")
