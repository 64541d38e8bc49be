"""Conversions of semi-structured and survey values. Missing is always SQL NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a number: no suffix letters, no underscores, no thousands separators.
NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Spellings of truth in surveys.
TRUE_WORDS = ("yes", "y", "true", "1", "1.0")
FALSE_WORDS = ("no", "n", "false", "0", "0.0")


def number(c: Column) -> Column:
    """A double, or null where the text is no plain number."""
    return F.when(c.rlike(NUMERIC), F.trim(c).try_cast("double"))


def to_int(c: Column) -> Column:
    """A long, truncated toward zero; null for null, the empty text, other text and infinities."""
    whole = F.when(c.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(c).try_cast("bigint"))  # keeps all digits
    return F.coalesce(whole, number(c).try_cast("bigint"))


def to_bool(c: Column) -> Column:
    """JSON truth of a value read as text: null stays, ``true`` and ``1`` in any case are true, other text is false."""
    return F.when(c.isNotNull(), F.lower(c).isin("true", "1"))


def to_str(c: Column) -> Column:
    return c.cast("string")


def survey_bool(c: Column) -> Column:
    """Yes and no in their spellings; anything else is null."""
    low = F.lower(c.cast("string"))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def coerced(c: Column, kind: T.DataType) -> Column:
    """The conversion that a schema's type asks for, from text."""
    if isinstance(kind, T.BooleanType):
        return to_bool(c)
    if isinstance(kind, T.IntegralType):
        return to_int(c).cast(kind)
    return to_str(c)


def timestamp_or_null(c: Column, pattern: str | None = None) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)) if pattern else F.try_to_timestamp(c)


def strict_int(c: Column, name: str) -> Column:
    """An int, or an error: null is no age."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"{name} is null")).cast("int")).otherwise(c.cast("int"))


def row_sum(*cs: Column) -> Column:
    """Sum over a row's columns in which null counts as 0."""
    total = F.lit(0.0)
    for c in cs:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return total
