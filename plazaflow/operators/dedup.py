"""Removal of duplicates. What comes first is said by columns, never left to chance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.operators.clean import q


def exact(df: DataFrame) -> DataFrame:
    """Equal rows once."""
    return df.dropDuplicates()


def by_key_nonnull(df: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """The first row of each key; rows without a key all stay, and do not meet in one task."""
    return by_key(df.filter(q(key).isNotNull()), key, order).unionByName(df.filter(q(key).isNull()))


def by_key(df: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """The first row of each key, of which null is one. Partial aggregation keeps a hot key from one task."""
    first = F.min(F.struct(*[q(c) for c in order], F.struct(*[q(c) for c in df.columns]).alias("_row"))).alias("_min")
    return df.groupBy(q(key).alias("_key")).agg(first).select("_min._row.*")


def content_hash(df: DataFrame, columns: Iterable[str] | None = None, length_prefix: bool = False) -> Column:
    """md5 of the row's values as text, missing as ``nan``, joined by ``|``.

    Values that hold ``|`` can collide; with ``length_prefix`` each value carries its length and cannot.
    """
    parts = [F.coalesce(q(c).cast("string"), F.lit("nan")) for c in (columns or df.columns)]
    if length_prefix:
        parts = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.md5(F.concat_ws("|", *parts))


def by_content(df: DataFrame, order: Iterable[str], columns: Iterable[str] | None = None) -> DataFrame:
    return by_key(df.withColumn("_hash", content_hash(df, columns)), "_hash", order).drop("_hash")


def last_per_key(df: DataFrame, keys: Iterable[str], order: Column | str) -> DataFrame:
    """The last row of each key by ``order``."""
    newest = F.max_by(F.struct(*[q(c) for c in df.columns]), order).alias("_row")
    return df.groupBy(*[q(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(newest).select("_row.*")
