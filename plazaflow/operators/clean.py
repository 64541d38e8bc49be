"""Cleaning rules over survey tables. Each is DataFrame to DataFrame; those that need figures of the
data first gather the figures of all their columns in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazaflow.functions.coerce import number, row_sum
from plazaflow.functions.text import name_list, null_tokens, slug, snake_case, unique_names

# Names of service columns, and limits of the rules.
SERVICE_NAME, SERVICE_PREFIX = r"d\d+", "unnamed"
IQR_FACTOR, MOST_MISSING, MOST_LOST = 3.0, 0.5, 0.2

#: Names of a list column that become columns at most.
MOST_NAMES = 1_000


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def named(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Columns renamed by position where ``names`` are as many, to snake case otherwise."""
    names = list(names or [])
    return df.toDF(*(names if len(names) == len(df.columns) else unique_names(map(snake_case, df.columns))))


def drop_service_columns(df: DataFrame) -> DataFrame:
    """Without columns named ``d`` and digits, or ``unnamed...``."""
    return df.drop(*[c for c in df.columns if c.startswith(SERVICE_PREFIX) or re.fullmatch(SERVICE_NAME, c)])


def strip_strings(df: DataFrame) -> DataFrame:
    return df.select(*[null_tokens(q(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else q(f.name) for f in df.schema])


def guarded_numeric(df: DataFrame, columns: Iterable[str], most_lost: float = MOST_LOST) -> DataFrame:
    """Columns as doubles, except those that would lose more than a share of their values."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    counts = df.agg(*[x for c in cols for x in (F.count(q(c)), F.count_if(q(c).isNotNull() & number(q(c).cast("string")).isNull()))]).first()
    good = [c for i, c in enumerate(cols) if not counts[2 * i] or counts[2 * i + 1] / counts[2 * i] <= most_lost]
    return df.withColumns({c: number(q(c).cast("string")) for c in good})


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def range_rules(df: DataFrame, rules: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Numbers outside their inclusive range become null."""
    return df.withColumns({c: F.when(q(c).between(lo, hi), q(c)) for c, (lo, hi) in rules.items() if c in df.columns and is_numeric(df, c)})


def iqr_cap(df: DataFrame, columns: Iterable[str], factor: float = IQR_FACTOR) -> DataFrame:
    """Numbers drawn to within ``factor`` interquartile ranges of the quartiles; a column without spread stays."""
    cols = [c for c in columns if c in df.columns and is_numeric(df, c)]
    if not cols:
        return df
    quartiles = df.agg(*[F.percentile(q(c).cast("double"), [0.25, 0.75]).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for c, pair in zip(cols, quartiles, strict=True):
        if pair and pair[1] != pair[0]:
            lo, hi = pair[0] - factor * (pair[1] - pair[0]), pair[1] + factor * (pair[1] - pair[0])
            out[c] = F.when(q(c).isNotNull(), F.least(F.greatest(q(c).cast("double"), F.lit(lo)), F.lit(hi)))
    return df.withColumns(out) if out else df


def drop_sparse(df: DataFrame, most_missing: float = MOST_MISSING, protect: Iterable[str] = ()) -> DataFrame:
    """Without columns of which strictly more than a share is missing."""
    cols = [c for c in df.columns if c not in set(protect)]
    if not cols:
        return df
    shares = df.agg(*[F.avg(q(c).isNull().cast("double")) for c in cols]).first()
    return df.drop(*[c for c, x in zip(cols, shares, strict=True) if x is not None and x > most_missing])


def impute(df: DataFrame, protect: Iterable[str] = (), unknown: Iterable[str] = (), most_missing: float = MOST_MISSING) -> DataFrame:
    """Sparse columns dropped; then missing values filled: ``Unknown`` in the columns named, the median of
    numbers, the most frequent value (the smallest on ties) of others."""
    df = drop_sparse(df, most_missing, protect)
    cols = [f for f in df.schema if f.name not in set(protect)]
    figures = [f for f in cols if f.name not in set(unknown)]
    made = df.agg(*[(F.median(q(f.name)) if isinstance(f.dataType, T.NumericType) else F.mode(q(f.name), True)).alias(f"s{i}") for i, f in enumerate(figures)]).first() if figures else ()
    fill = {f.name: F.lit(v) for f, v in zip(figures, made, strict=True)}
    out = {}
    for f in cols:
        value = fill.get(f.name)
        if f.name in set(unknown) or (f.name in fill and made[figures.index(f)] is None and isinstance(f.dataType, T.StringType)):
            value = F.lit("Unknown")
        out[f.name] = F.coalesce(q(f.name), value.cast("double" if isinstance(f.dataType, T.NumericType) else f.dataType))
    return df.withColumns(out) if out else df


def null_together(df: DataFrame, when: Column, columns: Iterable[str]) -> DataFrame:
    """The columns null where the rule is broken; the rule is judged before any of them changes."""
    cols = list(columns)
    marked = df.withColumn("_broken", F.coalesce(when, F.lit(False)))
    return marked.withColumns({c: F.when(~F.col("_broken"), q(c)) for c in cols}).drop("_broken")


def drop_where_sum_exceeds(df: DataFrame, columns: Iterable[str], most: float) -> DataFrame:
    return df.filter(row_sum(*[q(c) for c in columns if c in df.columns]) <= most)


def drop_all_null(df: DataFrame, besides: Iterable[str] = ()) -> DataFrame:
    """Without rows in which every column, those named aside, is null."""
    return df.dropna(how="all", subset=[c for c in df.columns if c not in set(besides)])


def one_hot(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """A column 0 or 1 for each name found in a comma-separated list column; names with one slug share a column. More than ``MOST_NAMES`` names are an error."""
    listed = df.withColumn("_names", name_list(q(column)))
    names = sorted(r[0] for r in listed.select(F.explode("_names")).distinct().limit(MOST_NAMES + 1).collect())  # columns have to be known to plan
    if len(names) > MOST_NAMES:
        raise ValueError(f"{column} has more than {MOST_NAMES} names")
    by_slug: dict[str, list[str]] = {}
    for n in names:
        by_slug.setdefault(prefix + slug(n), []).append(n)
    return listed.withColumns({c: F.arrays_overlap(F.col("_names"), F.array(*map(F.lit, ns))).cast("int") for c, ns in by_slug.items()}).drop("_names")


def violations(df: DataFrame, rules: Mapping[str, Column], dataset: str) -> DataFrame:
    """(dataset, rule, count) of the rows that break each rule, counted in one pass."""
    one = df.agg(*[F.count_if(r).alias(n) for n, r in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), q(n).alias("count")) for n in rules])
    return one.select(F.lit(dataset).alias("dataset"), F.inline(pairs))
