"""Profiles: frequencies, inventories, pivots, samples of groups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plazaflow.operators.clean import q


def value_counts(df: DataFrame, column: str, nulls: bool = True) -> DataFrame:
    """(value, count), most frequent first."""
    rows = df if nulls else df.filter(q(column).isNotNull())
    return rows.groupBy(q(column).alias("value")).count().orderBy(F.desc("count"), "value")


def freq_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count, percent) of several columns, in one pass; percent to one place, half to even."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).groupBy("p.column", "p.value").count()
    total = counts.groupBy("column").agg(F.sum("count").alias("n"))
    return counts.join(total, "column").select("column", "value", "count", F.bround(100 * F.col("count") / F.col("n"), 1).alias("percent"))


def with_total(groups: DataFrame, key: str, label: str = "TOTAL") -> DataFrame:
    """The groups and a row of the sums of their numbers."""
    sums = [F.sum(q(f.name)).cast(f.dataType).alias(f.name) if f.name != key else F.lit(label).alias(key) for f in groups.schema]
    return groups.unionByName(groups.agg(*sums))


def inventory(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and MB of each file that ``df`` was read from; the count reads footers only, as no column is needed."""
    files = df.groupBy(*by, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"))
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), (F.sum("size") / 1e6).alias("size_mb"))


def pivot_counts(df: DataFrame, index: str, column: str, values: Sequence[str], total: Column | None = None) -> DataFrame:
    """One row per index value, one column per given value of ``column``, sums with 0 for none."""
    return df.groupBy(index).pivot(column, list(values)).agg(total if total is not None else F.count(F.lit(1))).na.fill(0)


def profile_nulls(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, nulls) of every column, counted in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(q(c).isNull()).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col("_n").alias("rows"), F.col(f"_c{i}").alias("nulls")) for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.inline(F.array(*rows)))


def hash_order(seed: str, *columns: Column) -> Column:
    """A pseudo-random order that any engine can rebuild."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns]), 256)


def shuffled_top(df: DataFrame, group: str, key: str, n: int = 2, seed: str = "8") -> DataFrame:
    """``n`` rows of each group by hash order. Spark keeps ``n`` rows a task before it shuffles, so a hot group costs nothing."""
    w = Window.partitionBy(q(group)).orderBy(F.col("_h"), q(key))
    return df.withColumn("_h", hash_order(seed, q(key))).withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n).drop("_h")


def union_by_name(tables: Iterable[DataFrame]) -> DataFrame:
    """All rows by column name; a column that a table lacks is null, one whose types differ becomes text."""
    tables = list(tables)
    kinds: dict[str, set[str]] = {}
    for t in tables:
        for name, kind in t.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = {n for n, k in kinds.items() if len(k) > 1}
    same = [t.withColumns({c: q(c).cast("string") for c in t.columns if c in mixed}) if mixed & set(t.columns) else t for t in tables]
    out = same[0]
    for t in same[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
