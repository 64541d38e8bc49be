"""Monthly counts and where they come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.functions.months import month_of


def in_range(records: DataFrame, start: int, end: int, ts: str = "created_utc") -> DataFrame:
    """Records of the half-open range; those without a time are not in it."""
    return records.filter((F.col(ts) >= start) & (F.col(ts) < end))


def unique_range(records: DataFrame, start: int, end: int, ts: str = "created_utc") -> DataFrame:
    """As pages of a server give it: each id once."""
    return in_range(records, start, end, ts).dropDuplicates(["id"])


def exact_counts(records: DataFrame, kind: str, ts: str = "created_utc") -> DataFrame:
    """kind, subreddit, month, n, source."""
    counted = records.groupBy("subreddit", month_of(F.col(ts)).alias("month")).agg(F.count("*").alias("n"))
    return counted.select(F.lit(kind).alias("kind"), "subreddit", "month", "n", F.lit("exact_count").alias("source"))


def estimated_counts(rates: DataFrame) -> DataFrame:
    """subreddit, month, n from (subreddit, month, rows, seconds, span): the mean rate of the pages seen, times the month's seconds, truncated."""
    rate = F.avg(F.col("rows") / F.greatest(F.col("seconds"), F.lit(1)))
    return rates.groupBy("subreddit", "month").agg((rate * F.max("span")).cast("bigint").alias("n"))


def best_counts(grid: DataFrame, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """The grid with n and source of the first source, in the order given, that has a count of the month."""
    out = grid
    for i, (_, s) in enumerate(sources):
        out = out.join(s.select("subreddit", "month", F.col("n").alias(f"_n{i}")), ["subreddit", "month"], "left")
    names = [F.when(F.col(f"_n{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(sources)]
    ns = [F.col(f"_n{i}") for i in range(len(sources))]
    return out.select(*grid.columns, F.coalesce(*ns).alias("n"), F.coalesce(*names).alias("source"))


def totals(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Counts of comments and of posts of each source and month side by side."""
    a = comments.select("subreddit", "month", F.col("n").alias("comments_total"), F.col("source").alias("comments_source"))
    b = posts.select("subreddit", "month", F.col("n").alias("posts_total"), F.col("source").alias("posts_source"))
    return a.join(b, ["subreddit", "month"], "full_outer")


def from_statistics(points: DataFrame) -> DataFrame:
    """subreddit, month, n from a server's (subreddit, time, value): times in s or ms, moved two days on before they are cut to months."""
    seconds = F.when(F.abs("time") > 100_000_000_000, F.floor(F.col("time") / 1000)).otherwise(F.col("time"))
    return points.groupBy("subreddit", month_of(seconds + 2 * 86_400).alias("month")).agg(F.sum("value").cast("bigint").alias("n"))
