"""Append-only ledgers: the latest record of each task, work lists, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.operators.dedup import last_per_key
from plazaflow.schemas import FINAL_PROBLEMS

MISSING_PATH = "FileNotFoundError|cannot find the path|No such file or directory"


def source_missing(status: Column, error: Column) -> Column:
    """Whether a record says only that the source was out of reach, and so is no result."""
    return (status == "source_missing") | ((status == "error") & F.coalesce(error, F.lit("")).rlike(MISSING_PATH))


def latest(ledger: DataFrame, key: str = "file", order: str = "line_no") -> DataFrame:
    """The last result of each key; records of a missing source are passed over before that."""
    real = ledger.filter(~F.coalesce(source_missing(F.col("status"), F.col("error")), F.lit(False)))
    return last_per_key(real, [key], order)


def expected_files(months: DataFrame) -> DataFrame:
    """file, kind, month: the two dumps of each month, submissions first."""
    kinds = F.explode(F.array(F.struct(F.lit("RS").alias("prefix"), F.lit("submissions").alias("kind")), F.struct(F.lit("RC").alias("prefix"), F.lit("comments").alias("kind"))))
    rows = months.select("month", kinds.alias("k"))
    return rows.select(F.concat("k.prefix", F.lit("_"), "month", F.lit(".zst")).alias("file"), F.col("k.kind").alias("kind"), "month")


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.join(present.select("file"), "file", "left_anti")


def work_list(jobs: DataFrame, latest_records: DataFrame, redo: bool = False, key: str = "file") -> DataFrame:
    """Jobs that are neither done nor known to be past repair; with ``redo`` the latter too."""
    done = ["ok"] if redo else ["ok", *FINAL_PROBLEMS]
    return jobs.join(latest_records.filter(F.col("status").isin(done)).select(key), key, "left_anti")


def problem_report(latest_records: DataFrame, missing: DataFrame) -> DataFrame:
    """file, kind, month, status, rows_saved, reason, finished_at of every month that is not complete. A failed file saved no rows."""
    bad = latest_records.filter(F.col("status").isin(*FINAL_PROBLEMS)).select(
        "file", "kind", F.substring("file", 4, 7).alias("month"), "status",
        F.when(F.col("status") == "error", F.lit(0)).otherwise(F.coalesce("rows_total", F.lit(0))).cast("bigint").alias("rows_saved"),
        F.replace(F.coalesce("error", F.lit("")), F.lit("\n"), F.lit(" ")).alias("reason"), "finished_at",
    )
    gone = missing.select("file", "kind", "month", F.lit("missing_on_drive").alias("status"), F.lit(0).cast("bigint").alias("rows_saved"), F.lit("no dump of this month was found").alias("reason"), F.lit("").alias("finished_at"))
    return bad.unionByName(gone)


def status_summary(latest_records: DataFrame) -> DataFrame:
    """status, files and their sorted names. Names are gathered for problems only; there are few of them."""
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") != "ok", F.col("file")))), ",")
    return latest_records.groupBy("status").agg(F.count("*").alias("files"), names.alias("names"))


def rows_by_source(latest_records: DataFrame) -> DataFrame:
    """kind, subreddit, rows from the map of rows of each file."""
    return latest_records.select("kind", F.explode("rows").alias("subreddit", "n")).groupBy("kind", "subreddit").agg(F.sum("n").alias("rows"))


def log_summary(log: DataFrame) -> DataFrame:
    """mode, status, tasks, and rows of the tasks that are ok."""
    return log.groupBy("mode", "status").agg(F.count("*").alias("tasks"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("rows"))), F.lit(0)).alias("rows"))


def task_problems(log: DataFrame, order: str = "finished_at") -> DataFrame:
    """task, mode, subreddit, month, status, error, finished_at of every task whose last record is not ok, by task."""
    last = last_per_key(log, ["task"], order).filter(F.coalesce(F.col("status") != "ok", F.lit(True)))
    return last.select("task", "mode", "subreddit", "month", "status", F.coalesce("error", F.lit("")).alias("error"), "finished_at").orderBy("task")


def task_grid(months: DataFrame, sources: DataFrame, mode: str) -> DataFrame:
    """task, mode, subreddit, month for every month and source. Months are as many as a calendar has and are what is broadcast; sources may be any number."""
    grid = sources.select("subreddit").join(F.broadcast(months.select("month")))
    return grid.select(F.concat_ws("|", F.lit(mode), "subreddit", "month").alias("task"), F.lit(mode).alias("mode"), "subreddit", "month")


def incomplete(grid: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, subreddit) of which some month of the grid has no count."""
    return grid.join(counts.filter("n is not null"), ["kind", "subreddit", "month"], "left_anti").select("kind", "subreddit").distinct()
