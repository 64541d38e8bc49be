"""From dumps or records to extracted months and samples, with their ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaflow.functions.months import month_grid
from plazaflow.operators import ledger, sampling
from plazaflow.operators.counts import best_counts, exact_counts
from plazaflow.schemas import BATCH_TARGET, MANIFEST, SLOT_TARGET
from plazaflow.session import written
from plazaflow.sources import dumps, tables

MANIFEST_DIR, PROBLEMS_DIR = "_manifest", "_problem_months"


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The latest record of each file; none before the first run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{MANIFEST_DIR}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return ledger.latest(tables.read_ledger(spark, f"{out}/{MANIFEST_DIR}")).drop("line_no")


def extract_dumps(
    spark: SparkSession, src: str, out: str, wanted: list[str], start: str, end: str, kind: str = "both", redo: bool = False, limit_bytes: int = 0,
    mirrors: tuple[str, ...] = (), only: tuple[str, ...] = (), skip: tuple[str, ...] = (),
) -> DataFrame:
    """Extract the months' dumps under ``src`` that are not done, append to the ledger and return the problem report.

    only: months (YYYY-MM) to which the calendar is narrowed; skip: names of files that are left alone. A trial with
    ``limit_bytes`` takes files up again whatever the ledger says. All files of a kind are one job, a task a file, and each
    is read once: records, mirrors and verdicts are all made of what that reading wrote. A file that cannot be read gets its
    verdict and does not stop the others.
    """
    months = month_grid(spark, start, end)
    expected = ledger.expected_files(months.filter(F.col("month").isin(*only)) if only else months)
    if kind != "both":
        expected = expected.filter(F.col("kind") == kind)
    jobs = dumps.collect_jobs(expected, dumps.list_dumps(spark, src))
    present, missing = jobs.filter("path is not null"), jobs.filter("path is null").select("file", "kind", "month")
    todo = present if limit_bytes else ledger.work_list(present, manifest(spark, out), redo)
    if skip:
        todo = todo.filter(~F.col("file").isin(*skip))
    paths: dict[str, list[str]] = {}
    for r in todo.select("kind", "path").collect():  # a row a file: the calendar bounds it
        paths.setdefault(r["kind"], []).append(r["path"])
    for k, found in sorted(paths.items(), reverse=True):
        stage = written(dumps.staged(dumps.read_dumps(spark, sorted(found), limit_bytes), k, wanted), "dump-lines")
        records = dumps.records(stage).withColumn("month", dumps.name_parts(F.col("file"))["month"]).drop("file")
        for root in (out, *mirrors):
            tables.write_records(records, f"{root}/{k}")
        done = dumps.judge(stage, bool(limit_bytes)).withColumn("finished_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
        tables.append_ledger(done, f"{out}/{MANIFEST_DIR}")
    report = ledger.problem_report(manifest(spark, out), missing).orderBy("kind", "month")
    tables.write_report(report, f"{out}/{PROBLEMS_DIR}")
    return report


def plan_samples(records: DataFrame, kind: str, seed: str, known: DataFrame | None = None, ts: str = "created_utc") -> DataFrame:
    """The sampling plan of all months of ``records``: counts from ``known`` where it has them, else exact ones."""
    exact = exact_counts(records, kind, ts)
    counts = exact if known is None else best_counts(exact.select("subreddit", "month"), [("totals", known), ("exact_count", exact)])
    # written, so that the counts are made once and Spark knows that the plan is small
    return written(sampling.plan_months(counts, SLOT_TARGET[kind], BATCH_TARGET[kind], seed if kind == "comments" else f"{seed}-posts"), "sample-plan")


def take_batch(records: DataFrame, plan: DataFrame, taken: DataFrame, batch: int, ts: str = "created_utc") -> tuple[DataFrame, DataFrame]:
    """(rows of the batch, its entry for the plan). ``taken`` holds the entries of the batches before it."""
    grid = sampling.counted_grid(records, plan, ts)
    chosen = written(sampling.next_batch(grid, plan, taken, batch), "chosen-slots")  # a small table: records meet it without a shuffle
    entry = chosen.groupBy("subreddit", "month").agg(F.lit(batch).alias("batch"), F.min("pos").alias("start_pos"), (F.max("pos") + 1).alias("end_pos"), F.sum("n").alias("rows"))
    return sampling.sample(records, plan, chosen, F.lit(batch), ts), entry
