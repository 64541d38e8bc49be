"""Tables and ledgers in files, read and written."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazaflow.functions.text import CSV_NULLS, NULL_TOKENS, null_tokens
from plazaflow.operators.clean import q
from plazaflow.schemas import MANIFEST, PLAN_BATCHES, PLAN_MONTHS, TOTALS


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column text, null for what commonly stands for a missing value."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return raw.select(*[null_tokens(q(c), (*NULL_TOKENS, *CSV_NULLS)).alias(c) for c in raw.columns])


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files of a folder, sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    return sorted(r["path"] for r in files.collect())


def read_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every CSV of a folder by its name without ending."""
    return {p.rsplit("/", 1)[-1].removesuffix(".csv"): read_csv(spark, p) for p in csv_files(spark, folder)}


def read_records(spark: SparkSession, root: str, year: int | None = None, month: str | None = None) -> DataFrame:
    """Extracted records under ``root`` (subreddit=/year=/month=); year and month prune partitions."""
    df = spark.read.option("basePath", root).parquet(root)
    if year is not None:
        df = df.filter(F.col("year") == year)
    return df if month is None else df.filter(F.col("month") == month)


def write_records(df: DataFrame, root: str, source: str = "source", month: str = "month") -> None:
    """zstd Parquet by source, year and month; months that are written again replace what was there.

    Rows of one source and month are dealt over several tasks by a hash of their id, so that a hot
    source is not one task's work; every task then writes few files.
    """
    salted = df.withColumn("subreddit_raw", F.col("subreddit")).withColumn("subreddit", F.col(source)).withColumn("year", F.substring(F.col(month), 1, 4).cast("int"))
    if source != "subreddit":
        salted = salted.drop(source)
    dealt = salted.repartition("subreddit", "year", month, F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("subreddit", "year", month).parquet(root)


def read_ledger(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """The records of a JSON-lines ledger; ``line_no`` is their order: by finished_at, then as they stand in the file."""
    return spark.read.schema(schema).json(path).withColumn("line_no", F.struct(F.coalesce("finished_at", F.lit("")), F.monotonically_increasing_id()))


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` to a folder beside ``path``, then put it in its place.

    What was there is moved aside before and deleted after, so that a run that fails at any point leaves one whole version.
    """
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write(new)
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = system.exists(made(path))
    if before and not system.rename(made(path), made(old)):
        raise OSError(f"{path} could not be moved")
    if not system.rename(made(new), made(path)):
        raise OSError(f"{new} could not be moved to {path}")
    if before:
        system.delete(made(old), True)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV with a header, quotes doubled as ``read_csv`` takes them, replacing the one before once it is written."""
    replaced(df.sparkSession, path, lambda to: df.coalesce(1).write.csv(to, header=True, escape='"'))


write_csv = write_report


def write_totals(totals: DataFrame, path: str) -> None:
    """The monthly totals by source and month, replacing those before; a missing count stays empty."""
    write_report(totals.orderBy("subreddit", "month").coalesce(1), path)


def mirror(df: DataFrame, paths: list[str], **options: str) -> None:
    """The same rows to several roots."""
    for p in paths:
        df.write.mode("overwrite").options(**options).parquet(p)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=TOTALS)


PLAN_KEYS = {"months": ["kind", "subreddit", "month"], "batches": ["kind", "subreddit", "month", "batch"]}


def _plan_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part of a saved plan; of entries of the same key the one that was saved first."""
    schema = T.StructType.fromDDL({"months": PLAN_MONTHS, "batches": PLAN_BATCHES}[part])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema, T.StructField("saved_at", T.StringType())])).json(f"{path}/{part}")
    first = F.min_by(F.struct(*schema.names), F.struct(F.coalesce("saved_at", F.lit("")), F.to_json(F.struct(*schema.names)))).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in PLAN_KEYS[part]]).agg(first).select("_row.*")


def read_plan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(months, batches) of a saved plan; a plan that is saved outweighs defaults, and what was saved first what came later."""
    return _plan_part(spark, path, "months"), _plan_part(spark, path, "batches")


def save_plan(months: DataFrame, batches: DataFrame, path: str) -> None:
    """Months and batches are added and never changed: those that the plan already has are passed over."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("saved_at")
    for part, df in (("months", months), ("batches", batches)):
        known = _plan_part(df.sparkSession, path, part)
        same = [df[k].eqNullSafe(known[k]) for k in PLAN_KEYS[part]]
        new = df.join(known, same, "left_anti").select(*known.columns, now)
        new.write.mode("append").json(f"{path}/{part}")


def prefix(df: DataFrame, rows: int) -> DataFrame:
    """The first rows, for trials."""
    return df.limit(rows)
