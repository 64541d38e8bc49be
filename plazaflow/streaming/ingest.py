"""Resumable ingest of JSON lines that keep arriving: what a checkpoint has seen is not read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaflow.functions.months import month_of
from plazaflow.sources.dumps import extract
from plazaflow.sources.tables import append_ledger


def ingest(spark: SparkSession, folder: str, kind: str, wanted: list[str], out: str, checkpoint: str, ledger: str | None = None) -> None:
    """Extract the wanted records of all new files in ``folder`` to ``out`` and stop.

    Each micro-batch writes to a folder of its own number, so that one that is run again after a failure
    replaces itself; its ledger record carries that number too.
    """
    lines = spark.readStream.format("text").option("pathGlobFilter", "*.json*").load(folder)
    lines = lines.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.lit(None).cast("bigint").alias("line_no"), "value", F.lit(True).alias("terminated"))

    def write(batch: DataFrame, number: int) -> None:
        found = extract(batch, kind, wanted).withColumn("month", month_of(F.col("created_utc"))).drop("line_no", "subreddit").withColumnRenamed("source", "subreddit")
        found.withColumn("ingest", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("ingest", "subreddit", "month").parquet(out)
        if ledger:
            counted = found.groupBy("file").agg(F.count("*").alias("rows_total"))
            append_ledger(counted.select("file", F.lit(kind).alias("kind"), F.lit("ok").alias("status"), "rows_total", F.lit(str(number)).alias("note")), ledger)

    query = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def live_counts(records: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Rows per source and window of a stream of (subreddit, created_utc); later than ``late`` is dropped."""
    timed = records.withColumn("created", F.timestamp_seconds("created_utc")).withWatermark("created", late)
    return timed.groupBy(F.window("created", window), "subreddit").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "subreddit", "n")
