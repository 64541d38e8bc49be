"""Reproducible sampling of whole time slots.

A month is cut into slots of one length, aligned to its start; the slots have a fixed pseudo-random
order, that of a hash of (seed, source, month, slot number); batches take slots in this order until they hold
enough rows, each from where the one before ended. Slot numbers are computed for each record, so records
meet the slot grid in an equi-join, and empty slots keep their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plazaflow.functions.months import month_end, month_of, month_start
from plazaflow.schemas import NICE_MINUTES


def slot_minutes(count: Column, month_minutes: Column, slot_target: Column, target: Column) -> Column:
    """Length of a month's slots: the whole month if it holds no more than a batch, else the longest nice length with at most ``slot_target`` rows on average."""
    ideal = month_minutes * slot_target / count
    nice = F.array(*[F.lit(m) for m in NICE_MINUTES])
    fitting = F.array_max(F.filter(nice, lambda m: m <= ideal))
    return F.when((count <= target) | (count <= 0), month_minutes).otherwise(F.coalesce(fitting, F.lit(NICE_MINUTES[0]))).cast("bigint")


def plan_months(counts: DataFrame, slot_target: int, target: int, seed: str) -> DataFrame:
    """The plan of each (subreddit, month, n): slot length, number of slots, start and end."""
    start, end = month_start(F.col("month")), month_end(F.col("month"))
    minutes = ((end - start) / 60).cast("bigint")
    out = counts.select("subreddit", "month", F.col("n").alias("count_estimate"), F.lit(seed).alias("seed"), F.lit(slot_target).cast("bigint").alias("slot_target"), F.lit(target).cast("bigint").alias("target"), start.alias("start"), end.alias("end"))
    out = out.withColumn("slot_minutes", slot_minutes(F.col("count_estimate"), minutes, F.col("slot_target"), F.col("target")))
    return out.withColumn("n_slots", F.ceil((F.col("end") - F.col("start")) / (F.col("slot_minutes") * 60)).cast("bigint"))


def slot_grid(plan: DataFrame) -> DataFrame:
    """Every slot of every planned month, with its place in the pseudo-random order and its bounds; the last slot ends with the month."""
    slots = plan.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_slots") - 1)))
    key = F.sha2(F.concat_ws("|", "seed", F.lower("subreddit"), "month", F.col("slot").cast("string")), 256)
    w = Window.partitionBy("subreddit", "month").orderBy("_key", "slot")  # 44,640 slots a month at most
    slots = slots.withColumn("_key", key).withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).drop("_key")
    length = F.col("slot_minutes") * 60
    return slots.withColumn("slot_start", F.col("start") + F.col("slot") * length).withColumn("slot_end", F.least(F.col("start") + (F.col("slot") + 1) * length, "end"))


def with_slots(records: DataFrame, plan: DataFrame, ts: str = "created_utc") -> DataFrame:
    """The records with their month and slot number. The plan has a row a source and month; Spark broadcasts it if it is small."""
    p = plan.select("subreddit", "month", "start", "slot_minutes")
    joined = records.withColumn("month", month_of(F.col(ts))).join(p, ["subreddit", "month"])
    return joined.withColumn("slot", F.floor((F.col(ts) - F.col("start")) / (F.col("slot_minutes") * 60)).cast("bigint")).drop("start", "slot_minutes")


def counted_grid(records: DataFrame, plan: DataFrame, ts: str = "created_utc") -> DataFrame:
    """The slot grid and the rows of each slot, 0 for empty ones."""
    counts = with_slots(records.select("subreddit", ts), plan, ts).groupBy("subreddit", "month", "slot").agg(F.count("*").alias("n"))
    return slot_grid(plan).join(counts, ["subreddit", "month", "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def first_batch(grid: DataFrame) -> DataFrame:
    """Slots of batch 1: taken while the rows taken before are fewer than the target."""
    before = F.sum("n").over(Window.partitionBy("subreddit", "month").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return grid.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < F.col("target")).drop("_before")


def batches(grid: DataFrame) -> DataFrame:
    """(subreddit, month, pos, slot, slot_start, n, batch) of every slot: a batch ends with the slot that reaches the target.

    Where a batch ends depends on where the one before did, so the counts of a month are folded in order, an
    array of at most 44,640 numbers.
    """
    ordered = grid.groupBy("subreddit", "month", "target").agg(F.array_sort(F.collect_list(F.struct("pos", "slot", "slot_start", "n"))).alias("slots"))
    fold = """transform(slots, (s, i) -> s.n)"""
    start = "named_struct('batch', 1, 'sum', 0L, 'out', cast(array() as array<int>))"
    step = """(acc, n) -> if(acc.sum >= target,
        named_struct('batch', acc.batch + 1, 'sum', n, 'out', concat(acc.out, array(acc.batch + 1))),
        named_struct('batch', acc.batch, 'sum', acc.sum + n, 'out', concat(acc.out, array(acc.batch))))"""
    numbered = ordered.withColumn("batch_of", F.expr(f"aggregate({fold}, {start}, {step}, acc -> acc.out)"))
    return numbered.select("subreddit", "month", F.explode(F.arrays_zip("slots", "batch_of")).alias("z")).select("subreddit", "month", "z.slots.pos", "z.slots.slot", "z.slots.slot_start", "z.slots.n", F.col("z.batch_of").alias("batch"))


def plan_batches(numbered: DataFrame) -> DataFrame:
    """start_pos, end_pos (excluded) and rows of each batch."""
    return numbered.groupBy("subreddit", "month", "batch").agg(F.min("pos").alias("start_pos"), (F.max("pos") + 1).alias("end_pos"), F.sum("n").alias("rows"))


def sample(records: DataFrame, plan: DataFrame, chosen: DataFrame, batch: Column, ts: str = "created_utc") -> DataFrame:
    """The records of the chosen slots, with batch and slot_start."""
    keys = chosen.select("subreddit", "month", "slot", batch.cast("smallint").alias("batch"), "slot_start")
    return with_slots(records, plan, ts).join(keys, ["subreddit", "month", "slot"]).drop("month", "slot")


def require_earlier(plan: DataFrame, taken: DataFrame, batch: int) -> DataFrame:
    """The months of ``plan`` with the place where ``batch`` starts.

    A month that earlier batches exhaust comes with ``complete`` true, tested first; elsewhere a missing earlier
    batch is an error when the row is read.
    """
    had = taken.filter(F.col("batch") < batch).groupBy("subreddit", "month").agg(F.max("end_pos").alias("end_pos"), F.countDistinct("batch").alias("had"))
    out = plan.join(had, ["subreddit", "month"], "left").withColumn("start_pos", F.coalesce("end_pos", F.lit(0)).cast("bigint"))
    complete = F.coalesce(F.col("end_pos") >= F.col("n_slots"), F.lit(False))
    missing = ~complete & (F.coalesce("had", F.lit(0)) < batch - 1)
    error = F.raise_error(F.concat(F.lit(f"batch {batch} of "), "subreddit", F.lit(" "), "month", F.lit(" needs the batches before it"))).cast("bigint")
    return out.withColumn("complete", complete).withColumn("start_pos", F.when(missing, error).otherwise(F.col("start_pos"))).drop("had", "end_pos")


def next_batch(grid: DataFrame, plan: DataFrame, taken: DataFrame, batch: int) -> DataFrame:
    """Slots of a batch by a saved plan of the batches before it; none for a month that is complete."""
    at = require_earlier(plan, taken, batch).filter("not complete").select("subreddit", "month", "start_pos")
    return first_batch(grid.join(at, ["subreddit", "month"]).filter("pos >= start_pos")).drop("start_pos")
