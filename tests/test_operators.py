import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plazaflow.operators import clean, counts, dedup, ledger, profile, sampling

DAY = 86_400
JAN = 1_704_067_200  # 2024-01-01


def plan_of(spark, n, slot_target=1000, target=0, month="2016-01"):
    return sampling.plan_months(spark.createDataFrame([("s", month, n)], "subreddit string, month string, n long"), slot_target, target, "S").first()


def test_slot_length(spark):
    assert plan_of(spark, 100_000).slot_minutes == 360
    assert plan_of(spark, 10**8).slot_minutes == 1
    assert plan_of(spark, 0).slot_minutes == 44_640
    assert plan_of(spark, 10, target=10).n_slots == 1
    assert plan_of(spark, 11, slot_target=1, target=10).n_slots > 1
    assert plan_of(spark, 11, slot_target=3, target=10).slot_minutes == 10_080
    assert plan_of(spark, 11, slot_target=3, target=10).n_slots == 5


def test_last_slot_is_clipped(spark):
    plan = sampling.plan_months(spark.createDataFrame([("s", "2016-01", 11)], "subreddit string, month string, n long"), 3, 10, "S")
    slots = sampling.slot_grid(plan).orderBy("slot").collect()
    assert slots[-1].slot_end - slots[-1].slot_start == 3 * DAY
    assert sorted(r.pos for r in slots) == [0, 1, 2, 3, 4]


def grid_of(spark, ns, target):
    rows = [("s", "2024-01", i, i, JAN + i, n, target, len(ns)) for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "subreddit string, month string, pos long, slot long, slot_start long, n long, target long, n_slots long")


def test_batches(spark):
    grid = grid_of(spark, [3, 4, 0, 5, 9, 1], 6)
    assert [r.batch for r in sampling.batches(grid).orderBy("pos").collect()] == [1, 1, 2, 2, 2, 3]
    assert [r.pos for r in sampling.first_batch(grid).orderBy("pos").collect()] == [0, 1]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(ns=st.lists(st.integers(0, 9), min_size=1, max_size=30), target=st.integers(1, 12))
def test_batches_agree_with_a_loop(spark, ns, target):
    want, batch, total = [], 1, 0
    for n in ns:
        if total >= target:
            batch, total = batch + 1, 0
        total += n
        want.append(batch)
    assert [r.batch for r in sampling.batches(grid_of(spark, ns, target)).orderBy("pos").collect()] == want


def test_next_batch(spark):
    grid = grid_of(spark, [3, 4, 0, 5, 9, 1], 6)
    plan = grid.select("subreddit", "month", "n_slots").distinct()
    entries = sampling.plan_batches(sampling.batches(grid))
    assert [r.pos for r in sampling.next_batch(grid, plan, entries.filter("batch = 1"), 2).orderBy("pos").collect()] == [2, 3, 4]
    with pytest.raises(Exception, match="needs the batches before it"):
        sampling.next_batch(grid, plan, entries.filter("batch = 1"), 3).collect()
    assert sampling.next_batch(grid, plan, entries, 4).count() == 0


def test_sample_does_not_depend_on_partitions(spark):
    rows = [(str(i), "s", JAN + i * 977 % (31 * DAY)) for i in range(2000)]
    seen = []
    for parts in (1, 5):
        r = spark.createDataFrame(rows, "id string, subreddit string, created_utc long").repartition(parts)
        plan = sampling.plan_months(counts.exact_counts(r, "comments"), 50, 300, "S")
        grid = sampling.counted_grid(r, plan)
        got = sampling.sample(r, plan, sampling.first_batch(grid), F.lit(1)).collect()
        assert 300 <= len(got) < 300 + 200
        seen.append(sorted(x.id for x in got))
        every = sampling.batches(grid)
        assert sampling.sample(r, plan, every, F.col("batch")).count() == 2000
    assert seen[0] == seen[1]


def test_ranges_and_caps(spark):
    df = spark.createDataFrame([(10.0,), (100.0,), (9.0,), (101.0,), (None,)], "age double")
    assert [r.age for r in clean.range_rules(df, {"age": (10, 100)}).collect()] == [10, 100, None, None, None]
    capped = clean.iqr_cap(spark.createDataFrame([(float(x), 5.0) for x in (1, 2, 3, 4, 100)], "x double, same double"), ["x", "same"])
    assert sorted(r.x for r in capped.collect()) == [1, 2, 3, 4, 10]
    assert {r.same for r in capped.collect()} == {5.0}


def test_iqr_keeps_null(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)] + [(None,)], "x double")
    assert sum(r.x is None for r in clean.iqr_cap(df, ["x"]).collect()) == 1


def test_impute(spark):
    df = spark.createDataFrame([("a", 1.0, True, None), ("a", 3.0, None, None), ("b", None, False, None), ("b", 8.0, False, "x"), (None, 9.0, None, None)], "c string, n double, f boolean, u string")
    got = clean.impute(df, unknown=["u"], most_missing=0.9).collect()
    assert got[4].c == "a" and got[2].n == 5.5 and got[1].f is False and got[0].u == "Unknown"
    half = spark.createDataFrame([("x", None), (None, None)], "half string, more string")
    assert clean.drop_sparse(half).columns == ["half"]


def test_numeric_guard(spark):
    rows = [(str(i) if i > 1 else "x", str(i) if i > 2 else "x") for i in range(10)]
    got = dict(clean.guarded_numeric(spark.createDataFrame(rows, "two string, three string"), ["two", "three", "absent"]).dtypes)
    assert got == {"two": "double", "three": "string"}


def test_cross_field(spark):
    df = spark.createDataFrame([(30.0, 24.0), (30.0, 25.0), (None, 1.0)], "a double, b double")
    assert [tuple(r) for r in clean.null_together(df, F.col("a") * F.col("b") > 720, ["a", "b"]).collect()] == [(30, 24), (None, None), (None, 1)]
    sums = spark.createDataFrame([(30.0, None), (30.0, 1.0)], "a double, b double")
    assert clean.drop_where_sum_exceeds(sums, ["a", "b"], 30).count() == 1


def test_one_hot_slugs_share_a_column(spark):
    got = clean.one_hot(spark.createDataFrame([("tik tok",), ("Tik-Tok, x",), (None,)], "p string"), "p", "is_").collect()
    assert [(r.is_tik_tok, r.is_x) for r in got] == [(1, 0), (1, 1), (0, 0)]


def test_key_dedups_differ_on_null(spark):
    df = spark.createDataFrame([(None, 0), (None, 1), (1, 2), (1, 3)], "k int, o int")
    assert dedup.by_key_nonnull(df, "k", ["o"]).count() == 3
    assert sorted(r.o for r in dedup.by_key(df, "k", ["o"]).collect()) == [0, 2]


def test_content_hash_collides_unless_lengths_are_told(spark):
    df = spark.createDataFrame([("a|b", "c", 0), ("a", "b|c", 1)], "x string, y string, o int")
    assert dedup.by_content(df, ["o"], ["x", "y"]).count() == 1
    assert df.select(dedup.content_hash(df, ["x", "y"], length_prefix=True)).distinct().count() == 2


def test_percent_is_half_even(spark):
    df = spark.range(800).select(F.when(F.col("id") < 98, "a").otherwise("b").alias("x"))
    assert {r.value: r.percent for r in profile.freq_table(df, ["x"]).collect()}["a"] == 12.2


def test_ledger_passes_over_missing_sources(spark):
    rows = [("f", "error", "x", 1), ("f", "ok", None, 2), ("f", "source_missing", None, 3), ("g", "error", "No such file or directory", 4)]
    got = ledger.latest(spark.createDataFrame(rows, "file string, status string, error string, line_no int")).collect()
    assert [(r.file, r.status) for r in got] == [("f", "ok")]


def test_union_of_differing_types(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([("one",)], "n string")
    assert [tuple(r) for r in profile.union_by_name([a, b]).collect()] == [("1", "x"), ("one", None)]


def test_estimate(spark):
    rates = spark.createDataFrame([("s", "2024-01", 100, 50, 1000), ("s", "2024-01", 100, 100, 1000)], "subreddit string, month string, rows long, seconds long, span long")
    assert counts.estimated_counts(rates).first().n == 1500
