import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazaflow.functions import coerce, months, text


def values(spark, inputs, column):
    """What ``column`` makes of each of ``inputs``, texts or null."""
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, x string").coalesce(1)
    return [r[0] for r in df.sort("i").select(column(F.col("x")).alias("y")).collect()]


def test_to_int(spark):
    got = values(spark, ["12.7", "-3.9", "", "abc", "inf", None, "1.5e9", "1d", "1_000", "9007199254740993", " 7 "], coerce.to_int)
    assert got == [12, -3, None, None, None, None, 1500000000, None, None, 9007199254740993, 7]


def test_to_bool(spark):
    assert values(spark, ["True", "1", "no", "", None, "0", "true"], coerce.to_bool) == [True, True, False, False, None, False, True]


def test_survey_bool(spark):
    assert values(spark, ["Yes", "Y", "1.0", "FALSE", "maybe", "t", None], coerce.survey_bool) == [True, True, True, False, None, None, None]


def test_number(spark):
    assert values(spark, ["1e3", "1d", "1_000", "1,000", " 2.5", "-.5"], coerce.number) == [1000, None, None, None, 2.5, -0.5]


def test_strict_int_refuses_null(spark):
    with pytest.raises(Exception, match="age is null"):
        values(spark, [None], lambda c: coerce.strict_int(c, "age"))


def test_coerced_by_type(spark):
    assert values(spark, ["5.5"], lambda c: coerce.coerced(c, T.ShortType())) == [5]
    assert values(spark, ["5.5"], lambda c: coerce.coerced(c, T.StringType())) == ["5.5"]


def test_null_tokens(spark):
    assert values(spark, [" N/A ", "-", "null", " ", "none", "", "NaN", " x "], text.null_tokens) == [None, None, None, None, "none", None, None, "x"]


def test_category(spark):
    assert values(spark, ["non-binary", "o'neil", "3rd", " two   words ", "élan VITAL", None], text.category) == ["Non-Binary", "O'Neil", "3Rd", "Two Words", "Élan Vital", None]


def test_gender(spark):
    assert values(spark, ["m", "Woman", "nb", None], text.gender) == ["Male", "Female", "Other", None]


def test_duration(spark):
    got = values(spark, ["Less than an Hour", "Less than 2", "More than 5 hours", "Between 2 and 3 hours", "4", "never", "more", None], text.duration_hours)
    assert got == [0.5, 1.0, 6.0, 2.5, 4.0, None, None, None]


def test_name_list(spark):
    assert values(spark, ["tik tok , Insta", None, " ,,"], text.name_list) == [["Tik Tok", "Insta"], [], []]


def test_nfkc(spark):
    raw = [" ﬁne ", "①", None, "Å"]
    assert values(spark, raw, text.nfkc) == [x and unicodedata.normalize("NFKC", x).strip() for x in raw]


def test_snake_case():
    assert [text.snake_case(x) for x in ("1. What is your Age?", "a/b", " Two  Words ")] == ["what_is_your_age", "ab", "two_words"]
    assert text.unique_names(["a", "b", "a"]) == ["a", "b", "a_2"]


def test_format_bytes():
    assert [text.format_bytes(x) for x in (5, 2048, 3 * 1024**3)] == ["5.0 B", "2.0 KB", "3.0 GB"]


@pytest.mark.parametrize(("month", "days"), [("2016-02", 29), ("2024-12", 31), ("2023-02", 28)])
def test_month_bounds(spark, month, days):
    a, b = spark.range(1).select(months.month_start(F.lit(month)), months.month_end(F.lit(month))).first()
    assert b - a == days * 86400
    assert values(spark, [str(a), str(b - 1)], lambda c: months.month_of(c.cast("bigint"))) == [month, month]


def test_month_grid(spark):
    assert [r[0] for r in months.month_grid(spark, "2023-11", "2024-02").collect()] == ["2023-11", "2023-12", "2024-01", "2024-02"]
    from datetime import date

    assert months.last_full_month(date(2024, 1, 5)) == "2023-12"


def test_truncation_is_strict(spark):
    end = spark.range(1).select(months.month_end(F.lit("2024-01"))).first()[0] - 1
    last = [end - 2 * 86400 - 1, end - 2 * 86400, end - 2 * 86400 + 1, None]
    assert values(spark, [x and str(x) for x in last], lambda c: months.is_truncated(F.lit("2024-01"), c.cast("bigint"))) == [True, False, False, None]


@pytest.mark.parametrize("ts", ["2024-03-10 02:30:00", "2024-07-01 00:00:00", "1969-12-31 23:59:59", "2024-11-03 01:30:00"])
def test_epoch_does_not_ask_for_the_zone(spark, ts):
    """The session is in New York, where some of these times do not exist or exist twice."""
    from datetime import datetime, timezone

    got = spark.range(1).select(months.epoch_seconds(F.expr(f"timestamp_ntz'{ts}'"))).first()[0]
    assert got == int(datetime.fromisoformat(ts).replace(tzinfo=timezone.utc).timestamp())
