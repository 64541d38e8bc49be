"""Cleaners of the survey tables: sequences of the rules, in the order that their results depend on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.functions import coerce, text
from plazaflow.operators import clean, dedup
from plazaflow.operators.clean import q
from plazaflow.operators.profile import union_by_name
from plazaflow.session import written

# Columns and ranges of the surveys.
SLEEP_RANGES = {
    "age": (10, 100),
    "bedtime_screen_time_minutes": (0, 600),
    "total_daily_screen_time_hours": (0, 24),
    "doomscroll_sessions_per_night": (0, 50),
    "avg_doomscroll_session_minutes": (0, 480),
    "sleep_hours_per_night": (0, 24),
    "sleep_latency_minutes": (0, 480),
    "number_of_night_wakeups": (0, 30),
    "caffeine_intake_mg_per_day": (0, 1500),
    "anxiety_score": (0, 10),
    "stress_score": (0, 10),
    "sleep_quality_score": (0, 10),
    "daytime_fatigue_score": (0, 10),
    "number_of_news_apps_used": (0, 50),
    "phone_checks_per_night": (0, 200),
    "exercise_minutes_per_day": (0, 600),
    "days_since_last_digital_detox": (0, 3650),
    "weekly_sleep_debt_hours": (-50, 100),
}
SLEEP_CATEGORIES = ("gender", "occupation_status", "country_region", "primary_device_used_at_night", "bedtime_routine_type", "sleep_quality_category")
SLEEP_BOOLEANS = ("uses_night_mode", "keeps_phone_in_bedroom", "consumes_negative_news_content", "uses_sleep_tracking_app", "doomscroller")
MEDIA_LIKERT = ("use_without_purpose", "distracted_when_busy", "restless_without_sm", "easily_distracted", "bothered_by_worries", "difficulty_concentrating", "compare_to_others", "feeling_about_comparisons", "seek_validation", "feel_depressed", "interest_fluctuation", "sleep_issues")
MEDIA_COLUMNS = ("timestamp", "age", "gender", "relationship_status", "occupation_status", "organization_type", "uses_social_media", "platforms", "avg_daily_time_social_media", *MEDIA_LIKERT)
STUDENT_RANGES = {"age": (14, 60), "avg_daily_usage_hours": (0, 24), "daily_unlocks": (0, 500), "study_hours": (0, 16), "physical_activity_hours": (0, 12), "sleep_hours_per_night": (2, 14), "stress_level": (1, 10), "mental_health_score": (0, 100)}
STUDENT_DAY = ("avg_daily_usage_hours", "study_hours", "physical_activity_hours", "sleep_hours_per_night")
STUDENT_CATEGORIES = ("gender", "country", "academic_level", "most_used_platform", "purpose_of_use")
MOST_SCROLLING_MINUTES, MOST_HOURS = 720, 30

ORDER = "_ord"


def _ordered(df: DataFrame) -> DataFrame:
    """With a row number in the order of the file, for rules that keep the first of several rows."""
    return df if ORDER in df.columns else df.withColumn(ORDER, F.monotonically_increasing_id())


def _each(df: DataFrame, columns, rule) -> DataFrame:
    return df.withColumns({c: rule(q(c)) for c in columns if c in df.columns})


def _unique_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates([c for c in df.columns if c != ORDER])


def sleep_survey(raw: DataFrame) -> DataFrame:
    df = clean.strip_strings(clean.drop_service_columns(clean.named(_ordered(raw))))
    df = clean.guarded_numeric(df, SLEEP_RANGES)
    if "respondent_id" in df.columns:
        df = dedup.by_key_nonnull(df, "respondent_id", [ORDER])
    df = clean.range_rules(_unique_rows(df), SLEEP_RANGES)
    df = _each(_each(df, SLEEP_CATEGORIES, text.category), SLEEP_BOOLEANS, coerce.survey_bool)
    sessions = ["doomscroll_sessions_per_night", "avg_doomscroll_session_minutes"]
    if set(sessions) <= set(df.columns):
        df = clean.null_together(df, F.col(sessions[0]) * F.col(sessions[1]) > MOST_SCROLLING_MINUTES, sessions)
    if {"sleep_hours_per_night", "total_daily_screen_time_hours"} <= set(df.columns):
        df = clean.null_together(df, F.col("sleep_hours_per_night") + F.col("total_daily_screen_time_hours") > MOST_HOURS, ["total_daily_screen_time_hours"])
    df = written(df.drop(ORDER), "survey")  # the figures below read it several times
    return clean.iqr_cap(clean.impute(df, protect=["respondent_id"]), SLEEP_RANGES)


def media_survey(raw: DataFrame) -> DataFrame:
    df = clean.strip_strings(clean.named(raw, MEDIA_COLUMNS))
    df = _each(df, ["timestamp"], coerce.timestamp_or_null)
    df = clean.range_rules(clean.guarded_numeric(df, ["age", *MEDIA_LIKERT]), {"age": (10, 100), **dict.fromkeys(MEDIA_LIKERT, (1, 5))})
    df = _each(dedup.exact(df), ["gender"], text.gender)
    df = _each(df, ["relationship_status", "occupation_status", "organization_type"], text.category)
    df = written(_each(df, ["uses_social_media"], coerce.survey_bool), "survey")
    if "platforms" in df.columns:
        df = clean.one_hot(df, "platforms", "platform_")
    if "avg_daily_time_social_media" in df.columns:
        df = df.withColumn("avg_daily_hours_sm", text.duration_hours(F.col("avg_daily_time_social_media")))
    return clean.impute(df, unknown=["organization_type"])


def student_survey(raw: DataFrame) -> DataFrame:
    df = clean.guarded_numeric(clean.strip_strings(clean.named(raw)), STUDENT_RANGES)
    if "stress_level" in df.columns and not clean.is_numeric(df, "stress_level"):
        df = _each(df, ["stress_level"], text.category).withColumn("stress_level_num", text.ordinal(F.col("stress_level")))
    df = clean.range_rules(dedup.exact(df), STUDENT_RANGES)
    df = clean.drop_where_sum_exceeds(df, STUDENT_DAY, MOST_HOURS)
    df = _each(df, STUDENT_CATEGORIES, text.category)
    df = _each(_each(df, ["most_used_platform"], lambda c: text.replaced(c, text.PLATFORM_ALIASES)), ["country"], lambda c: text.replaced(c, text.COUNTRY_ALIASES))
    df = written(df, "survey")
    return clean.iqr_cap(clean.impute(df), STUDENT_RANGES)


def _normalised(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text.nfkc(q(c)) for c, t in df.dtypes if t == "string" and c != ORDER})


def _with_source(df: DataFrame, name: str) -> DataFrame:
    return df.drop(ORDER).withColumn("source_dataset", F.lit(name))


def scrolling_study(raw: DataFrame, name: str) -> DataFrame:
    df = _normalised(dedup.by_key(_unique_rows(_ordered(raw)), "ResponseId", [ORDER]))
    return _with_source(_each(df, ["RecordedDate", "StartDate", "EndDate"], F.to_timestamp), name)


def addiction_survey(raw: DataFrame, name: str) -> DataFrame:
    df = clean.drop_all_null(raw, besides=["gender"])
    columns = df.columns
    df = _normalised(dedup.by_content(_unique_rows(_ordered(df)), [ORDER], columns))
    df = _each(df, ["gender"], lambda c: F.coalesce(c, F.lit("Unknown")))
    df = _each(df, ["platform_usage"], lambda c: text.replaced(c, {"Insta": "Instagram"}))
    return _with_source(_each(df, ["age"], lambda c: coerce.strict_int(c, "age")), name)


def attention_survey(raw: DataFrame, name: str) -> DataFrame:
    return _with_source(_normalised(dedup.by_key(_unique_rows(_ordered(raw)), "user_id", [ORDER])), name)


# The cleaner of each file, and the categories that its summary counts.
CLEANERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "Doomscrolling_Study2_Dataset.csv": scrolling_study,
    "Doomscrolling_Study3_Dataset.csv": scrolling_study,
    "Social_Media_Addiction.csv": addiction_survey,
    "reels_attention_span_dataset_12000.csv": attention_survey,
}
CATEGORY = {
    "Doomscrolling_Study2_Dataset.csv": "Gender",
    "Doomscrolling_Study3_Dataset.csv": "Gender",
    "Social_Media_Addiction.csv": "platform_usage",
    "reels_attention_span_dataset_12000.csv": "platform",
}
FREQUENCY_COLUMNS = {
    "Doomscrolling_Study2_Dataset": ["Gender"],
    "Doomscrolling_Study3_Dataset": ["Gender"],
    "Social_Media_Addiction": ["gender", "platform_usage", "social_interaction_level"],
    "reels_attention_span_dataset_12000": ["platform", "stress_level"],
    "sleep_doomscrolling_habits_clean": ["gender", "occupation_status", "sleep_quality_category", "doomscroller"],
    "smmh_clean": ["gender", "occupation_status", "avg_daily_time_social_media"],
    "student_sm_clean": ["gender", "academic_level", "purpose_of_use", "stress_level"],
}


def clean_all(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table by the cleaner of its file name, and all of them in one. A file without a cleaner is an error."""
    cleaned = {name: CLEANERS[name](df, name) for name, df in tables.items()}
    return cleaned, union_by_name(cleaned.values())
