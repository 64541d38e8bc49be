"""Schemas of discussion records and ledgers, and the fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import types as T


# The columns of records and what a sample adds to them.
COMMENTS = (
    T.StructType()
    .add("id", "string")
    .add("parent_id", "string")
    .add("link_id", "string")
    .add("author", "string")
    .add("created_utc", "long")
    .add("score", "long")
    .add("body", "string")
    .add("subreddit", "string")
    .add("distinguished", "string")
)
SUBMISSIONS = (
    T.StructType()
    .add("id", "string")
    .add("author", "string")
    .add("created_utc", "long")
    .add("score", "long")
    .add("num_comments", "long")
    .add("title", "string")
    .add("selftext", "string")
    .add("url", "string")
    .add("domain", "string")
    .add("is_self", "boolean")
    .add("over_18", "boolean")
    .add("subreddit", "string")
)
SAMPLE_EXTRA = T.StructType().add("batch", "short").add("slot_start", "long")


def sample_schema(base: T.StructType) -> T.StructType:
    """The base columns, then batch and slot_start."""
    return T.StructType(base.fields + SAMPLE_EXTRA.fields)


#: Kind of record by the first letters of a dump's name.
KINDS = {"RC": "comments", "RS": "submissions"}
SCHEMAS = {"comments": COMMENTS, "submissions": SUBMISSIONS}

MANIFEST = "file string, kind string, status string, error string, rows map<string,bigint>, rows_total bigint, bad_json bigint, first_ts bigint, last_ts bigint, finished_at string, note string"
DOWNLOAD_LOG = "task string, mode string, subreddit string, month string, status string, rows bigint, slots bigint, slot_minutes bigint, complete_month boolean, note string, error string, finished_at string"
TOTALS = "subreddit string, month string, comments_total bigint, comments_source string, posts_total bigint, posts_source string"
PLAN_MONTHS = "kind string, subreddit string, month string, seed string, slot_target bigint, target bigint, count_estimate bigint, slot_minutes bigint"
PLAN_BATCHES = "kind string, subreddit string, month string, batch int, start_pos bigint, end_pos bigint, rows bigint"

# Statuses of a dump file, lengths of a slot in minutes, and sampling defaults.
STATUSES = ("ok", "partial", "partial_test", "truncated", "error", "stalled", "source_missing", "missing_on_drive")
#: Statuses that a later run does not try again unless it is told to.
FINAL_PROBLEMS = ("error", "partial", "stalled", "truncated")
NICE_MINUTES = (1, 2, 3, 5, 10, 15, 20, 30, 60, 120, 180, 240, 360, 480, 720, 1440, 2880, 4320, 10080)
SLOT_TARGET = {"comments": 1_000, "posts": 200}
BATCH_TARGET = {"comments": 10_000, "posts": 2_000}
TRUNCATED_AFTER_DAYS = 2
