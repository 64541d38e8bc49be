"""Sources, sinks and whole cleaners as queries: the tables are written as dumps, CSV, ledgers and plans to the shared folder and read back.

Each comes with SQL that has the same rows. The archive's queries ask a server that lives in this process for as long as they are
read, so that they run where workers share the driver's machine.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaflow.functions import months
from plazaflow.operators import counts, dedup, ledger
from plazaflow.plans import collection, surveys
from plazaflow.plans.queries import LEDGER, MONTH_END, MONTH_OF, SQL, SUBMISSIONS, comments, query, submissions
from plazaflow.schemas import DOWNLOAD_LOG
from plazaflow.session import scratch, table, written
from plazaflow.sources import dumps, http, tables
from plazaflow.streaming.ingest import ingest, live_counts

# ---- dumps ------------------------------------------------------------------------------------------

WANTED = ["2-high", "5-low"]


def _dump_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a record of the dump of its month, and a line that is no JSON at the end of each."""
    s = submissions(spark, d).withColumn("month", months.month_of(F.col("created_utc")))
    file = F.concat(F.lit("RS_"), "month", F.lit(".zst")).alias("file")
    value = F.to_json(F.struct("id", "subreddit", "created_utc", F.col("value").alias("score"), F.lit("x").alias("other")))
    bad = s.select("month").distinct().select(file, F.lit(2**62).alias("line_no"), F.lit("{bad").alias("value"))
    return s.select(file, F.col("id").cast("bigint").alias("line_no"), value.alias("value")).unionByName(bad)


def _dumps(spark: SparkSession, d: str) -> str:
    root = scratch(spark, "dumps")
    dumps.write_dumps(_dump_lines(spark, d), f"{root}/submissions")
    return root


def _span(spark: SparkSession, d: str) -> tuple[str, str]:
    return submissions(spark, d).select(months.month_of(F.col("created_utc")).alias("m")).agg(F.min("m"), F.max("m")).first()


@query("SELECT id, subreddit, lower(subreddit) AS source, created_utc, CAST(trunc(value) AS BIGINT) AS score FROM (" + SUBMISSIONS + ") WHERE lower(subreddit) IN ('2-high', '5-low')")
def dump_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Dumps written, listed, matched with the calendar, read and filtered."""
    root = _dumps(spark, d)
    jobs = dumps.collect_jobs(ledger.expected_files(months.month_grid(spark, *_span(spark, d))), dumps.list_dumps(spark, root))
    paths = [r["path"] for r in jobs.filter("path is not null").select("path").collect()]
    return dumps.extract(dumps.read_dumps(spark, sorted(paths)), "submissions", WANTED).select("id", "subreddit", "source", "created_utc", "score")


def _extracted(spark: SparkSession, d: str, mirrors: bool = False) -> tuple[str, str]:
    """The dumps extracted to a folder, beside them one that is no dump; and a mirror."""
    root, out, mirror = _dumps(spark, d), scratch(spark, "extracted"), scratch(spark, "mirror")
    first, last = _span(spark, d)
    system, inner = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    with system.open_output_stream(f"{inner}/RC_{first}.zst", compression=None) as f:
        f.write(b"this is no dump")
    collection.extract_dumps(spark, root, out, WANTED, first, last, mirrors=(mirror,) if mirrors else ())
    return out, mirror


_MONTHS = f"""m AS (SELECT {MONTH_OF} AS month, CAST(count(*) FILTER (lower(subreddit) IN ('2-high', '5-low')) AS BIGINT) AS rows_total, min(created_utc) AS first_ts, max(created_utc) AS last_ts FROM ({SUBMISSIONS}) GROUP BY ALL),
 v AS (SELECT 'RS_' || month || '.zst' AS file, 'submissions' AS kind, month, CASE WHEN last_ts < {MONTH_END} - 1 - 2 * 86400 THEN 'truncated' ELSE 'ok' END AS status, rows_total, CAST(1 AS BIGINT) AS bad_json, first_ts, last_ts FROM m
   UNION ALL SELECT 'RC_' || min(month) || '.zst', 'comments', min(month), 'error', 0, 0, NULL, NULL FROM m)"""


@query(f"WITH {_MONTHS} SELECT file, kind, status, rows_total, bad_json, first_ts, last_ts FROM v")
def dump_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of an extraction in which one file cannot be read and the others go on."""
    out, _ = _extracted(spark, d)
    return collection.manifest(spark, out).select("file", "kind", "status", "rows_total", "bad_json", "first_ts", "last_ts")


@query(
    f"""WITH {_MONTHS}, cal AS (SELECT strftime(t, '%Y-%m') AS month FROM (SELECT CAST(min(month) || '-01' AS TIMESTAMP) AS a, CAST(max(month) || '-01' AS TIMESTAMP) AS b FROM m), unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS x(t)),
    e AS (SELECT p || '_' || month || '.zst' AS file, CASE p WHEN 'RC' THEN 'comments' ELSE 'submissions' END AS kind, month FROM cal, (VALUES ('RS'), ('RC')) AS k(p))
    SELECT file, kind, month, status, CAST(CASE status WHEN 'error' THEN 0 ELSE rows_total END AS VARCHAR) AS rows_saved FROM v WHERE status <> 'ok'
    UNION ALL SELECT file, kind, month, 'missing_on_drive', '0' FROM e WHERE file NOT IN (SELECT file FROM v)"""
)
def dump_problem_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of the same extraction, read from its CSV."""
    out, _ = _extracted(spark, d)
    return tables.read_csv(spark, f"{out}/{collection.PROBLEMS_DIR}").select("file", "kind", "month", "status", "rows_saved")


@query(f"SELECT id, lower(subreddit) AS subreddit, subreddit AS subreddit_raw, CAST(substr({MONTH_OF}, 1, 4) AS INTEGER) AS year, {MONTH_OF} AS month FROM ({SUBMISSIONS}) WHERE lower(subreddit) IN ('2-high', '5-low') AND {MONTH_OF} LIKE '1997-%'")
def extracted_records(spark: SparkSession, d: str) -> DataFrame:
    """A year of the extracted records, by its partitions, from a mirror."""
    _, mirror = _extracted(spark, d, mirrors=True)
    return tables.read_records(spark, f"{mirror}/submissions", 1997).select("id", "subreddit", "subreddit_raw", "year", "month")


@query(f"SELECT lower(subreddit) AS subreddit, {MONTH_OF} AS month, count(*) AS n FROM ({SUBMISSIONS}) WHERE lower(subreddit) IN ('2-high', '5-low') GROUP BY ALL")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines taken in by a stream that stops when all files are read, started twice."""
    folder, out, check = (scratch(spark, x) for x in ("stream-in", "stream-out", "stream-check"))
    submissions(spark, d).select("id", "subreddit", "created_utc", F.col("value").alias("score")).write.json(folder)
    for _ in range(2):
        ingest(spark, folder, "submissions", WANTED, out, check)
    return spark.read.parquet(out).groupBy("subreddit", "month").agg(F.count("*").alias("n"))


@query("SELECT subreddit, CAST(floor(created_utc / 3600) * 3600 AS BIGINT) AS start, count(*) AS n FROM (SELECT event_type AS subreddit, CAST(floor(epoch(ts)) AS BIGINT) AS created_utc FROM events) GROUP BY ALL")
def stream_live_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts an hour of a stream of all events, the last that it gives of each."""
    folder, out, check = (scratch(spark, x) for x in ("live-in", "live-out", "live-check"))
    comments(spark, d).select("subreddit", "created_utc").write.parquet(folder)
    stream = live_counts(spark.readStream.schema("subreddit string, created_utc long").parquet(folder), late="400 days")

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("subreddit", F.unix_timestamp("start").alias("start"), "n", F.lit(number).alias("batch")).write.mode("append").parquet(out)

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("subreddit", "start").agg(F.max_by("n", "batch").alias("n"))


# ---- tables in files --------------------------------------------------------------------------------

_CSV = "case c_custkey % 5 when 0 then 'N/A' when 1 then ' ' || c_name || ' ' when 2 then '-' else c_name || ', \"x\"' || chr(10) || 'y' end"


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN c_name WHEN 2 THEN NULL ELSE c_name || ', \"x\"' || chr(10) || 'y' END AS name, c_mktsegment AS segment FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A CSV written and read: quotes, line ends, texts that stand for a missing value."""
    path = scratch(spark, "csv")
    tables.write_csv(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(_CSV).alias("name"), F.col("c_mktsegment").alias("segment")), path)
    return tables.read_csv(spark, path)


@query("SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY ALL")
def csv_folder(spark: SparkSession, d: str) -> DataFrame:
    """Every CSV of a folder, read apart."""
    path = scratch(spark, "csv-folder")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment").repartition(3, "c_mktsegment").write.option("header", "true").csv(path)
    found = tables.read_folder(spark, path)
    every = None
    for df in found.values():
        every = df if every is None else every.unionByName(df)
    return every.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"))


@query(SQL["ledger_latest"].replace("ORDER BY line_no DESC", "ORDER BY lpad(finished_at, 12, '0') DESC").replace("SELECT * FROM latest", "SELECT file, kind, status, error, rows_total FROM latest"))
def ledger_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A ledger appended to twice, read, and the latest record of each file."""
    table(spark, d, "orders").createOrReplaceTempView("_plazaflow_orders")
    rows = spark.sql(f"SELECT {LEDGER} FROM _plazaflow_orders").withColumn("finished_at", F.lpad("finished_at", 12, "0")).drop("line_no")
    path = scratch(spark, "ledger")
    for half in ("rows_total < 500", "rows_total >= 500"):
        tables.append_ledger(rows.filter(half), path)
    return ledger.latest(tables.read_ledger(spark, path)).select("file", "kind", "status", "error", "rows_total")


@query(SQL["monthly_totals"])
def totals_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The table of monthly totals written as a CSV and read with its types."""
    from plazaflow.plans.queries import QUERIES

    path = scratch(spark, "totals")
    tables.write_totals(QUERIES["monthly_totals"](spark, d), path)
    return tables.read_totals(spark, path)


_TASKS = "'comments_b1|' || o_orderpriority || '|' || cast(o_custkey % 40 as varchar(9)) as task; 'comments_b1' as mode; o_orderpriority as subreddit; cast(o_custkey % 40 as varchar(9)) as month; case o_orderkey % 3 when 0 then 'error' else 'ok' end as status; case when o_orderkey % 6 = 0 then 'no answer' end as error; lpad(cast(o_orderkey as varchar(12)), 12, '0') as finished_at"


@query(f"""WITH t AS (SELECT {_TASKS.replace(";", ",")} FROM orders), l AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY finished_at DESC) AS r FROM t)
    SELECT task, mode, subreddit, month, status, coalesce(error, '') AS error, finished_at FROM l WHERE r = 1 AND status <> 'ok'""")
def task_problems(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that have not ended well, by task, from their log as it was written."""
    path = scratch(spark, "task-log")
    tables.append_ledger(table(spark, d, "orders").selectExpr(*_TASKS.split(";")), path)
    return ledger.task_problems(spark.read.schema(DOWNLOAD_LOG).json(path))


_PLAN = "SELECT 'posts' AS kind, o_orderpriority AS subreddit, strftime(o_orderdate, '%Y-%m') AS month, 'S' AS seed, CAST(200 AS BIGINT) AS slot_target, CAST(2000 AS BIGINT) AS target, count(*) AS count_estimate, CAST({} AS BIGINT) AS slot_minutes FROM orders {} GROUP BY ALL"


@query(f"{_PLAN.format(60, 'WHERE month(o_orderdate) <= 6')} UNION ALL {_PLAN.format(1440, 'WHERE month(o_orderdate) > 6')}")
def plan_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A plan saved for half the months, then for all with another slot: what was saved first stays."""
    s = submissions(spark, d).withColumn("month", months.month_of(F.col("created_utc"))).groupBy("subreddit", "month").agg(F.count("*").alias("count_estimate"))
    fixed = {"kind": F.lit("posts"), "seed": F.lit("S"), "slot_target": F.lit(200).cast("bigint"), "target": F.lit(2000).cast("bigint")}
    plan = written(s.withColumns(fixed), "plan-rows")
    none, path = spark.createDataFrame([], tables.PLAN_BATCHES), scratch(spark, "plan")
    tables.save_plan(plan.filter("substring(month, 6, 2) <= '06'").withColumn("slot_minutes", F.lit(60).cast("bigint")), none, path)
    tables.save_plan(plan.withColumn("slot_minutes", F.lit(1440).cast("bigint")), none, path)
    return tables.read_plan(spark, path)[0]


# ---- the archive --------------------------------------------------------------------------------------

EACH, STEP, START = 700, 3_001, 1_704_067_200
SOURCES = ("art", "books")
_SERVED = f"SELECT s || '-' || i AS id, s AS subreddit, CAST({START} + (i // 3) * {STEP} AS BIGINT) AS created_utc, i AS score FROM (VALUES ('art'), ('books')) AS k(s), range(0, {EACH}) AS t(i)"


@contextmanager
def _archive() -> Iterator[str]:
    """A server of three records a second for two sources; it refuses the first question and finds long ones too long."""
    rows = {s: [{"id": f"{s}-{i}", "subreddit": s, "created_utc": START + i // 3 * STEP, "score": str(i)} for i in range(EACH)] for s in SOURCES}
    asked: list[str] = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            asked.append(self.path)
            p = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            first, end = int(p["after"]), int(p["before"])
            code, body = 200, {}
            if len(asked) == 1:
                body = {"error": "warming up"}
            elif end - first > 20 * 86_400 and "limit" not in p:
                code = 422
            else:
                found = [r for r in rows[p["subreddit"]] if first <= r["created_utc"] < end]
                body = {"data": found[: int(p["limit"])] if "limit" in p else [{"count": len(found)}]}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}"
    finally:
        server.shutdown()


def _ranges() -> list[tuple[str, int, int]]:
    return [(s, START, START + 31 * 86_400) for s in SOURCES]


def _asked(spark: SparkSession, read: Callable[..., DataFrame]) -> DataFrame:
    with _archive() as url:
        return written(read(spark, url, "comments", _ranges(), min_interval=0.0), "archive")


@query(f"SELECT id, subreddit, created_utc, CAST(score AS BIGINT) AS score FROM ({_SERVED}) WHERE created_utc < {START} + 31 * 86400")
def archive_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record of a month, in pages that end within a second."""
    return _asked(spark, http.read_archive).select("id", "subreddit", "created_utc", "score")


@query(f"SELECT subreddit, '2024-01' AS month, count(*) AS n FROM ({_SERVED}) WHERE created_utc < {START} + 31 * 86400 GROUP BY ALL")
def archive_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts of a month that the server can only count in parts."""
    return _asked(spark, http.read_counts)


@query(
    f"""WITH r AS ({_SERVED}), p AS (SELECT k, {START} + 31 * 86400 * k // 3 AS a, {START} + 31 * 86400 AS b FROM range(0, 3) AS t(k)),
    o AS (SELECT subreddit, k, a, b, created_utc, row_number() OVER (PARTITION BY subreddit, k ORDER BY created_utc, score) AS n FROM r JOIN p ON created_utc >= a AND created_utc < b),
    g AS (SELECT subreddit, k, count(*) AS n, CASE WHEN count(*) = 100 THEN max(created_utc) - min(a) ELSE min(b - a) END AS s FROM o WHERE n <= 100 GROUP BY ALL)
    SELECT subreddit, '2024-01' AS month, CAST(trunc(sum(n / greatest(s, 1)) / 3 * 31 * 86400) AS BIGINT) AS n FROM g GROUP BY subreddit"""
)
def archive_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Counts estimated from three short pages."""
    return counts.estimated_counts(_asked(spark, http.read_rates))


# ---- whole cleaners -----------------------------------------------------------------------------------

_SLEEP = """case when c_custkey % 13 = 0 then null else cast(c_custkey % 1000 as varchar(9)) end as respondent_id; cast(c_custkey % 120 as varchar(9)) as age; cast(c_custkey % 60 as varchar(9)) as doomscroll_sessions_per_night;
 cast(c_custkey % 20 as varchar(9)) as avg_doomscroll_session_minutes; case c_custkey % 3 when 0 then 'yes' when 1 then 'No' else 'maybe' end as doomscroller; case c_custkey % 4 when 0 then ' male' when 1 then 'non-binary' when 2 then 'female' else 'N/A' end as gender"""


def _capped(c: str, p: str) -> str:
    return f"least(greatest({c}, {p}[1] - 3 * ({p}[2] - {p}[1])), {p}[2] + 3 * ({p}[2] - {p}[1]))"


@query(
    f"""WITH t AS (SELECT c_custkey, {_SLEEP.replace(";", ",")} FROM customer),
    k AS (SELECT * FROM t WHERE respondent_id IS NULL UNION ALL SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY respondent_id ORDER BY c_custkey) AS r FROM t WHERE respondent_id IS NOT NULL) WHERE r = 1),
    u AS (SELECT DISTINCT respondent_id, CAST(age AS DOUBLE) AS age, CAST(doomscroll_sessions_per_night AS DOUBLE) AS s, CAST(avg_doomscroll_session_minutes AS DOUBLE) AS m, doomscroller, gender FROM k),
    r AS (SELECT respondent_id, CASE WHEN age BETWEEN 10 AND 100 THEN age END AS age, CASE WHEN s BETWEEN 0 AND 50 THEN s END AS s, m, CASE doomscroller WHEN 'yes' THEN true WHEN 'No' THEN false END AS doom,
      CASE gender WHEN ' male' THEN 'Male' WHEN 'non-binary' THEN 'Non-Binary' WHEN 'female' THEN 'Female' END AS gender FROM u),
    g AS (SELECT respondent_id, age, CASE WHEN coalesce(s * m, 0) <= 720 THEN s END AS s, CASE WHEN coalesce(s * m, 0) <= 720 THEN m END AS m, doom, gender FROM r),
    f AS (SELECT median(age) AS a, median(s) AS s, median(m) AS m FROM g),
    i AS (SELECT respondent_id, coalesce(age, f.a) AS age, coalesce(g.s, f.s) AS s, coalesce(g.m, f.m) AS m, coalesce(doom, (SELECT doom FROM g WHERE doom IS NOT NULL GROUP BY doom ORDER BY count(*) DESC, doom LIMIT 1)) AS doom,
      coalesce(gender, (SELECT gender FROM g WHERE gender IS NOT NULL GROUP BY gender ORDER BY count(*) DESC, gender LIMIT 1)) AS gender FROM g, f),
    p AS (SELECT quantile_cont(age, [0.25, 0.75]) AS a, quantile_cont(s, [0.25, 0.75]) AS s, quantile_cont(m, [0.25, 0.75]) AS m FROM i)
    SELECT respondent_id, {_capped("age", "p.a")} AS age, {_capped("i.s", "p.s")} AS doomscroll_sessions_per_night, {_capped("i.m", "p.m")} AS avg_doomscroll_session_minutes, doom AS doomscroller, gender FROM i, p"""
)
def sleep_cleaner(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer").orderBy("c_custkey").selectExpr(*_SLEEP.split(";"))
    return surveys.sleep_survey(raw.toDF("Respondent ID", "Age", "Doomscroll Sessions per Night", "Avg Doomscroll Session Minutes", "Doomscroller", "Gender"))


_MEDIA = """'2022-04-18 19:18:47' as t; cast(c_custkey % 120 as varchar(9)) as age; case c_custkey % 5 when 0 then 'Male' when 1 then 'woman' when 2 then 'nb' when 3 then 'F' else null end as gender; 'single' as rel; ' university  student ' as occ;
 case when c_custkey % 2 = 0 then 'company' end as org; 'Yes' as uses; case c_custkey % 3 when 0 then 'Facebook, X' when 1 then 'Youtube' else 'facebook,,' end as platforms;
 case c_custkey % 4 when 0 then 'Less than an Hour' when 1 then 'More than 5 hours' when 2 then 'Between 2 and 3 hours' else 'never' end as daily; cast(c_custkey % 7 as varchar(9)) as l0"""


@query(
    f"""WITH t AS (SELECT DISTINCT {_MEDIA.replace(";", ",")} FROM customer),
    r AS (SELECT CASE WHEN CAST(age AS DOUBLE) BETWEEN 10 AND 100 THEN CAST(age AS DOUBLE) END AS age, CASE gender WHEN 'Male' THEN 'Male' WHEN 'woman' THEN 'Female' WHEN 'F' THEN 'Female' WHEN 'nb' THEN 'Other' END AS gender,
      CASE WHEN org = 'company' THEN 'Company' ELSE 'Unknown' END AS org, platforms, daily, CASE WHEN CAST(l0 AS DOUBLE) BETWEEN 1 AND 5 THEN CAST(l0 AS DOUBLE) END AS l0,
      CASE daily WHEN 'Less than an Hour' THEN CAST(0.5 AS DOUBLE) WHEN 'More than 5 hours' THEN 6.0 WHEN 'Between 2 and 3 hours' THEN 2.5 END AS hours, gender AS g0 FROM t),
    raw AS (SELECT DISTINCT age, g0, org, platforms, daily, l0, gender, hours FROM r)
    SELECT coalesce(age, (SELECT median(age) FROM raw)) AS age, coalesce(gender, (SELECT gender FROM raw WHERE gender IS NOT NULL GROUP BY gender ORDER BY count(*) DESC, gender LIMIT 1)) AS gender,
      'Single' AS relationship_status, 'University Student' AS occupation_status, org AS organization_type, true AS uses_social_media, platforms, daily AS avg_daily_time_social_media,
      CAST(platforms <> 'Youtube' AS INTEGER) AS platform_facebook, CAST(platforms = 'Facebook, X' AS INTEGER) AS platform_x, CAST(platforms = 'Youtube' AS INTEGER) AS platform_youtube,
      coalesce(hours, (SELECT median(hours) FROM raw)) AS avg_daily_hours_sm, coalesce(l0, (SELECT median(l0) FROM raw)) AS use_without_purpose, CAST(3 AS DOUBLE) AS sleep_issues FROM raw"""
)
def media_cleaner(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer").selectExpr(*_MEDIA.split(";"), *[f"'3' as l{i}" for i in range(1, 12)])
    names = ["age", "gender", "relationship_status", "occupation_status", "organization_type", "uses_social_media", "platforms", "avg_daily_time_social_media", "platform_facebook", "platform_x", "platform_youtube", "avg_daily_hours_sm", "use_without_purpose", "sleep_issues"]
    return surveys.media_survey(raw).select(*[F.col(c).cast("int").alias(c) if c.startswith("platform_") else F.col(c) for c in names])


_SCROLLING = "case when c_custkey % 13 = 0 then null else 'R_' || cast(c_custkey % 700 as varchar(9)) end as ResponseId; '2023-0' || cast(c_custkey % 9 + 1 as varchar(9)) || '-05 10:20:30' as RecordedDate; cast(c_custkey % 3 as varchar(9)) as Gender"


@query(
    f"""WITH t AS (SELECT c_custkey, {_SCROLLING.replace(";", ",")} FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY ResponseId ORDER BY c_custkey) AS r FROM t)
    SELECT ResponseId, RecordedDate, Gender, 'Doomscrolling_Study2_Dataset.csv' AS source_dataset FROM k WHERE r = 1"""
)
def scrolling_cleaner(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer").orderBy("c_custkey").selectExpr(*_SCROLLING.split(";"))
    return surveys.scrolling_study(raw, "Doomscrolling_Study2_Dataset.csv").withColumn("RecordedDate", F.date_format("RecordedDate", "yyyy-MM-dd HH:mm:ss"))


_ADDICTION = "case when c_custkey % 11 = 0 then null else cast(c_custkey % 90 as varchar(9)) end as age; case when c_custkey % 4 = 0 then null else 'Male' end as gender; case when c_custkey % 11 = 0 then null when c_custkey % 2 = 0 then 'Insta' else 'X' end as platform_usage"


@query(
    f"""SELECT DISTINCT CAST(age AS INTEGER) AS age, coalesce(gender, 'Unknown') AS gender, CASE platform_usage WHEN 'Insta' THEN 'Instagram' ELSE platform_usage END AS platform_usage, 'Social_Media_Addiction.csv' AS source_dataset
    FROM (SELECT {_ADDICTION.replace(";", ",")} FROM customer) WHERE age IS NOT NULL OR platform_usage IS NOT NULL"""
)
def addiction_cleaner(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer").selectExpr(*_ADDICTION.split(";"))
    return surveys.addiction_survey(raw, "Social_Media_Addiction.csv").withColumn("age", F.col("age").cast("int"))


_ATTENTION = "case when c_custkey % 17 = 0 then null else cast(c_custkey % 400 as varchar(9)) end as user_id; c_mktsegment as platform; cast(c_custkey % 10 as varchar(9)) as stress_level"


@query(
    f"""WITH t AS (SELECT c_custkey, {_ATTENTION.replace(";", ",")} FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c_custkey) AS r FROM t)
    SELECT user_id, platform, stress_level, 'reels_attention_span_dataset_12000.csv' AS source_dataset FROM k WHERE r = 1"""
)
def attention_cleaner(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer").orderBy("c_custkey").selectExpr(*_ATTENTION.split(";"))
    return surveys.attention_survey(raw, "reels_attention_span_dataset_12000.csv")


@query(
    f"""SELECT 'Social_Media_Addiction.csv' AS source_dataset, count(*) AS n, count(platform_usage) AS with_usage, 0 AS with_user FROM ({SQL["addiction_cleaner"]})
    UNION ALL SELECT 'reels_attention_span_dataset_12000.csv', count(*), 0, count(user_id) FROM ({SQL["attention_cleaner"]})"""
)
def surveys_combined(spark: SparkSession, d: str) -> DataFrame:
    """Two surveys cleaned by their files' names and put into one table."""
    c = table(spark, d, "customer").orderBy("c_custkey")
    _, every = surveys.clean_all({"Social_Media_Addiction.csv": c.selectExpr(*_ADDICTION.split(";")), "reels_attention_span_dataset_12000.csv": c.selectExpr(*_ATTENTION.split(";"))})
    return every.groupBy("source_dataset").agg(F.count("*").alias("n"), F.count("platform_usage").alias("with_usage"), F.count("user_id").alias("with_user"))


_PLAIN = "'fi ' || c_name || ' A1 ' || chr(233) || ' Kg'"


@query(f"SELECT c_custkey AS id, {_PLAIN} AS text FROM customer")
def nfkc_made_text(spark: SparkSession, d: str) -> DataFrame:
    """Ligatures, wide letters and digits, combining marks and wide blanks around names become their plain forms."""
    from plazaflow.functions import text

    odd = F.concat(F.lit("\u3000\ufb01 "), "c_name", F.lit(" \uff21\uff11 e\u0301 \u212ag "))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.nfkc(odd).alias("text"))


@query("SELECT DISTINCT c_mktsegment AS segment, first(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS id FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT NULL, c_custkey FROM customer WHERE c_custkey % 3 = 0")
def dedup_hot_key(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each of few keys; rows without one all stay."""
    c = table(spark, d, "customer").select(F.expr("case when c_custkey % 3 > 0 then c_mktsegment end").alias("segment"), F.col("c_custkey").alias("id"))
    return dedup.by_key_nonnull(c, "segment", ["id"])
