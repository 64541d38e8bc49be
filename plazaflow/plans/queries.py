"""Every operator as a query over the benchmark tables, with SQL that has the same rows.

The tables hold no dirt, so dirty columns are made by expressions that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaflow.functions import coerce, months, text
from plazaflow.operators import clean, counts, dedup, ledger, profile, sampling
from plazaflow.plans import surveys
from plazaflow.session import table, written
from plazaflow.sources import dumps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- the tables as discussion records -------------------------------------------------------------


def comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("subreddit"), F.col("user_id").cast("string").alias("author"), months.epoch_seconds(F.col("ts")).alias("created_utc"), "value", F.col("props").alias("body"))


def submissions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("subreddit"), months.epoch_seconds(F.col("o_orderdate")).alias("created_utc"), F.col("o_totalprice").alias("value"))


COMMENTS = "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS subreddit, CAST(user_id AS VARCHAR) AS author, CAST(floor(epoch(ts)) AS BIGINT) AS created_utc, value, props AS body FROM events"
SUBMISSIONS = "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS subreddit, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_utc, o_totalprice AS value FROM orders"
MONTH_OF = "strftime(make_timestamp(created_utc * 1000000), '%Y-%m')"
MONTH_START = "CAST(epoch(CAST(month || '-01' AS TIMESTAMP)) AS BIGINT)"
MONTH_END = "CAST(epoch(CAST(month || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH) AS BIGINT)"

# ---- profiles ---------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
    c AS (SELECT "column", value, count(*) AS "count" FROM p GROUP BY ALL)
    SELECT *, round_even(100 * "count" / CAST(sum("count") OVER (PARTITION BY "column") AS DOUBLE), 1) AS percent FROM c"""
)
def freq_table(spark: SparkSession, d: str) -> DataFrame:
    return profile.freq_table(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


BRAND = "case when p_partkey % 7 = 0 then null else p_brand end"


@query(f'SELECT {BRAND} AS value, count(*) AS "count" FROM part GROUP BY ALL')
def value_counts_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(table(spark, d, "part").select(F.expr(BRAND).alias("brand")), "brand")


@query(f'SELECT {BRAND} AS value, count(*) AS "count" FROM part WHERE p_partkey % 7 <> 0 GROUP BY ALL')
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(table(spark, d, "part").select(F.expr(BRAND).alias("brand")), "brand", nulls=False)


@query(
    """WITH c AS (SELECT event_type AS category, count(*) AS "rows", count(DISTINCT user_id) AS authors FROM events GROUP BY ALL)
    SELECT * FROM c UNION ALL SELECT 'TOTAL', CAST(sum("rows") AS BIGINT), CAST(sum(authors) AS BIGINT) FROM c"""
)
def inventory_total(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("authors"))
    return profile.with_total(groups, "category")


@query("SELECT o_orderstatus AS type, CAST(count(*) AS BIGINT) AS \"rows\", round_even(sum(o_totalprice), 0) AS total FROM orders GROUP BY ALL")
def group_sums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("type")).agg(F.count("*").alias("rows"), F.bround(F.sum("o_totalprice"), 0).alias("total"))


@query("SELECT lang, count(*) AS \"rows\" FROM documents GROUP BY ALL")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    return profile.inventory(table(spark, d, "documents"), ["lang"]).select("lang", "rows")


@query(
    """SELECT source AS subreddit, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr
    FROM documents GROUP BY ALL"""
)
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.pivot_counts(table(spark, d, "documents").withColumnRenamed("source", "subreddit"), "subreddit", "lang", ["de", "en", "es", "fr"])


DIRTY_CUSTOMER = "case when c_custkey % 3 = 0 then null else c_acctbal end"


@query(
    f"""WITH t AS (SELECT c_custkey, c_mktsegment, {DIRTY_CUSTOMER} AS balance FROM customer)
    SELECT 'c_custkey' AS "column", 'bigint' AS dtype, count(*) AS "rows", count(*) - count(c_custkey) AS nulls FROM t
    UNION ALL SELECT 'c_mktsegment', 'string', count(*), count(*) - count(c_mktsegment) FROM t
    UNION ALL SELECT 'balance', 'double', count(*), count(*) - count(balance) FROM t"""
)
def profile_nulls(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile_nulls(table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.expr(DIRTY_CUSTOMER).alias("balance")))


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('8|' || CAST(doc_id AS VARCHAR)), doc_id) AS pick FROM documents)
    SELECT doc_id, source, CAST(pick AS INTEGER) AS pick FROM r WHERE pick <= 2"""
)
def shuffled_top2(spark: SparkSession, d: str) -> DataFrame:
    return profile.shuffled_top(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query(
    """SELECT c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment, 'customer' AS source_dataset FROM customer
    UNION ALL SELECT s_name, 'n' || CAST(s_nationkey AS VARCHAR), NULL, 'supplier' FROM supplier"""
)
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("source_dataset"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("nation"), F.lit("supplier").alias("source_dataset"))
    return profile.union_by_name([c, s])


@query("SELECT event_id, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS created, 'events' AS source_dataset FROM events")
def created_timestamp(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.expr("cast(timestamp_ntz'1970-01-01 00:00:00' as timestamp_ntz)").alias("zero"), months.epoch_seconds(F.col("ts")).alias("s")).select("event_id", F.expr("zero + make_dt_interval(0, 0, 0, s)").alias("created"), F.lit("events").alias("source_dataset"))


# ---- conversions ------------------------------------------------------------------------------------

JSON_VALUE = "case event_id % 9 when 0 then '\"12.7\"' when 1 then '-3.9' when 2 then '\"\"' when 3 then '\"abc\"' when 4 then '\"inf\"' when 5 then 'null' when 6 then '1.5e9' when 7 then '\"1d\"' else '42' end"
JSON_TRUTH = "case event_id % 7 when 0 then '\"True\"' when 1 then '\"1\"' when 2 then '\"no\"' when 3 then 'null' when 4 then '0' when 5 then 'true' else 'false' end"


@query(
    f"""WITH t AS (SELECT event_id, trim({JSON_VALUE}, '"') AS v, trim({JSON_TRUTH}, '"') AS b FROM events)
    SELECT CAST(event_id AS VARCHAR) AS id, CAST(trunc(CASE WHEN regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(v AS DOUBLE) END) AS BIGINT) AS score,
    CASE WHEN b = 'null' THEN NULL ELSE lower(b) IN ('true', '1') END AS over_18 FROM t"""
)
def typed_projection(spark: SparkSession, d: str) -> DataFrame:
    line = F.expr(f"concat('{{\"id\":', event_id, ',\"score\":', {JSON_VALUE}, ',\"over_18\":', {JSON_TRUTH}, '}}')")
    lines = table(spark, d, "events").select(line.alias("value"))
    return dumps.parse(lines, "submissions").select("id", "score", "over_18")


CASED = "case event_id % 4 when 0 then upper(event_type) when 1 then concat(upper(substr(event_type, 1, 1)), substr(event_type, 2)) else event_type end"
MENTION = "case event_id % 5 when 0 then 'other' else {} end"


@query(
    f"""WITH t AS (SELECT event_id, {MENTION.format(CASED)} AS s, CAST(floor(epoch(ts)) AS BIGINT) AS created_utc, value FROM events)
    SELECT CAST(event_id AS VARCHAR) AS id, created_utc, CAST(trunc(value) AS BIGINT) AS score, s AS subreddit, lower(s) AS source FROM t WHERE lower(s) IN ('click', 'view')"""
)
def filter_wanted_subs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "value", F.expr(MENTION.format(CASED)).alias("s"), months.epoch_seconds(F.col("ts")).alias("t"))
    mention = F.array(F.struct(F.lit("click").alias("subreddit")))  # a record that only mentions a source
    lines = e.select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("t").alias("created_utc"), F.col("value").alias("score"), F.col("s").alias("subreddit"), mention.alias("crosspost"))).alias("value"), F.lit(True).alias("terminated"))
    return dumps.extract(lines, "comments", ["click", "view"]).select("id", "created_utc", "score", "subreddit", "source")


DIRTY_TEXT = "case p_partkey % 8 when 0 then ' N/A ' when 1 then '-' when 2 then 'null' when 3 then 'none' when 4 then concat('  ', p_name, ' ') when 5 then '' when 6 then 'NaN' else p_name end"


@query(f"WITH t AS (SELECT p_partkey, trim({DIRTY_TEXT}) AS s FROM part) SELECT p_partkey, CASE WHEN s NOT IN ('', 'nan', 'NaN', 'N/A', 'n/a', 'NA', 'null', 'None', '-') THEN s END AS name FROM t")
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    return clean.strip_strings(table(spark, d, "part").select("p_partkey", F.expr(DIRTY_TEXT).alias("name")))


CATEGORY = "case p_partkey % 6 when 0 then ' non-binary ' when 1 then 'o''neil' when 2 then '3rd  grade' when 3 then lower(p_type) when 4 then upper(p_type) else 'usa' end"


@query(
    f"""WITH t AS (SELECT p_partkey, regexp_replace(trim({CATEGORY}), '\\s+', ' ', 'g') AS s FROM part),
    u AS (SELECT p_partkey, array_to_string([upper(w[1]) || lower(w[2:]) for w in regexp_extract_all(s, '\\pL+|\\PL+')], '') AS c FROM t)
    SELECT p_partkey, CASE c WHEN 'Usa' THEN 'United States' ELSE c END AS category FROM u"""
)
def standardize_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(CATEGORY.replace("o''neil", "o\\'neil")).alias("c")).select("p_partkey", text.category(F.col("c"), text.COUNTRY_ALIASES).alias("category"))


PLATFORM = "case p_partkey % 5 when 0 then 'Insta' when 1 then 'Fb' when 2 then 'X' when 3 then 'Tik Tok' else p_brand end"


@query(f"SELECT p_partkey, CASE {PLATFORM} WHEN 'Insta' THEN 'Instagram' WHEN 'Fb' THEN 'Facebook' WHEN 'X' THEN 'Twitter' WHEN 'Tik Tok' THEN 'Tiktok' ELSE {PLATFORM} END AS platform FROM part")
def alias_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.replaced(F.expr(PLATFORM), text.PLATFORM_ALIASES).alias("platform"))


GENDER = "case c_custkey % 6 when 0 then ' M' when 1 then 'Woman' when 2 then 'nb' when 3 then null when 4 then 'FEMALE' else 'man ' end"


@query(f"WITH t AS (SELECT c_custkey, lower(trim({GENDER})) AS g FROM customer) SELECT c_custkey, CASE WHEN g IN ('male', 'm', 'man') THEN 'Male' WHEN g IN ('female', 'f', 'woman') THEN 'Female' WHEN g IS NOT NULL THEN 'Other' END AS gender FROM t")
def gender_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.gender(F.expr(GENDER)).alias("gender"))


@query(f"WITH t AS (SELECT c_custkey, {GENDER} AS g FROM customer) SELECT c_custkey, coalesce(g, 'Unknown') AS gender FROM t")
def fill_unknown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.expr(GENDER).alias("gender")).na.fill("Unknown", ["gender"])


TRUTH = "case c_custkey % 8 when 0 then 'Yes' when 1 then 'Y' when 2 then '1.0' when 3 then 'FALSE' when 4 then 'maybe' when 5 then 't' when 6 then null else '0' end"


@query(f"WITH t AS (SELECT c_custkey, lower({TRUTH}) AS s FROM customer) SELECT c_custkey, CASE WHEN s IN ('yes', 'y', 'true', '1', '1.0') THEN true WHEN s IN ('no', 'n', 'false', '0', '0.0') THEN false END AS flag FROM t")
def bool_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", coerce.survey_bool(F.expr(TRUTH)).alias("flag"))


DURATION = "case c_custkey % 8 when 0 then 'Less than an Hour' when 1 then 'Less than 2' when 2 then 'More than 5 hours' when 3 then 'Between 2 and 3 hours' when 4 then '4' when 5 then 'never' when 6 then null else 'more' end"


@query(
    f"""WITH t AS (SELECT c_custkey, lower({DURATION}) AS s FROM customer), n AS (SELECT c_custkey, s, [CAST(x AS DOUBLE) for x in regexp_extract_all(s, '\\d+\\.?\\d*')] AS n FROM t)
    SELECT c_custkey, CASE WHEN contains(s, 'less') THEN coalesce(n[1] / 2, 0.5) WHEN contains(s, 'more') AND n[1] IS NOT NULL THEN n[1] + 1 WHEN n[2] IS NOT NULL THEN (n[1] + n[2]) / 2 ELSE n[1] END AS hours FROM n"""
)
def duration_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.duration_hours(F.expr(DURATION)).alias("hours"))


LEVEL = "case c_custkey % 4 when 0 then 'Low' when 1 then 'Medium' when 2 then 'High' else 'None' end"


@query(f"SELECT c_custkey, CASE {LEVEL} WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END AS level FROM customer")
def ordinal_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.ordinal(F.expr(LEVEL)).alias("level"))


MOSTLY = "case when p_partkey % 10 = 0 then '1d' when p_partkey % 10 = 1 then '1_000' else cast(p_size as varchar(9)) end"
HARDLY = "case when p_partkey % 10 < 3 then 'many' else cast(p_size as varchar(9)) end"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 10 > 1 THEN CAST(p_size AS DOUBLE) END AS mostly, {HARDLY} AS hardly FROM part")
def numeric_guard(spark: SparkSession, d: str) -> DataFrame:
    """A column that loses a fifth of its values is converted, one that loses more stays."""
    p = table(spark, d, "part").select("p_partkey", F.expr(MOSTLY).cast("string").alias("mostly"), F.expr(HARDLY).cast("string").alias("hardly"))
    return clean.guarded_numeric(p, ["mostly", "hardly"])


DAY = "case when c_custkey % 5 = 0 then 'no date' else '2024-02-0' || cast(c_custkey % 9 + 1 as varchar(9)) end"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CAST({DAY} AS DATE) END AS day FROM customer")
def datetime_coerce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.to_date(coerce.timestamp_or_null(F.expr(DAY))).alias("day"))


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS size FROM part")
def strict_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", coerce.strict_int(F.col("p_size").cast("double"), "p_size").alias("size"))


@query()
def nfkc_normalize(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: DuckDB has NFC alone. tests/test_functions.py holds it against unicodedata."""
    return table(spark, d, "documents").select("doc_id", text.nfkc(F.col("text")).alias("text"))


# ---- cleaning ----------------------------------------------------------------------------------------

NAMES = "case o_orderkey % 5 when 0 then 'tik tok, Insta' when 1 then 'YOUTUBE' when 2 then null when 3 then ' ,facebook ,' else 'Insta,youtube , reddit' end"


@query(
    f"""WITH t AS (SELECT o_orderkey, [trim(x) for x in str_split(lower({NAMES}), ',')] AS l FROM orders)
    SELECT o_orderkey, CAST(coalesce(list_contains(l, 'facebook'), false) AS INTEGER) AS platform_facebook, CAST(coalesce(list_contains(l, 'insta'), false) AS INTEGER) AS platform_insta,
    CAST(coalesce(list_contains(l, 'reddit'), false) AS INTEGER) AS platform_reddit, CAST(coalesce(list_contains(l, 'tik tok'), false) AS INTEGER) AS platform_tik_tok,
    CAST(coalesce(list_contains(l, 'youtube'), false) AS INTEGER) AS platform_youtube FROM t"""
)
def onehot_list(spark: SparkSession, d: str) -> DataFrame:
    return clean.one_hot(table(spark, d, "orders").select("o_orderkey", F.expr(NAMES).alias("platforms")), "platforms", "platform_").drop("platforms")


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 40 THEN p_size END AS p_size, CASE WHEN p_retailprice BETWEEN 900 AND 1200 THEN p_retailprice END AS p_retailprice FROM part")
def range_rules(spark: SparkSession, d: str) -> DataFrame:
    return clean.range_rules(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), {"p_size": (10, 40), "p_retailprice": (900, 1200)})


WILD = "case when c_custkey % 50 = 0 then c_acctbal * 100 when c_custkey % 11 = 0 then null else c_acctbal end"


@query(
    f"""WITH t AS (SELECT c_custkey, {WILD} AS balance FROM customer), q AS (SELECT quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.75) AS b FROM t)
    SELECT c_custkey, CASE WHEN balance IS NOT NULL THEN least(greatest(balance, a - 3 * (b - a)), b + 3 * (b - a)) END AS balance FROM t, q"""
)
def iqr_cap(spark: SparkSession, d: str) -> DataFrame:
    return clean.iqr_cap(table(spark, d, "customer").select("c_custkey", F.expr(WILD).alias("balance")), ["balance"])


IMPUTE = f"c_custkey, {WILD} as balance, case when c_custkey % 4 = 0 then null else c_mktsegment end as segment, case when c_custkey % 3 = 0 then null else c_custkey % 2 = 0 end as flag, case when c_custkey % 5 = 0 then null else 'g' end as organization"


@query(
    f"""WITH t AS (SELECT {IMPUTE} FROM customer),
    s AS (SELECT (SELECT median(balance) FROM t) AS m, (SELECT segment FROM t WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS g, (SELECT flag FROM t WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS f)
    SELECT c_custkey, coalesce(balance, m) AS balance, coalesce(segment, g) AS segment, coalesce(flag, f) AS flag, coalesce(organization, 'Unknown') AS organization FROM t, s"""
)
def impute_median_mode(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").selectExpr(*[x.strip() for x in IMPUTE.split(", ")])
    return clean.impute(t, protect=["c_custkey"], unknown=["organization"])


@query("SELECT p_partkey, case when p_partkey % 2 = 0 then p_size end AS half FROM part")
def null_fraction_drop(spark: SparkSession, d: str) -> DataFrame:
    """A column that misses half of its values stays, one that misses more goes."""
    return clean.drop_sparse(table(spark, d, "part").selectExpr("p_partkey", "case when p_partkey % 2 = 0 then p_size end as half", "case when p_partkey % 20 = 0 then p_size end as sparse"))


@query("SELECT 'part' AS dataset, 'size' AS rule, count(*) FILTER (p_size > 40) AS \"count\" FROM part UNION ALL SELECT 'part', 'price', count(*) FILTER (p_retailprice > 1000) FROM part")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    return clean.violations(table(spark, d, "part"), {"size": F.col("p_size") > 40, "price": F.col("p_retailprice") > 1000}, "part")


HOURS = "case when l_linenumber = 2 then null else l_quantity end"


@query(f"SELECT l_orderkey, l_linenumber, {HOURS} AS hours, l_tax * 100 AS more FROM lineitem WHERE coalesce({HOURS}, 0) + coalesce(l_tax * 100, 0) <= 30")
def row_sum_filter(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_where_sum_exceeds(table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{HOURS} as hours", "l_tax * 100 as more"), ["hours", "more"], 30)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN NOT l_quantity * l_extendedprice > 500000 THEN l_quantity END AS l_quantity, CASE WHEN NOT l_quantity * l_extendedprice > 500000 THEN l_extendedprice END AS l_extendedprice FROM lineitem")
def cross_field_null(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return clean.null_together(t, F.col("l_quantity") * F.col("l_extendedprice") > 500000, ["l_quantity", "l_extendedprice"])


HOLES = "case when c_custkey % 4 = 0 then null else c_name end as name, case when c_custkey % 8 = 0 then null else c_acctbal end as balance, 'x' as gender"


@query(f"SELECT * FROM (SELECT {HOLES} FROM customer) WHERE name IS NOT NULL OR balance IS NOT NULL")
def drop_all_null(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_all_null(table(spark, d, "customer").selectExpr(*HOLES.split(", case")[:1], *["case" + x for x in HOLES.split(", case")[1].split(", 'x'")[:1]], "'x' as gender"), ["gender"])


@query("SELECT p_partkey, p_size FROM part")
def service_columns(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_service_columns(clean.named(table(spark, d, "part").selectExpr("p_partkey", "p_size as `1. P Size`", "1 as d12", "2 as `Unnamed: 3`"))).selectExpr("p_partkey", "p_size")


# ---- duplicates ---------------------------------------------------------------------------------------

RESPONSES = "o_orderkey as ord, case when o_orderkey % 10 = 0 then null else o_custkey end as respondent, o_orderstatus as answer"


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority"))


@query(f"SELECT ord, respondent, answer FROM (SELECT *, row_number() OVER (PARTITION BY respondent ORDER BY ord) AS r FROM (SELECT {RESPONSES} FROM orders)) WHERE r = 1 OR respondent IS NULL")
def dedup_key_nonnull(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_key_nonnull(table(spark, d, "orders").selectExpr(*RESPONSES.split(", ")), "respondent", ["ord"])


@query(f"SELECT ord, respondent, answer FROM (SELECT *, row_number() OVER (PARTITION BY respondent ORDER BY ord) AS r FROM (SELECT {RESPONSES} FROM orders)) WHERE r = 1")
def dedup_key_nullsafe(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_key(table(spark, d, "orders").selectExpr(*RESPONSES.split(", ")), "respondent", ["ord"])


CONTENT = "doc_id, case when doc_id % 9 = 0 then null else lang end as lang, text"


@query(
    f"""WITH t AS (SELECT {CONTENT} FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(lang, 'nan') || '|' || coalesce(text, 'nan')) ORDER BY doc_id) AS r FROM t)
    SELECT doc_id, lang, text FROM r WHERE r = 1"""
)
def dedup_hash(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_content(table(spark, d, "documents").selectExpr(*CONTENT.split(", ")), ["doc_id"], ["lang", "text"])


RANGE = (1_704_412_800, 1_705_276_800)


@query(f"SELECT DISTINCT id, subreddit, created_utc FROM ({COMMENTS}) WHERE created_utc >= {RANGE[0]} AND created_utc < {RANGE[1]}")
def time_range(spark: SparkSession, d: str) -> DataFrame:
    """Pages that overlap give a record twice; it is returned once."""
    c = comments(spark, d).select("id", "subreddit", "created_utc")
    return counts.unique_range(c.unionByName(c.filter("created_utc % 3 = 0")), *RANGE)


# ---- counts and samples ----------------------------------------------------------------------------------


@query(
    f"""WITH c AS (SELECT subreddit, {MONTH_OF} AS month, count(*) AS n FROM ({COMMENTS}) GROUP BY ALL), s AS (SELECT CASE subreddit WHEN '1-URGENT' THEN 'click' ELSE subreddit END AS subreddit, {MONTH_OF} AS month, count(*) AS n FROM ({SUBMISSIONS}) GROUP BY ALL)
    SELECT coalesce(c.subreddit, s.subreddit) AS subreddit, coalesce(c.month, s.month) AS month, c.n AS comments_total, CASE WHEN c.n IS NOT NULL THEN 'exact_count' END AS comments_source, s.n AS posts_total, CASE WHEN s.n IS NOT NULL THEN 'exact_count' END AS posts_source
    FROM c FULL JOIN s ON c.subreddit = s.subreddit AND c.month = s.month"""
)
def monthly_totals(spark: SparkSession, d: str) -> DataFrame:
    s = submissions(spark, d).withColumn("subreddit", F.when(F.col("subreddit") == "1-URGENT", "click").otherwise(F.col("subreddit")))
    return counts.totals(counts.exact_counts(comments(spark, d), "comments"), counts.exact_counts(s, "posts"))


@query(
    f"""WITH e AS (SELECT subreddit, {MONTH_OF} AS month, count(*) AS n FROM ({SUBMISSIONS}) GROUP BY ALL), a AS (SELECT * FROM e WHERE right(month, 2) < '04'), b AS (SELECT subreddit, month, n + 1 AS n FROM e WHERE right(month, 2) < '07')
    SELECT e.subreddit, e.month, coalesce(a.n, b.n, e.n) AS n, CASE WHEN a.n IS NOT NULL THEN 'totals' WHEN b.n IS NOT NULL THEN 'statistics' ELSE 'exact_count' END AS source
    FROM e LEFT JOIN a USING (subreddit, month) LEFT JOIN b USING (subreddit, month)"""
)
def best_counts(spark: SparkSession, d: str) -> DataFrame:
    e = counts.exact_counts(submissions(spark, d), "posts")
    early = F.substring("month", 6, 2)
    sources = [("totals", e.filter(early < "04")), ("statistics", e.filter(early < "07").withColumn("n", F.col("n") + 1)), ("exact_count", e)]
    return counts.best_counts(e.select("subreddit", "month"), sources)


@query(
    f"""SELECT subreddit, strftime(make_timestamp((created_utc + 2 * 86400) * 1000000), '%Y-%m') AS month, count(*) AS n FROM ({SUBMISSIONS}) GROUP BY ALL"""
)
def statistics_counts(spark: SparkSession, d: str) -> DataFrame:
    """Times of a server come in seconds or in milliseconds."""
    s = submissions(spark, d)
    return counts.from_statistics(s.select("subreddit", F.when(F.col("id").cast("bigint") % 2 == 0, F.col("created_utc") * 1000).otherwise(F.col("created_utc")).alias("time"), F.lit(1.0).alias("value")))


NICE = ", ".join(map(str, sampling.NICE_MINUTES))


def _plan_sql(source: str, seed: str, slot_target: int, target: int) -> str:
    return f"""cnt AS (SELECT subreddit, {MONTH_OF} AS month, count(*) AS n FROM ({source}) GROUP BY ALL),
    bounds AS (SELECT *, {MONTH_START} AS "start", {MONTH_END} AS "end" FROM cnt),
    plan AS (SELECT *, CASE WHEN n <= {target} THEN ("end" - "start") // 60 ELSE coalesce(list_max([m for m in [{NICE}] if m <= ("end" - "start") // 60 * {slot_target} / CAST(n AS DOUBLE)]), 1) END AS mins FROM bounds),
    slots AS (SELECT subreddit, month, "start", "end", mins, CAST(i AS BIGINT) AS slot FROM plan, unnest(range(CAST(ceil(("end" - "start") / (mins * 60.0)) AS BIGINT))) AS t(i)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY subreddit, month ORDER BY sha256('{seed}|' || lower(subreddit) || '|' || month || '|' || CAST(slot AS VARCHAR))) - 1 AS pos FROM slots),
    rec AS (SELECT r.*, {MONTH_OF} AS month FROM ({source}) r),
    slotted AS (SELECT rec.*, (created_utc - p."start") // (p.mins * 60) AS slot FROM rec JOIN plan p USING (subreddit, month)),
    grid AS (SELECT placed.*, coalesce(k.n, 0) AS n FROM placed LEFT JOIN (SELECT subreddit, month, slot, count(*) AS n FROM slotted GROUP BY ALL) k USING (subreddit, month, slot)),
    run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY subreddit, month ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM grid)"""


SLOT, TARGET = 20, 300


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = comments(spark, d)
    plan = written(sampling.plan_months(counts.exact_counts(c, "comments"), SLOT, TARGET, "S"), "sample-plan")
    return c, plan, sampling.counted_grid(c, plan)


@query(f'WITH {_plan_sql(COMMENTS, "S", SLOT, TARGET)} SELECT subreddit, month, slot, CAST(pos AS BIGINT) AS pos, "start" + slot * mins * 60 AS slot_start, least("start" + (slot + 1) * mins * 60, "end") AS slot_end, CAST(n AS BIGINT) AS n FROM run WHERE had < {TARGET}')
def slot_sample_b1(spark: SparkSession, d: str) -> DataFrame:
    _, _, grid = _sampled(spark, d)
    return sampling.first_batch(grid).select("subreddit", "month", "slot", "pos", "slot_start", "slot_end", "n")


@query(f'WITH {_plan_sql(COMMENTS, "S", SLOT, TARGET)} SELECT s.id, s.subreddit, s.created_utc, CAST(1 AS SMALLINT) AS batch, "start" + r.slot * mins * 60 AS slot_start FROM slotted s JOIN run r USING (subreddit, month, slot) WHERE had < {TARGET}')
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    c, plan, grid = _sampled(spark, d)
    chosen = written(sampling.first_batch(grid), "chosen-slots")
    return sampling.sample(c.select("id", "subreddit", "created_utc"), plan, chosen, F.lit(1))


_BATCHES = f"""WITH RECURSIVE {_plan_sql(COMMENTS, "S", SLOT, TARGET)},
    fold(subreddit, month, pos, n, batch, total) AS (
      SELECT subreddit, month, pos, n, 1, n FROM grid WHERE pos = 0
      UNION ALL SELECT g.subreddit, g.month, g.pos, g.n, CASE WHEN f.total >= {TARGET} THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.total >= {TARGET} THEN g.n ELSE f.total + g.n END
      FROM fold f JOIN grid g ON g.subreddit = f.subreddit AND g.month = f.month AND g.pos = f.pos + 1),
    entry AS (SELECT subreddit, month, CAST(batch AS INTEGER) AS batch, CAST(min(pos) AS BIGINT) AS start_pos, CAST(max(pos) + 1 AS BIGINT) AS end_pos, CAST(sum(n) AS BIGINT) AS "rows" FROM fold GROUP BY ALL)"""


@query(f"{_BATCHES} SELECT * FROM entry")
def slot_sample_batches(spark: SparkSession, d: str) -> DataFrame:
    _, _, grid = _sampled(spark, d)
    return sampling.plan_batches(sampling.batches(grid))


@query(f"{_BATCHES} SELECT g.subreddit, g.month, g.slot, CAST(g.pos AS BIGINT) AS pos, CAST(g.n AS BIGINT) AS n FROM grid g JOIN entry e ON e.subreddit = g.subreddit AND e.month = g.month AND e.batch = 2 AND g.pos >= e.start_pos AND g.pos < e.end_pos")
def slot_sample_b2(spark: SparkSession, d: str) -> DataFrame:
    """The second batch by the saved entry of the first."""
    _, plan, grid = _sampled(spark, d)
    taken = sampling.plan_batches(sampling.batches(grid)).filter("batch = 1")
    return sampling.next_batch(grid, plan, taken, 2).select("subreddit", "month", "slot", "pos", "n")


@query(f'WITH {_plan_sql(SUBMISSIONS, "S-posts", 5, 20)} SELECT subreddit, month, n AS count_estimate, mins AS slot_minutes, CAST(ceil(("end" - "start") / (mins * 60.0)) AS BIGINT) AS n_slots FROM plan')
def slot_length_choice(spark: SparkSession, d: str) -> DataFrame:
    return sampling.plan_months(counts.exact_counts(submissions(spark, d), "posts"), 5, 20, "S-posts").select("subreddit", "month", "count_estimate", "slot_minutes", "n_slots")


# a rule of dates: in month m of any year nothing after day 24 + m % 8
CUT_OFF = "day(make_timestamp(created_utc * 1000000)) <= 24 + month(make_timestamp(created_utc * 1000000)) % 8"


@query(
    f"""WITH m AS (SELECT 'RS_' || {MONTH_OF} || '.zst' AS file, {MONTH_OF} AS month, min(created_utc) AS first_ts, max(created_utc) AS last_ts FROM ({SUBMISSIONS}) WHERE {CUT_OFF} GROUP BY ALL)
    SELECT file, month, first_ts, last_ts, last_ts < {MONTH_END} - 1 - 2 * 86400 AS truncated FROM m"""
)
def month_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Months cut off at dates of their own, from the 24th to the 31st, so that some stop too early."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_utc") / 86_400).cast("int"))
    s = submissions(spark, d).filter(F.dayofmonth(day) <= 24 + F.month(day) % 8).groupBy(months.month_of(F.col("created_utc")).alias("month")).agg(F.min("created_utc").alias("first_ts"), F.max("created_utc").alias("last_ts"))
    return s.select(F.concat(F.lit("RS_"), "month", F.lit(".zst")).alias("file"), "month", "first_ts", "last_ts", months.is_truncated(F.col("month"), F.col("last_ts")).alias("truncated"))


# ---- ledgers ----------------------------------------------------------------------------------------------

LEDGER = """case when o_orderkey % 2 = 0 then 'RC_' else 'RS_' end || cast(1995 + o_custkey % 7 as varchar(9)) || '-0' || cast(o_orderkey % 9 + 1 as varchar(9)) || '.zst' as file,
 case when o_orderkey % 2 = 0 then 'comments' else 'submissions' end as kind,
 case o_orderkey % 11 when 0 then 'error' when 1 then 'truncated' when 2 then 'stalled' when 3 then 'source_missing' when 4 then 'partial' else 'ok' end as status,
 case when o_orderkey % 22 = 0 then 'No such file or directory' when o_orderkey % 11 = 0 then 'bad\nblock' end as error,
 o_orderkey % 1000 as rows_total, cast(o_orderkey as varchar(20)) as finished_at, o_orderkey as line_no"""
LATEST = f"""led AS (SELECT {LEDGER} FROM orders), res AS (SELECT * FROM led WHERE NOT (status = 'source_missing' OR (status = 'error' AND coalesce(error, '') LIKE '%No such file%'))),
 latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS r FROM res) WHERE r = 1)"""


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("_plazaflow_orders")
    return spark.sql(f"SELECT {LEDGER} FROM _plazaflow_orders")


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(_ledger(spark, d))


@query(f"WITH {LATEST} SELECT * FROM latest")
def ledger_latest(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d)


GRID = "grid AS (SELECT p || '_' || strftime(m, '%Y-%m') || '.zst' AS file, CASE p WHEN 'RC' THEN 'comments' ELSE 'submissions' END AS kind, strftime(m, '%Y-%m') AS month FROM unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2003-12-01', INTERVAL 1 MONTH)) AS t(m), (VALUES ('RS'), ('RC')) AS k(p))"


def _grid(spark: SparkSession) -> DataFrame:
    return ledger.expected_files(months.month_grid(spark, "1996-01", "2003-12"))


@query(f"WITH {GRID} SELECT * FROM grid")
def month_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark)


@query(f"WITH {LATEST}, {GRID} SELECT * FROM grid WHERE file NOT IN (SELECT file FROM latest WHERE status IN ('ok', 'error', 'partial', 'stalled', 'truncated'))")
def work_list(spark: SparkSession, d: str) -> DataFrame:
    return ledger.work_list(_grid(spark), _latest(spark, d))


@query(f"WITH {LATEST}, {GRID} SELECT * FROM grid WHERE file NOT IN (SELECT file FROM latest WHERE status = 'ok')")
def work_list_redo(spark: SparkSession, d: str) -> DataFrame:
    return ledger.work_list(_grid(spark), _latest(spark, d), redo=True)


@query(
    f"""WITH {LATEST}, {GRID} SELECT file, kind, substr(file, 4, 7) AS month, status, CASE status WHEN 'error' THEN 0 ELSE rows_total END AS rows_saved, replace(coalesce(error, ''), chr(10), ' ') AS reason, finished_at
    FROM latest WHERE status IN ('error', 'partial', 'stalled', 'truncated') UNION ALL SELECT file, kind, month, 'missing_on_drive', 0, 'no dump of this month was found', '' FROM grid WHERE file NOT IN (SELECT file FROM led)"""
)
def problem_report(spark: SparkSession, d: str) -> DataFrame:
    return ledger.problem_report(_latest(spark, d), ledger.missing_files(_grid(spark), _ledger(spark, d)))


@query(f"WITH {LATEST} SELECT status, count(*) AS files, coalesce(string_agg(CASE WHEN status <> 'ok' THEN file END, ',' ORDER BY file), '') AS names FROM latest GROUP BY status")
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    return ledger.status_summary(_latest(spark, d))


@query(f"WITH {LATEST} SELECT kind, subreddit, CAST(sum(n) AS BIGINT) AS \"rows\" FROM (SELECT kind, 'click' AS subreddit, rows_total AS n FROM latest UNION ALL SELECT kind, 'view', rows_total + 1 FROM latest) GROUP BY ALL")
def rows_by_source(spark: SparkSession, d: str) -> DataFrame:
    return ledger.rows_by_source(_latest(spark, d).withColumn("rows", F.create_map(F.lit("click"), "rows_total", F.lit("view"), F.col("rows_total") + 1)))


@query(f"WITH led AS (SELECT {LEDGER} FROM orders) SELECT kind AS mode, status, count(*) AS tasks, CAST(coalesce(sum(CASE WHEN status = 'ok' THEN rows_total END), 0) AS BIGINT) AS \"rows\" FROM led GROUP BY ALL")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return ledger.log_summary(_ledger(spark, d).select(F.col("kind").alias("mode"), "status", F.col("rows_total").alias("rows")))


@query("SELECT 'comments_b1|' || e || '|' || strftime(m, '%Y-%m') AS task, 'comments_b1' AS mode, e AS subreddit, strftime(m, '%Y-%m') AS month FROM (SELECT DISTINCT event_type AS e FROM events), unnest(generate_series(TIMESTAMP '2023-11-01', TIMESTAMP '2024-02-01', INTERVAL 1 MONTH)) AS t(m) WHERE NOT (e = 'click' AND m = TIMESTAMP '2024-01-01')")
def task_grid(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "events").select(F.col("event_type").alias("subreddit")).distinct()
    done = spark.createDataFrame([("comments_b1|click|2024-01", "ok")], "task string, status string")
    return ledger.work_list(ledger.task_grid(months.month_grid(spark, "2023-11", "2024-02"), sources, "comments_b1"), done, redo=True, key="task")


@query(f"WITH c AS (SELECT DISTINCT subreddit, {MONTH_OF} AS month FROM ({SUBMISSIONS}) WHERE subreddit <> '5-LOW' OR created_utc < 946684800), g AS (SELECT s AS subreddit, strftime(m, '%Y-%m') AS month FROM (SELECT DISTINCT o_orderpriority AS s FROM orders) AS s(s), unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2000-12-01', INTERVAL 1 MONTH)) AS t(m)) SELECT DISTINCT 'posts' AS kind, subreddit FROM g ANTI JOIN c USING (subreddit, month)")
def incomplete_totals(spark: SparkSession, d: str) -> DataFrame:
    s = submissions(spark, d)
    grid = ledger.task_grid(months.month_grid(spark, "1995-01", "2000-12"), s.select("subreddit").distinct(), "posts").withColumnRenamed("mode", "kind")
    return ledger.incomplete(grid, counts.exact_counts(s.filter("subreddit <> '5-LOW' or created_utc < 946684800"), "posts"))


@query(f"WITH {LATEST} SELECT kind, max_by(file, rows_total * 100000000 + line_no) AS file, max(rows_total) AS rows_total FROM latest WHERE status = 'ok' GROUP BY kind")
def largest_ok(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).filter("status = 'ok'").groupBy("kind").agg(F.max_by("file", F.struct("rows_total", "line_no")).alias("file"), F.max("rows_total").alias("rows_total"))


@query(f"WITH {LATEST} SELECT file, CASE left(file, 2) WHEN 'RC' THEN 'comments' ELSE 'submissions' END AS kind, CAST(substr(file, 4, 4) AS INTEGER) AS year, substr(file, 4, 7) AS month FROM latest")
def dump_name_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = dumps.name_parts(F.col("file"))
    return _latest(spark, d).select("file", *[c.alias(n) for n, c in parts.items()])


# ---- whole cleaners ---------------------------------------------------------------------------------------

STUDENTS = "c_custkey as id, c_custkey % 70 as age, c_custkey % 30 as avg_daily_usage_hours, c_custkey % 17 as study_hours, case when c_custkey % 6 = 0 then null else c_custkey % 9 end as sleep_hours_per_night, case c_custkey % 3 when 0 then 'usa' when 1 then ' uk' else 'france' end as country"


@query(
    f"""WITH t AS (SELECT {STUDENTS} FROM customer),
    r AS (SELECT CAST(id AS VARCHAR) AS id, CASE WHEN age BETWEEN 14 AND 60 THEN CAST(age AS DOUBLE) END AS age, CASE WHEN avg_daily_usage_hours BETWEEN 0 AND 24 THEN CAST(avg_daily_usage_hours AS DOUBLE) END AS usage, CASE WHEN study_hours BETWEEN 0 AND 16 THEN CAST(study_hours AS DOUBLE) END AS study,
      CASE WHEN sleep_hours_per_night BETWEEN 2 AND 14 THEN CAST(sleep_hours_per_night AS DOUBLE) END AS sleep, CASE trim(country) WHEN 'usa' THEN 'United States' WHEN 'uk' THEN 'United Kingdom' ELSE 'France' END AS country FROM t),
    f AS (SELECT * FROM r WHERE coalesce(usage, 0) + coalesce(study, 0) + coalesce(sleep, 0) <= 30),
    s AS (SELECT median(age) AS a, median(usage) AS u, median(study) AS y, median(sleep) AS z FROM f),
    i AS (SELECT id, coalesce(age, a) AS age, coalesce(usage, u) AS usage, coalesce(study, y) AS study, coalesce(sleep, z) AS sleep, country FROM f, s),
    p AS (SELECT quantile_cont(age, [0.25, 0.75]) AS a, quantile_cont(usage, [0.25, 0.75]) AS u, quantile_cont(study, [0.25, 0.75]) AS y, quantile_cont(sleep, [0.25, 0.75]) AS z FROM i)
    SELECT id, least(greatest(age, a[1] - 3 * (a[2] - a[1])), a[2] + 3 * (a[2] - a[1])) AS age, least(greatest(usage, u[1] - 3 * (u[2] - u[1])), u[2] + 3 * (u[2] - u[1])) AS avg_daily_usage_hours,
      least(greatest(study, y[1] - 3 * (y[2] - y[1])), y[2] + 3 * (y[2] - y[1])) AS study_hours, least(greatest(sleep, z[1] - 3 * (z[2] - z[1])), z[2] + 3 * (z[2] - z[1])) AS sleep_hours_per_night, country FROM i, p"""
)
def student_cleaner(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer").selectExpr(*[x.strip() for x in STUDENTS.split(", ")])
    return surveys.student_survey(raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns]))
