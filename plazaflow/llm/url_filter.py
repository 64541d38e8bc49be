"""URL filters in DataFrame functions only.

Two kinds of rules. *Site rules* ``host/path`` fit a host, its subdomains and paths that start with
theirs; the longest wins and decides. Any other URL goes to the *pattern rules*, a table of any size: each is
filed under the rarest of its literal tokens, by counts over all URLs; a URL's tokens fetch candidates through a
hash join on the token, and only candidates run their regular expression.

Pattern syntax: ``||`` the start of a host label, ``^`` a separator or the end, ``*`` anything, ``@@`` in
front an exception, which outweighs every block; anything else stands for itself. Letters match
in either case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import LOWER, UPPER, ascii_lower, written

#: (verdict, host/path)
SITE_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: What the query's table of pattern rules holds; the operator takes any other.
PATTERN_RULES = ("||cheap-pills.", "||spam-farm.", "||casino-win.", "||free-bets.", "||adult-x.", "||ads-track.", "||doubleclick.", "/banner/ads^", "^utm_campaign=casino*", "||phish*login^", "@@||free-bets.*/help^")
#: Bytes of a table of rules or of URLs that is broadcast; larger ones are joined by shuffle, a hot key dealt over ``SALT`` tasks.
MOST_BROADCAST, SALT = 16 << 20, 16
#: The token of rules without a literal one, which no URL has of its own.
NO_TOKEN = "*"


#: Regular expressions of the start of a host label and of a separator.
LABEL_START, SEPARATOR = r"^[^:/?#]*://([^/?#]*[.@])?", "([^a-z0-9_.%-]|$)"


def _body(rule: Column) -> Column:
    return ascii_lower(F.regexp_replace(rule, r"^@@", ""))


def regex_of(rule: Column) -> Column:
    """The regular expression of a pattern rule, without its ``@@``."""
    body = _body(rule)
    rest = F.regexp_replace(F.regexp_replace(body, r"^\|\|", ""), r"([^a-z0-9*^\x{80}-\x{10FFFF}])", r"\\$1")
    rest = F.replace(F.replace(F.replace(rest, F.lit("^"), F.lit("\0")), F.lit("*"), F.lit(".*")), F.lit("\0"), F.lit(SEPARATOR))
    return F.concat(F.when(F.startswith(body, F.lit("||")), LABEL_START).otherwise(""), rest)


def literal_tokens(rule: Column) -> Column:
    """Tokens that every URL the rule fits has whole: runs of letters and digits that no wildcard or open end touches."""
    body = _body(rule)
    closed = F.concat(F.when(F.startswith(body, F.lit("||")), "^").otherwise("*"), F.regexp_replace(body, r"^\|\|", ""), F.lit("*"))
    return F.array_distinct(F.regexp_extract_all(closed, F.lit(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The struct (verdict, rule) of the longest site rule that fits, or null; of equally long ones the longer host's.

    Rules are grouped by host and a URL's host suffixes looked up, so that the work per URL follows the
    labels of its host and not the number of rules.
    """
    if not rules:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule in sorted(set(rules), key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name.translate(str.maketrans(UPPER, LOWER)), []).append((verdict, slash + rest if slash else ""))
    each = "array<struct<verdict:string,rule:string,path:string,host:int>>"
    table = F.create_map(*[x for name, found in by_host.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(name + p).alias("rule"), F.lit(p).alias("path"), F.lit(len(name)).alias("host")) for v, p in found]).cast(each))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast(each)))), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["host"].alias("h"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    return F.when(best.isNotNull(), F.struct(best["verdict"].alias("verdict"), best["rule"].alias("rule")))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(url), "[^a-z0-9]+"))


def _small(table: DataFrame, text: str) -> bool:
    n, chars = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return 32 * n + chars <= MOST_BROADCAST


def _dealt(left: DataFrame, right: DataFrame, key: str, of: Column, how: str, text: str) -> DataFrame:
    """``left`` joined with ``right`` on ``key``: broadcast if its size allows, else by a shuffle in which the left rows of a key are dealt by ``of``."""
    if _small(right, text):
        return left.join(F.broadcast(right), key, how)
    right = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.withColumn("_s", F.pmod(F.xxhash64(of), F.lit(SALT)).cast("int")).join(right, [key, "_s"], how).drop("_s")


def index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """token, pattern and block of each different rule of ``rules(rule)``: filed under the token that the fewest of ``urls(url)`` have, of equally rare ones the longest."""
    rules = rules.select("rule").filter("rule is not null and rule not in ('', '@@')").distinct()
    each = rules.select("rule", F.explode(literal_tokens(F.col("rule"))).alias("token"))
    known = written(each.select("token").distinct(), "rule-tokens")
    tokens = urls.select("url", F.explode(_tokens(F.col("url"))).alias("token"))
    counts = _dealt(tokens, known, "token", F.col("url"), "left_semi", "token").groupBy("token").count()
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token"))["token"]
    found = each.join(counts, "token", "left").groupBy("rule").agg(rarest.alias("token"))
    filed = rules.join(found, "rule", "left").select(F.coalesce("token", F.lit(NO_TOKEN)).alias("token"), regex_of(F.col("rule")).alias("pattern"), (~F.startswith(F.col("rule"), F.lit("@@"))).alias("block"))
    return written(filed, "rule-index")


def pattern_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and blocked of each different ``url`` that some rule of ``rules(rule)`` fits."""
    urls = urls.filter("url is not null").select("url").distinct()
    table = index(urls, rules)
    # rules without a literal are candidates for every URL
    tokens = F.concat(_tokens(F.col("url")), F.array(F.lit(NO_TOKEN)))
    candidates = _dealt(urls.select("url", F.explode(tokens).alias("token")), table, "token", F.col("url"), "inner", "pattern")
    hits = candidates.filter(F.expr("regexp_like(translate(url, '%s', '%s'), pattern)" % (UPPER, LOWER)))
    return hits.groupBy("url").agg(F.min("block").alias("blocked"))  # an exception's false outweighs


def judge(pages: DataFrame, site_rules: Sequence[tuple[str, str]] = SITE_RULES, pattern_rules: DataFrame | Sequence[str] = PATTERN_RULES) -> DataFrame:
    """Per row of ``pages(page_id, url)``: page_id, host, path, rule and verdict.

    pattern_rules: a table with the column ``rule``, or the rules themselves; null and empty rules are passed over, repeated ones
    count once. A URL that is null or has no ``://`` has empty host and path, fits no site rule and is judged by the
    pattern rules (null: allowed); rows that repeat each get a row; equal URLs get equal verdicts and are judged once, very
    long ones whole; an empty table gives an empty result; other columns of ``pages`` are ignored.
    """
    if not isinstance(pattern_rules, DataFrame):
        pattern_rules = pages.sparkSession.createDataFrame([(r,) for r in pattern_rules], "rule string")
    pages = pages.select("page_id", "url")
    matched = written(pattern_matches(pages, pattern_rules), "matched-urls")
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("site", site_rule(F.col("host"), F.col("path"), site_rules))
    joined = _dealt(ruled, matched, "url", F.col("page_id"), "left", "url")
    fallback = F.when(F.col("blocked"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("site.rule").alias("rule"), F.coalesce("site.verdict", fallback).alias("verdict"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL judged."""
    from plazaflow.session import table

    return judge(table(spark, sf_dir, "pages"))


def _regex(rule: str) -> str:
    """As ``regex_of``, for the SQL."""
    body = rule.removeprefix("@@").translate(str.maketrans(UPPER, LOWER))
    rest = body.removeprefix("||")
    part = {"*": ".*", "^": SEPARATOR}
    return (LABEL_START if rest != body else "") + "".join(part.get(c) or (c if c in "abcdefghijklmnopqrstuvwxyz0123456789" or ord(c) > 127 else "\\" + c) for c in rest)


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(v)}, {quoted(r)}, {quoted(r.partition('/')[0])}, {quoted('/' + r.partition('/')[2])})" for v, r in SITE_RULES)
    url = f"translate(url, '{UPPER}', '{LOWER}')"
    any_of = lambda rs: " OR ".join(f"regexp_matches({url}, {quoted(_regex(r))})" for r in rs) or "false"
    return f"""
WITH rules(verdict, rule, h, p) AS (VALUES {rules}),
parts AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM pages),
fit AS (SELECT r, arg_max(struct_pack(verdict := verdict, rule := rule), length(rule) * 1000 + length(h)) AS best
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN ({any_of([r for r in PATTERN_RULES if not r.startswith('@@')])}) AND NOT ({any_of([r for r in PATTERN_RULES if r.startswith('@@')])}) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fit USING (r)
"""


OP2_SQL = _sql()
