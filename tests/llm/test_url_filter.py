import random
import re

import pytest
from pyspark.sql import functions as F

from plazaflow.llm import url_filter as U

SITE = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def judged(spark, urls, **more):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, token string")
    return [(r.host, r.path, r.rule, r.verdict) for r in U.judge(df, **more).orderBy("page_id").collect()]


def test_site_rules(spark):
    urls = ["https://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org.evil.net/", "x://com/de/", "x://y.com/De/", "http://example.org", "http://h.net?x/y", None, "no scheme", "", "a://b://c/d"]
    got = judged(spark, urls, site_rules=SITE, pattern_rules=[])
    assert got == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"),
        ("notexample.org.evil.net", "/", None, "allow"), ("com", "/de/", "com/de/", "block"), ("y.com", "/De/", None, "allow"),
        ("example.org", "", None, "allow"), ("h.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]


def test_patterns_equal_trying_every_rule(spark):
    rules = ["||bad.", "/ads^", "^track=*yes", "@@||bad.*/ok^", "*free*", "||a.b^"]
    urls = [f"http://{h}/{p}" for h in ("bad.net", "www.bad.net", "notbad.net", "a.b", "FREE.org", "x.net", "a.bc") for p in ("", "ads", "ads/x", "adsx", "?track=no&yes", "ok", "x/ok?y", "free")]
    want = []
    for u in urls:
        hit = [r for r in rules if re.search(U._regex(r), u.lower())]
        want.append("block" if hit and not any(r.startswith("@@") for r in hit) else "allow")
    assert [v for *_, v in judged(spark, urls * 2, site_rules=[], pattern_rules=rules)] == want * 2
    assert "block" in want and "allow" in want


RULES = [("||bad-site.", {"bad", "site"}), ("/ads^", {"ads"}), ("free", set()), ("*x/ads/*", {"ads"}), ("^track=*yes", {"track"}), ("@@||A.b/é1/c$(x)[y]{z}\\w+|?^", {"a", "b", "1", "c", "x", "y", "z", "w"})]


def test_literals_are_whole_tokens_and_expressions_are_quoted(spark):
    df = spark.createDataFrame([(r,) for r, _ in RULES], "rule string")
    got = {r.rule: (set(r.tokens), r.regex) for r in df.select("rule", U.literal_tokens(F.col("rule")).alias("tokens"), U.regex_of(F.col("rule")).alias("regex")).collect()}
    assert got == {r: (tokens, U._regex(r)) for r, tokens in RULES}


@pytest.mark.parametrize("most", [U.MOST_BROADCAST, 0])
def test_a_table_of_rules_equals_trying_every_rule(spark, monkeypatch, most):
    monkeypatch.setattr(U, "MOST_BROADCAST", most)  # 0: by shuffles
    rng = random.Random(3)
    words = ["shop", "ads", "www", "track", "free", "news", "x1"]
    rules = [None, "", "@@"] + [rng.choice(["||", "", "@@||", "@@"]) + rng.choice(words) + rng.choice(["^", "*", ".", "/"]) + rng.choice([*words, ""]) + rng.choice(["^", ""]) for _ in range(60)]
    urls = [f"http://{rng.choice(words)}.{rng.choice(words)}.net/{rng.choice(words)}/{rng.choice(words)}?{rng.choice(words)}" for _ in range(200)]
    urls += urls[:50] + [None] * 20 + ["http://hot.shop/ads"] * 30 + ["http://long/" + "a" * 100_000 + "/track/"]
    table = spark.createDataFrame([(r, "x") for r in rules * 2], "rule string, token string")
    want = []
    for u in urls:
        hit = [r for r in rules if r and r != "@@" and u and re.search(U._regex(r), u.lower())]
        want.append("block" if hit and not any(r.startswith("@@") for r in hit) else "allow")
    assert [v for *_, v in judged(spark, urls, site_rules=[], pattern_rules=table)] == want
    assert len(set(want)) == 2


def test_a_rule_is_filed_under_its_rarest_token(spark):
    urls = spark.createDataFrame([("http://a.common.com/rare",), ("http://b.common.com/",), ("http://common.com/",)], "url string")
    rules = spark.createDataFrame([("||common.com/rare^",), ("||common.com^",), ("*x",), ("||never.common.com^",)], "rule string")
    got = {r.pattern.rsplit(")?", 1)[-1]: r.token for r in U.index(urls, rules).collect()}
    assert got == {r"common\.com\/rare([^a-z0-9_.%-]|$)": "rare", r"common\.com([^a-z0-9_.%-]|$)": "common", ".*x": "*", r"never\.common\.com([^a-z0-9_.%-]|$)": "never"}


def test_equal_length_goes_to_the_longer_host(spark):
    rules = [("allow", "org/ab"), ("block", "b.org/")]
    assert judged(spark, ["http://b.org/ab"], site_rules=rules, pattern_rules=[]) == [("b.org", "/ab", "b.org/", "block")]


def test_only_candidates_meet_regular_expressions_and_no_python_runs(spark):
    df = spark.createDataFrame([(1, "http://x/")], "page_id long, url string")
    plan = U.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert judged(spark, []) == []
