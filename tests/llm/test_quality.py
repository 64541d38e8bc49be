import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from plazaflow.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def symbols(text):
    return [Q.START, Q.START, *map(ord, Q.marked(text)), Q.END]


def slow_model(texts):
    """Interpolated modified Kneser-Ney in plain Python: a function (a, b, c) -> probability."""
    grams = Counter()
    for t in filter(Q.marked, texts):
        s = symbols(t)
        grams.update(zip(s, s[1:], s[2:], strict=False))
    two = Counter((b, c) for _, b, c in grams)
    one = Counter(c for _, c in two)

    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [0] + [min(max(0.05, i - (i + 1) * y * n[i + 1] / n[i]), i) if n[i] else 0.05 for i in (1, 2, 3)]

    def level(counts, lower):
        d = discounts(counts)
        total, weight = Counter(), defaultdict(float)
        for g, n in counts.items():
            total[g[:-1]] += n
            weight[g[:-1]] += d[min(n, 3)]

        def p(*g):
            ctx = g[:-1]
            if not total[ctx]:
                return lower(*g[1:])
            n = counts.get(g, 0)
            return (n - d[min(n, 3)] + weight[ctx] * lower(*g[1:])) / total[ctx]

        return p

    p1 = level({(c,): n for c, n in one.items()}, lambda *_: 1 / (len(one) + 1))
    return level(grams, level(two, p1))


TEXTS = ["the cat sat on the mat.", "The dog sat on the log, the the end", "", None, "Ünï çödé 漢字", "a a a a b", "der Hund"]


@pytest.fixture(scope="module")
def model(spark):
    return Q.train(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))


def test_model_equals_a_slow_one(spark, model):
    rng = random.Random(0)
    alphabet = [Q.START, Q.END, 1, *map(ord, " thecasonmdHuç漢z")]
    p = slow_model(TEXTS)
    want = {}
    for _ in range(1500):
        g = tuple(rng.choice(alphabet) for _ in range(3))
        want[(g[0] << 42) | (g[1] << 21) | g[2]] = p(*g)
    for ctx in ((ord("t"), ord("h")), (ord("z"), ord(" ")), (1, 1)):
        every = {c for t in TEXTS if Q.marked(t) for c in symbols(t)[2:]}
        assert sum(p(*ctx, c) for c in [*every, 0x10FFFF]) == pytest.approx(1)
    got = model.probabilities(spark.createDataFrame([(c,) for c in want], "code long")).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.exp(r.lp) == pytest.approx(want[r.code], rel=1e-9)


def test_table():
    rng = np.random.default_rng(1)
    code = np.unique(rng.integers(0, 2**62, 5000))
    t = Q.Table(code, np.arange(len(code)) / 7)
    at = rng.integers(0, len(code), 9000)
    assert (t(code[at]) == at / 7).all() and len(t(code[:0])) == 0


def test_repeats_become_a_symbol():
    assert Q.marked("a a  b\nb b c") == " a\1 b\1\1 c" and Q.marked(None) == ""


def words(rng):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ne", "ru"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 80)))


def corpus():
    rng = random.Random(5)
    rows, labels, bad = [], [], set()
    for i in range(600):
        t = words(rng)
        if i % 6 == 0:
            t = [" ".join(w + "%%%" for w in t.split()), t.upper() + "!!", " ".join(["kalo"] * 60)][i // 6 % 3]
            bad.add(i)
        rows.append((i, t))
        if i % 2:
            labels.append((i, 1, 0))
        elif i % 4 == 0:
            labels.append((i, int(i not in bad), 1))
    return rows, labels, bad


def test_held_out_accuracy(spark, docs):
    rows, labels, bad = corpus()
    got = Q.classify(docs(rows).repartition(4), spark.createDataFrame(labels, LABELS), quantile=0.99).collect()
    assert len(got) == 600
    kept = {r.doc_id for r in got if r.keep}
    assert len(bad & kept) <= 0.05 * len(bad)
    assert len(set(range(600)) - bad - kept) <= 0.03 * 500
    same = Q.keep_good(docs(rows), spark.createDataFrame(labels, LABELS), quantile=0.99)
    assert same.columns == docs(rows).columns and {r.doc_id for r in same.collect()} == kept


def _hash(i):
    """Spark's xxhash64 of a long."""
    import xxhash

    return xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)


def slow_classify(rows, labels, quantile):
    """doc_id -> (n_symbols, perplexity, threshold, keep); the model, means and quantiles by plain Python."""
    good = {i for i, q, _ in labels if q == 1}
    trusted = {i for i, q, x in labels if q == 1 and not x and _hash(i) % 2 == 0}
    model = slow_model([t for i, t, _ in rows if i in trusted])

    def scored(t):
        s = symbols(t) if Q.marked(t) else []
        return -sum(float(np.log(model(*g))) for g in zip(s, s[1:], s[2:], strict=False)), max(0, len(s) - 2)

    found = {i: (*scored(t), k) for i, t, k in rows}
    good = {i for i in good - trusted if i in found and found[i][1]} or good
    limit = {}
    for k in {k for _, _, k in rows if k} | {Q.ANY}:
        some = [(x, n) for i, (x, n, lang) in found.items() if i in good and n and k in (Q.ANY, lang)]
        if some:
            mean = sum(x for x, _ in some) / sum(n for _, n in some)
            p = sorted(float(np.exp((x + Q.PRIOR * mean) / (n + Q.PRIOR))) for x, n in some)
            limit[k] = mean, p[max(0, int(np.ceil(quantile * len(p))) - 1)]
    out = {}
    for i, (x, n, k) in found.items():
        mean, threshold = limit.get(k, limit[Q.ANY])
        p = float(np.exp((x + Q.PRIOR * mean) / (n + Q.PRIOR)))
        out[i] = n, p, threshold, p <= threshold
    return out


@pytest.mark.parametrize("most", [Q.MOST_GRAMS, 0])
def test_judgements_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(Q, "MOST_GRAMS", most)  # 0: by joins
    rows, labels, _ = corpus()
    rows = [(i, t.translate(str.maketrans("kalo", "кало")) if i % 5 == 0 else t, ["xx", "en", "en", None, "de"][i % 5]) for i, t in rows[:200]]
    rows += [(900, None, "en"), (901, " ", "zz"), (902, "kalo " + "mine lo " * 20_000, "en"), (903, "漢字 " * 9, "zz")]
    labels = [x for x in labels if x[0] < 200]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, row string").repartition(3)
    want = slow_classify(rows, labels, 0.95)
    got = {r.doc_id: (r.n_symbols, r.perplexity, r.threshold, r.keep) for r in Q.classify(df, spark.createDataFrame(labels, LABELS), quantile=0.95).collect()}
    assert got.keys() == want.keys()
    for i, (n, p, threshold, keep) in want.items():
        assert got[i] == (n, pytest.approx(p, rel=1e-9), pytest.approx(threshold, rel=1e-9), keep), i
    kept = Q.keep_good(df, spark.createDataFrame(labels, LABELS), quantile=0.95)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if x[3])


def test_edges(spark, docs):
    rows, labels, _ = corpus()
    df = docs(rows + [(None, None), (9001, ""), (9002, "kalo mine"), (9002, "kalo mine")]).withColumnRenamed("source", "threshold")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (77777, 1, None), (1, 1, 0)], LABELS)
    got = Q.classify(df, lab).filter("doc_id is null or doc_id > 9000").collect()
    assert sorted((repr(r.doc_id), r.n_symbols, r.keep) for r in got) == [("9001", 0, True), ("9002", 11, True), ("9002", 11, True), ("None", 0, True)]
    other = Q.classify(docs([(1, "kalo"), (2, "x%%%" * 99)], lang=None).unionByName(docs(rows)), lab).filter("lang is null").collect()
    assert {(r.doc_id, r.keep) for r in other} == {(1, True), (2, False)}


def test_without_labels_all_stay(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert [r.keep for r in Q.classify(docs([(1, "x")]), none).collect()] == [True]
    assert Q.keep_good(docs([(1, "x")]), none).count() == 1
    assert Q.classify(docs([]), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 0
