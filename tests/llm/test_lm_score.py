import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plazaflow.llm import gru
from plazaflow.llm import lm_score as L
from plazaflow.llm.gru import CLASSES, GROUPS, HIDDEN, INNER, SHAPES, START, WORDS


def random_params(seed=4):
    rng = np.random.default_rng(seed)
    p = gru.first_params(rng.integers(0, 50, START))
    return {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in p.items()}


def naive_score(p, doc):
    """The natural log probability of a document, one token at a time, in double precision."""
    p = {k: v.astype(np.float64) for k, v in p.items()}
    sig, H = (lambda x: 1 / (1 + np.exp(-x))), HIDDEN
    h, last, total = np.zeros(H), START, 0.0
    for t in doc:
        g, a = p["x"][last] + p["b"], h @ p["u"]
        z, r = sig(g[:H] + a[:H]), sig(g[H : 2 * H] + a[H : 2 * H])
        n = np.tanh(g[2 * H :] + r * a[2 * H :])
        h = (1 - z) * n + z * h
        c = h @ p["c"] + p["cb"]
        k = t // INNER if t < WORDS else t - WORDS + GROUPS
        total += c[k] - np.log(np.exp(c).sum())
        if t < WORDS:
            w = h @ p["w"][k] + p["wb"][k]
            total += w[t % INNER] - np.log(np.exp(w).sum())
        last = t
    return total


def test_scores_equal_one_step_at_a_time():
    p, rng = random_params(), np.random.default_rng(1)
    docs = [rng.integers(0, START, n) for n in (1, 70, 3, 200, 33, 32, 0)]
    want = [naive_score(p, d) for d in docs]
    for more in ({}, {"lanes": 2, "window": 5}):
        assert np.allclose(gru.score(p, docs, **more), want, rtol=1e-4)
    assert len(gru.score(p, [])) == 0


def test_gradients():
    t = gru.Trainer({k: v.astype(np.float64) for k, v in random_params().items()})
    rng = np.random.default_rng(0)
    given, target = rng.integers(0, START + 1, (5, 3)), rng.integers(0, START, (5, 3))
    keep, h, weight = rng.integers(0, 2, (5, 3, 1)).astype(float), rng.standard_normal((3, HIDDEN)) * 0.1, np.ones((5, 3))
    weight[4, 2] = 0

    def loss():
        t._gradients(given, target, weight, keep, h)
        return t.loss

    grads, _ = t._gradients(given, target, weight, keep, h)
    for k, v in t.params.items():
        flat, i = v.reshape(-1), int(np.argmax(np.abs(grads[k])))
        old, e = flat[i], 1e-4
        flat[i] = old + e
        up = loss()
        flat[i] = old - e
        down = loss()
        flat[i] = old
        assert grads[k].reshape(-1)[i] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-6)


def test_next_token_probabilities_sum_to_one():
    p = random_params()
    h = np.random.default_rng(2).standard_normal((1, HIDDEN)).astype(np.float32)
    every = np.arange(WORDS + SHAPES)
    assert np.exp(gru.log_probs(p, np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, rel=1e-4)
    assert CLASSES == GROUPS + SHAPES


def test_training_reads_every_token_and_lowers_the_loss(monkeypatch):
    rng = np.random.default_rng(3)
    docs = [np.tile([1, 2, 3, 4], 30) + 10 * int(rng.integers(3)) for _ in range(60)]
    first = gru.first_params(np.bincount(np.concatenate(docs), minlength=START))
    monkeypatch.setattr(gru, "GATHERED", 1000)
    seen = []
    step = gru.Trainer._gradients

    def watched(self, given, target, weight, keep, h):
        seen.append(target[weight > 0])
        return step(self, given, target, weight, keep, h)

    monkeypatch.setattr(gru.Trainer, "_gradients", watched)
    t = gru.Trainer(first)
    t.learn([*docs, np.arange(2500) % START])
    assert sorted(np.concatenate(seen)) == sorted(np.concatenate([*docs, np.arange(2500) % START])) and t.tokens == 60 * 120 + 2500
    monkeypatch.undo()
    t = gru.Trainer(first, 0.02)
    for _ in range(5):
        t.learn(docs)
    assert gru.score(t.params, docs).sum() > 0.6 * gru.score(first, docs).sum()


def test_parameters_come_back_and_average():
    p, q = random_params(1), random_params(2)
    back = gru.from_bytes(gru.to_bytes(p))
    assert all((back[k] == p[k]).all() for k in p)
    n, raw = gru.average([(1, gru.to_bytes(p)), (3, gru.to_bytes(q))])
    assert n == 4 and all(np.allclose(v, 0.25 * p[k] + 0.75 * q[k], atol=1e-6) for k, v in gru.from_bytes(raw).items())
    assert gru.average([]) == (0, b"")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("frequent", [5, 10_000])
def test_counts_equal_brute_force_and_the_model_beats_them(spark, docs, frequent, monkeypatch):
    monkeypatch.setattr(L, "HELD", 50)
    rng = random.Random(1)
    rows = []
    for i in range(300):
        kind = rng.choice("xyz")
        rows.append((i, " ".join(rng.choice([f"{kind}{rng.randrange(30)}", "The", f"é{rng.randrange(10**6)}"]) for _ in range(rng.randint(0, 60)))))
    rows += [(1000, None), (1001, ""), (1002, "x1\tX1\x0bnew\x1cword"), (7, "again"), (7, "again")]
    got = L.score(docs(rows).withColumnRenamed("source", "row").repartition(3), frequent=frequent).collect()
    tokens = [(i, [w for w in (t or "").encode().lower().split()] + [b""]) for i, t in rows]
    c = Counter(w for i, ws in tokens for w in ws if not held_out(i))
    n, v = sum(c.values()), len(c)
    base = Counter()
    for i, ws in tokens:
        b = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        base[(i, held_out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(b, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base
    out = [r for r in got if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_the_model_reads_all_training_documents_and_scores_equal_brute_force(spark, docs, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "of", f"w{rng.randrange(40)}", f"é{rng.randrange(10**6)}", "12."]) for _ in range(rng.choice([0, 5, 80])))) for i in range(200)]
    rows += [(500, None), (501, "the of " * 30_000)]
    df = docs(rows).repartition(3, "doc_id")
    got, again = (sorted((r.doc_id, r.score) for r in L.score(df).collect()) for _ in range(2))
    assert got == again
    made, counts, tables = L.prepare(df)
    learned = []
    params = L.fit(made, tables)
    average = gru.average

    def watched(found):
        found = list(found)
        learned.append(sum(n for n, _ in found))
        return average(found)

    monkeypatch.setattr(gru, "average", watched)
    assert all((v == params[k]).all() for k, v in L.fit(made, tables).items())
    assert sum(learned) == tables.n and len(learned) == L.ROUNDS, "every training token once"
    c = {r["word"]: r["count"] for r in counts.collect()}
    index = {w: i for i, (w, _) in enumerate(L.frequent_words(counts, L.FREQUENT)[:WORDS])}
    outside = Counter()
    for w, n in c.items():
        if w not in index:
            outside[L.shape(w)] += n + 0.5
    of = dict(rows)
    for i, found in got:
        words = [w.decode() for w in (of[i] or "").encode().lower().split()] + [""]
        if len(words) > 1000:
            continue
        token = [index[w] if w in index else WORDS + L.shape(w) for w in words]
        want = naive_score(params, token) / math.log(10) + sum(math.log10((c.get(w, 0) + 0.5) / (outside[L.shape(w)] + 0.5)) for w in words if w not in index)
        assert found == pytest.approx(want, rel=1e-4)


def test_no_training_documents(spark, docs):
    ids = [i for i in range(60) if held_out(i)][:3]
    got = L.score(docs([(i, "a b") for i in ids])).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0)] * 3
    assert all(math.isfinite(r.base_score) and math.isfinite(r.score) for r in got)
    assert L.score(docs([])).count() == 0


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", c) for i, c in enumerate([9, 9, 5, 5, 5, 1])], "word string, count long")
    assert [c for _, c in L.frequent_words(counts, 4)] == [9, 9]
    assert [c for _, c in L.frequent_words(counts, 5)] == [9, 9, 5, 5, 5]
    assert L.frequent_words(counts, 1) == []
