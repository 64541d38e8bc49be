import numpy as np
import pytest
from pyspark.sql import functions as F

from plazaflow.llm import topk as K


def slow(rows, k):
    ok = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(np.int64), n) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in ok), default=0)
    ok = [(i, np.pad(v, (0, width - len(v))), n) for i, v, n in ok]
    out = []
    for q, v, n in ok:
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w, m in ok if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, row string")


@pytest.mark.parametrize(("shard", "block"), [(10**6, 10**6), (70, 5)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(K, "LEAF", 16)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] + 0.2 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # equal vectors: ties by id
    rows += [(2000, None), (2020, [None] * 12), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12), (2080, [1.0, -2.0]), (2100, []), (20, rows[20][1]), (None, rows[0][1])]
    got = sorted(tuple(r) for r in K.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, 20, shard, block).collect())
    assert got == slow(rows, 20)


def test_large_numbers_are_exact(spark):
    rows = [(0, [2.0**24, 1.0]), (1, [2.0**24, 1.0]), (2, [2.0**24, 0.5]), (3, [-(2.0**24), 2.0])]
    got = sorted(tuple(r) for r in K.top_k(table(spark, rows), F.col("vec_id") == 0, 5).collect())
    assert got == [(0, 1, 1, 2**60 + 4096), (0, 2, 2, 2**60 + 2048), (0, 3, 3, -(2**60) + 8192)]


def test_few_and_none(spark):
    assert K.top_k(table(spark, []), F.lit(True)).count() == 0
    assert K.top_k(table(spark, [(0, [1.0])]), F.lit(True)).count() == 0
    assert K.top_k(table(spark, [(0, [1.0]), (1, [1.0])]), F.lit(True), 20).count() == 2


def test_bounds_hide_no_leaf():
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (3000, 6))
    q = x[:40]
    found = K.search(K.Shard.of(x, np.arange(3000), np.arange(3000)), q, np.arange(40), 7, np.full(40, -np.inf))
    score = q @ x.T
    for i, (s, ids) in enumerate(found):
        score[i, i] = -(10**9)
        want = np.lexsort((np.arange(3000), -score[i]))[:7]
        assert (ids == want).all() and (s == score[i][want]).all()


def test_every_node_holds_its_rows():
    x = np.random.default_rng(3).normal(size=(777, 3))
    t = K.BallTree(x)
    assert sorted(t.order) == list(range(777)) and (t.lo[0], t.hi[0]) == (0, 777)
    leaves = t.left < 0
    assert (t.hi - t.lo)[leaves].sum() == 777 and (t.hi - t.lo)[leaves].max() <= K.LEAF
    for n in np.flatnonzero(~leaves):
        assert (t.lo[t.left[n]], t.hi[t.left[n]], t.hi[t.right[n]]) == (t.lo[n], t.lo[t.right[n]], t.hi[n])
    for a, b, c, r in zip(t.lo, t.hi, t.centre, t.radius, strict=True):
        assert (np.sqrt(((x[t.order[a:b]] - c) ** 2).sum(axis=1)) <= r + 1e-9).all()


def test_inner_nodes_prune(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 16)) * 40
    x = (centres[np.arange(40_000) % 64] + rng.normal(size=(40_000, 16))).round().astype(np.int64)
    shard = K.Shard.of(x, np.arange(len(x)), np.arange(len(x)))
    seen = []
    offer = K.Best.offer
    monkeypatch.setattr(K.Best, "offer", lambda self, *a: (seen.append(1), offer(self, *a)))
    [(s, ids)] = K.search(shard, x[:1], np.zeros(1, np.int64), 5, np.full(1, -np.inf))
    score = x @ x[0]
    score[0] = -(10**9)
    want = np.lexsort((np.arange(len(x)), -score))[:5]
    assert (ids == want).all() and (s == score[want]).all()
    assert len(seen) < (shard.left < 0).sum() / 4


def test_shards_come_back():
    rng = np.random.default_rng(5)
    for most in (100, 30_000, 2**31, 2**40):
        a = K.Shard.of(rng.integers(-most, most, (300, 4)), np.arange(300), np.arange(300) + 7)
        b = K.Shard.unpacked(4, a.packed())
        assert all((getattr(a, n) == getattr(b, n)).all() for n in K.ARRAYS)
    assert K.Shard.unpacked(0, K.Shard.of(np.zeros((3, 0), np.int64), np.arange(3), np.arange(3)).packed()).x.shape == (3, 0)


def test_many_shards_share_their_scores(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(600)]
    got = sorted(tuple(r) for r in K.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, 20, 40, 7).collect())
    assert got == slow(rows, 20)
