import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plazaflow.llm import simhash as S


def slow_fingerprint(text, k=4):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, bits=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    while True:
        after = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= bits) for i in range(len(rows))]
        if after == label:
            break
        label = after
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, label, strict=True)), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBcÀ \t\x0b\x1c é", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(S.shingle_hashes(text, 4)) == slow_fingerprint(text)


@pytest.mark.parametrize("bits", [4, 5, 7, 9])
def test_near_points_share_an_anchor_that_one_owns(bits):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for i in range(1, len(x), 2):
        x[i] = x[i - 1]
        for b in rng.choice(64, rng.integers(1, bits + 1), replace=False):
            x[i] ^= np.uint64(1 << int(b))
    index, key, owner = S.anchors(x, bits)
    at = {}
    for i, k, o in zip(index, key, owner, strict=True):
        at.setdefault(int(i), {})[int(k)] = bool(o)
    for i in range(1, len(x), 2):
        both = at[i].keys() & at[i - 1].keys()
        assert any(at[i][k] for k in both) and any(at[i - 1][k] for k in both)
    assert owner.sum() == len(x) * len(S.blocks_for(bits))


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 200]))]
        for _ in range(rng.choice([1, 1, 4, 9])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1000, " ".join(copy).upper()))
    return rows + [(None, "w1 w2"), (5000, None), (4999, ""), (5001, " \n"), (None, rows[0][1]), rows[3], rows[3]]


@pytest.mark.parametrize("group", [S.GROUP, 8])
def test_components_equal_brute_force(spark, docs, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)  # 8: anchors are cut into chunks
    rows = [*corpus(), (6000, "Long text " * 50_000 + "a"), (6001, "long text " * 50_000 + "b")]
    got = sorted((tuple(r) for r in S.near_duplicates(docs(rows).withColumnRenamed("source", "fp").repartition(3)).collect()), key=repr)
    assert got == slow_components(rows)


def test_forest_of_pairs_is_enough(spark):
    edges = [(i + 1, i) for i in range(200)] + [(500, 300), (400, 300), (500, 400), (7, 7)]
    got = dict(tuple(r) for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 201)} | {400: 300, 500: 300}


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_sketches_let_similar_sets_through_and_few_others():
    rng = np.random.default_rng(3)
    for n in (1, 4, 20, 90, 400, 3000):
        passed = 0
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            gone = int(rng.integers(0, n // 9 + 1))  # as many are exchanged: a similarity of 0.8 at least
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**64, gone, dtype=np.uint64)]))
            c = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            low, high = (np.array(x, np.uint64) for x in zip(*map(S.sketch, (a, b, c)), strict=True))
            alike = S.Alike(0.8, np.array([len(a), len(b), len(c)]), low, high)
            assert alike(0, 1) and alike(0, 0)
            passed += bool(alike(0, np.array([2]))[0])
        assert passed <= (60 if n < 4 else 3)
    assert S.sketch(np.zeros(0, np.uint64)) == (0, 0)


def test_sweep_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 400, 120)
    compared = []

    def near(i, others):
        compared.append(len(others))
        return np.abs(x[others] - x[i]) <= 2

    label = np.arange(len(x))
    for i, found in S.sweep(len(x), near):
        label = S.forest(np.full(len(found), i), found, label)
    order = np.argsort(x, kind="stable")
    want = np.zeros(len(x), int)
    want[order] = np.cumsum(np.concatenate([[0], np.diff(x[order]) > 2]))
    assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want))
    owner = rng.random(len(x)) < 0.3
    label = np.arange(len(x))
    for i, found in S.sweep(len(x), near, owner):
        assert owner[i] or owner[found].all()
        label = S.forest(np.full(len(found), i), found, label)
    slow = np.arange(len(x))
    for i in range(len(x)):
        others = np.flatnonzero((np.abs(x - x[i]) <= 2) & (owner[i] | owner))
        slow = S.forest(np.full(len(others), i), others, slow)
    assert (label == slow).all()
    x = np.zeros(5000)
    compared.clear()
    list(S.sweep(len(x), near))
    assert sum(compared) < 15_000, "copies are not compared with one another"


def test_deduplicate(spark, docs):
    rng = random.Random(4)
    base = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(300)) for _ in range(6)]
    near = base[0].replace(base[0].split()[150], "other")
    rows = [(10, base[0]), (3, base[0]), (4, near), (5, base[1]), (6, base[2]), (None, base[3]), (8, None), (9, ""), (7, base[4]), (7, base[4]), (7, base[5])]
    df = docs(rows).withColumnRenamed("source", "_tie").withColumnRenamed("lang", "_id")
    got = S.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([3, 5, 6, None, 8, 7, 7], key=repr)
    assert S.deduplicate(docs([])).count() == 0 and S.near_duplicates(docs([])).count() == 0


def test_unlike_texts_of_near_fingerprints_stay(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "fingerprint", lambda h: len(h) % 2)  # all within one bit
    rows = [(i, " ".join(f"{i}-{j}" for j in range(60 + i))) for i in range(5)]
    assert S.deduplicate(docs(rows).coalesce(1)).count() == 5


def slow_keepers(rows, least=0.8):
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= least:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted(rows[i][0] for i in range(len(rows)) if top(i) == i)


@pytest.mark.parametrize(("shingles", "seen", "meeting"), [(1 << 17, 1 << 19, 1 << 18), (500, 5, 4)])
def test_deduplicate_equals_brute_force(spark, docs, monkeypatch, shingles, seen, meeting):
    monkeypatch.setattr(S, "SHINGLES", shingles)  # 500: components are cut into chunks
    monkeypatch.setattr(S, "SEEN", seen)
    monkeypatch.setattr(S, "MEETING", meeting)  # 4: so are texts that meet at a shingle
    rng = random.Random(5)
    rows = []
    for _ in range(25):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([6, 14, 50, 300]))]
        for _ in range(rng.choice([1, 3, 6, 12])):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 30)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                copy += [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(1 + len(words) // 4))]
            rows.append((len(rows), " ".join(copy)))
    far = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8 and (slow_fingerprint(rows[i][1], 5) ^ slow_fingerprint(rows[j][1], 5)).bit_count() > 7]
    assert far
    rows += [(900 + i, " ".join(words[:40] + [f"p{rng.randrange(10**6)}" for _ in range(20)])) for i in range(150)]  # a passage that many share
    assert sorted(r.doc_id for r in S.deduplicate(docs(rows).repartition(3)).collect()) == slow_keepers(rows)


def test_hot_groups_are_found_whole(spark, docs):
    rng = random.Random(8)
    words = [f"v{rng.randrange(10**6)}" for _ in range(100)]
    rows = [(i, " ".join(w if j != i % 100 else f"n{i}" for j, w in enumerate(words))) for i in range(400)] + [(1000 + i, " ".join(words)) for i in range(300)]
    rows += [(2000, "very " * 60_000 + "long"), (2001, "very " * 60_000 + "long"), (2002, "short text"), (2003, "short text"), (2004, None), (2005, " ")]
    got = S.deduplicate(docs(rows).repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == [0, 2000, 2002, 2004]


def test_counts_reach_the_driver_once_in_small_rows(spark, docs, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(f"v{rng.randrange(50)}" for _ in range(30 + i))) for i in range(40)]
    df = docs(rows).repartition(8)
    got, collect = [], type(df).collect

    def watched(self):
        out = collect(self)
        got.extend(x for r in out for x in r if isinstance(x, (bytes, bytearray)))
        return out

    shipped, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(df), "collect", watched)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: shipped.append(x) or broadcast(self, x))
    S.deduplicate(df)
    assert sum(map(len, got)) == 8 * S.BUCKETS and max(map(len, got)) < 1 << 18
    every = np.concatenate([S.shingle_set(S.shingle_hashes(t, 5)) for _, t in rows])
    assert np.array_equal(shipped[0], np.bincount((every % np.uint64(S.BUCKETS)).astype(np.int64), minlength=S.BUCKETS))
