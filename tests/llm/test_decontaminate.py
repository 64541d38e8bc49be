import hashlib
import random
import re

import pytest

from plazaflow.llm import decontaminate as D


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(rows, items):
    windows = {}
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = tokens(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if k + n <= len(w) and (got := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= {x for x in got if x is not None}
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(2)
    vocabulary = ["of", "the", "ÜBER", "it's", "naïve", "x_y", "1,000", "end.", "漢字", "A\\b"] + [f"w{i}" for i in range(20)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([25, 10, 11, 4, 40, 9])]
    items += [(77, items[0][1]), (None, items[1][1]), (8, None), (9, " .,; "), (10, "'quoted' words here now")]
    rows = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            piece = re.split(r"\s+", rng.choice(items[:6])[1])
            at = rng.randint(0, len(w))
            w[at:at] = piece[rng.randint(0, 3) :]
        rows.append((i, rng.choice([" ", "\n", " - "]).join(w)))
    rows += [(504, "w1 " * 30_000 + items[0][1] + " w2" * 30_000)]
    rows += [(None, None), (500, ""), (501, "..."), (502, "'Quoted', WORDS here... now"), rows[3], rows[3], (503, "xquoted words here now")]
    return rows, items


@pytest.mark.parametrize(("most", "hashes"), [(D.MOST_WINDOWS, D.MOST_HASHES), (0, D.MOST_HASHES), (0, 0)])
def test_report_equals_brute_force(spark, docs, monkeypatch, most, hashes):
    monkeypatch.setattr(D, "MOST_WINDOWS", most)  # 0: by joins
    monkeypatch.setattr(D, "MOST_HASHES", hashes)  # 0: by a shuffle
    rows, items = corpus()
    got = sorted((tuple(r) for r in D.report(docs(rows).withColumnRenamed("source", "window").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == slow(rows, items)


def test_one_word_items(spark, docs):
    items = [(1, "Secret"), (2, "two words")]
    rows = [(1, "a secret!"), (2, "secrets"), (3, "Two, words"), (4, "two")]
    assert sorted(tuple(r) for r in D.report(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()) == slow(rows, items)


@pytest.mark.parametrize("most", [D.MOST_WINDOWS, 0])
def test_documents_go(spark, docs, monkeypatch, most):
    monkeypatch.setattr(D, "MOST_WINDOWS", most)
    rows, items = corpus()
    df = docs(rows).withColumnRenamed("source", "_row")
    got = D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == df.columns
    assert sorted((repr(r.doc_id) for r in got.collect())) == sorted(repr(r[0]) for r in slow(rows, items) if not r[5])


def test_spans_go_and_the_rest_stays(spark, docs):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(docs(rows), bench, remove="spans")
    assert got.columns == docs(rows).columns
    texts = {r.doc_id: r.text for r in got.collect()}
    for i, t in rows:
        if not slow([(i, t)], items)[0][5]:
            assert texts[i] == t
    exact = D.decontaminate(docs([(1, "Keep this! 'Quoted', WORDS here... now, and (that).")]), bench, remove="spans").first().text
    assert exact == "Keep this! ' , and (that)."


def test_empty_sides(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.report(docs([(1, "a")]), none).collect()] == [False]
    assert D.decontaminate(docs([(1, "a"), (2, None)]), none).count() == 2
    assert D.report(docs([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_no_python_on_the_main_path(spark, docs):
    plan = D.decontaminate(docs([(1, "a")]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def slow_cut(text, items):
    """The text without the words of hits, a blank for each run of them."""
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    w, hit = tokens(text), set()
    for _, t in items:
        x = tokens(t)
        for k in range(max(1, len(x) - 9) if x else 0):
            y = x[k : k + 10]
            for i in range(len(w) - len(y) + 1):
                if w[i : i + len(y)] == y:
                    hit |= set(range(i, i + len(y)))
    if not hit:
        return text
    out, at, i = [], 0, 0
    while i < len(w):
        if i in hit:
            out.append(text[at : spans[i][0]] + " ")
            while i + 1 in hit:
                i += 1
            at = spans[i][1]
        i += 1
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("most", [D.MOST_WINDOWS, 0])
def test_spans_equal_brute_force(spark, docs, monkeypatch, most):
    monkeypatch.setattr(D, "MOST_WINDOWS", most)
    rows, items = corpus()
    items += [(90, " ".join(f"k{i}" for i in range(10))), (91, "b c")]
    rows += [(700, "a b " + " ".join(f"k{i}" for i in range(10)) + " c d B, c"), (701, "b c"), (702, "x b c"), (703, "B-C b c...")]
    got = D.decontaminate(docs(rows).withColumnRenamed("source", "_h").repartition(3), spark.createDataFrame(items, "item_id long, text string"), remove="spans")
    assert got.columns == ["doc_id", "text", "lang", "_h", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((i, slow_cut(t, items)) for i, t in rows), key=repr)


def test_spans_of_long_texts_take_linear_time(spark, docs):
    import time

    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    took = []
    for n in (2_000, 64_000):
        text = " ".join("one two three" if i % 4 == 0 else f"w{i}" for i in range(n))
        began = time.monotonic()
        [r] = D.decontaminate(docs([(1, text)]), items, remove="spans").collect()
        took.append(time.monotonic() - began)
        assert r.text.split() == [f"w{i}" for i in range(n) if i % 4]
    assert took[1] < 60, took
    empty = D.decontaminate(docs([]), items, remove="spans")
    assert empty.count() == 0 and D.decontaminate(docs([(1, "one two three")]), items.limit(0), remove="spans").first().text == "one two three"
