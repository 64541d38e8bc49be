"""Queries with SQL against it, the others' shapes, and the stages of the pipeline, on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from plazaflow.llm.queries import ORACLE_SQL, QUERIES
from plazaflow.session import table
from tests.test_queries import DATA, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize(("name", "of"), [("op1_token_blocks", "documents"), ("op3_byte_bpe", "documents"), ("op4_simhash", "documents"), ("op5_quality", "documents"), ("op8_html_text", "pages"), ("op9_lm_score", "documents")])
def test_a_row_for_each_row(spark, name, of):
    assert QUERIES[name](spark, DATA).count() == table(spark, DATA, of).count()


def test_stages_chain(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 3:
            assert docs.columns == columns and 0 < docs.count() < n
            n = docs.count()
    assert docs.count() == n and set(columns) < set(docs.columns)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_on_empty_documents(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_the_pipeline_equals_brute_force(spark):
    import hashlib

    import public_tokenizers as P
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from plazaflow.llm.quality import QUANTILE
    from tests.llm.test_decontaminate import slow
    from tests.llm.test_quality import slow_classify

    docs = {r.doc_id: (r.text, r.lang) for r in table(spark, DATA, "documents").collect()}
    labels = [tuple(r) for r in table(spark, DATA, "labels").select("doc_id", "quality", "toxic").collect()]
    kept = [i for i, x in slow_classify([(i, *x) for i, x in docs.items()], labels, QUANTILE).items() if x[3]]
    assert 0 < len(kept) < len(docs)

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(docs[i][0]) for i in kept}, {i: i for i in kept}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(kept):
        for j in sorted(kept):
            either = sets[i] | sets[j]
            if j < i and (not either or len(sets[i] & sets[j]) >= 0.8 * len(either)):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    kept = [i for i in kept if root[i] == i]
    items = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    clean = [r[0] for r in slow([(i, docs[i][0]) for i in kept], items) if not r[5]]
    assert len(clean) < len(kept)
    encoder = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i in clean:
        ids = encoder.encode_ordinary(docs[i][0] or "")
        want[i] = ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), docs[i][0] or ""
    got = {r.doc_id: (r.ids, r.ids_sha256, r.text) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want
