import pytest

from plazaflow.llm.sharding import ShardTable, Sizes, shard

SMALL = Sizes(target=60_000, smallest=2_000, growth=4, full=3, arrival_rows=20)


def bag(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def filled(docs, n, start=0):
    import random

    rng = random.Random(start)
    return docs([(i if i % 9 else None, None if i % 7 == 0 else f"{i} " + " ".join(str(rng.random()) for _ in range(40))) for i in range(start, start + n)])


def test_nothing_is_lost_and_shards_grow(spark, docs, tmp_path):
    df = filled(docs, 500).repartition(4)
    t = shard(df, str(tmp_path / "t"), SMALL)
    assert bag(t.read()) == bag(df)
    shards = t.manifest().collect()
    assert len(shards) < 500 / SMALL.arrival_rows and not t.full_tiers()
    assert sum(r["rows"] for r in shards) == 500


def test_versions_are_whole_and_stay(spark, docs, tmp_path):
    t = ShardTable(spark, str(tmp_path / "t"), SMALL)
    assert t.versions() == [] and t.manifest().count() == 0
    a, b = filled(docs, 60), filled(docs, 40, 1000)
    assert (t.append(a), t.append(b)) == (1, 2)
    assert bag(t.read(1)) == bag(a) and bag(t.read()) == bag(a.unionAll(b))
    while t.full_tiers():
        assert t.compact()
    assert bag(t.read(1)) == bag(a), "a version can be read until it is vacuumed"
    assert t.vacuum() > 0
    assert len(t.versions()) == 1 and bag(t.read()) == bag(a.unionAll(b))


def test_two_writers_of_one_version(spark, docs, tmp_path):
    t = ShardTable(spark, str(tmp_path / "t"), SMALL)
    t.append(filled(docs, 10))
    late = t.manifest()
    t.append(filled(docs, 10, 50))
    assert not t._commit(1, late)
    assert t.versions() == [1, 2] and t.read().count() == 20


def test_compaction_gives_way_when_its_shards_are_gone(spark, docs, tmp_path, monkeypatch):
    t = ShardTable(spark, str(tmp_path / "t"), SMALL)
    for k in range(4):
        t.append(filled(docs, 10, 100 * k))
    other = ShardTable(spark, str(tmp_path / "t"), SMALL)
    real = t._shards

    def meanwhile(folder):
        monkeypatch.setattr(t, "_shards", real)
        assert other.compact()
        return real(folder)

    monkeypatch.setattr(t, "_shards", meanwhile)
    assert t.compact() is None and t.read().count() == 40


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, docs, tmp_path, n):
    df = filled(docs, n)
    assert bag(shard(df, str(tmp_path / "t"), SMALL).read()) == bag(df)


def test_rows_without_a_version_are_not_there(spark, docs, tmp_path):
    t = ShardTable(spark, str(tmp_path / "t"), SMALL)
    t.append(filled(docs, 10))
    filled(docs, 10).write.parquet(str(tmp_path / "t" / "data" / "orphan"))
    assert t.read().count() == 10


def test_the_query_has_the_default_sizes(docs, spark, monkeypatch, tmp_path):
    from plazaflow.llm import sharding

    docs([(1, "a")]).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []

    def shard_(df, root, sizes=Sizes()):  # noqa: B008
        seen.append(sizes)
        return shard(df, root, sizes)

    monkeypatch.setattr(sharding, "shard", shard_)
    assert sharding.op7_sharding(spark, str(tmp_path)).count() == 1 and seen == [Sizes()]


def test_columns_of_later_arrivals_stay(spark, tmp_path):
    t = ShardTable(spark, str(tmp_path / "t"), Sizes(target=60_000, smallest=2_000, growth=4, full=2, arrival_rows=20))
    t.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    t.append(spark.createDataFrame([(2, "b", "x")], "doc_id long, text string, extra string"))
    t.append(spark.createDataFrame([("y", 3)], "extra string, doc_id long"))
    want = [("1", "a", "None"), ("2", "b", "x"), ("3", "None", "y")]
    assert t.read().columns == ["doc_id", "text", "extra"] and bag(t.read()) == want
    assert t.read(1).columns == ["doc_id", "text"]
    assert t.compact()
    t.vacuum()
    assert bag(t.read()) == want, "merged shards keep every column"


def test_columns_that_do_not_fit_are_refused(spark, tmp_path):
    t = ShardTable(spark, str(tmp_path / "t"), SMALL)
    t.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    for bad in ("doc_id string", "doc_id long, TEXT string"):
        with pytest.raises(ValueError):
            t.append(spark.createDataFrame([], bad))
    assert t.versions() == [1]


def test_names_of_our_own_and_very_long_texts(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "word " * 400_000, 7, None), ("p", 1, "", None, "q"), (None, None, None, None, None)], "path string, bytes long, text string, tier int, rows string")
    t = shard(df.unionAll(df), str(tmp_path / "t"), Sizes(target=60_000, smallest=500, growth=4, full=2, arrival_rows=1))
    assert bag(t.read()) == bag(df.unionAll(df))


def test_shard_keeps_older_versions_and_vacuum_keeps_as_many_as_asked(spark, docs, tmp_path):
    lots = [filled(docs, n, 1000 * n) for n in (10, 60, 200)]
    for df in lots:
        t = shard(df, str(tmp_path / "t"), SMALL)
    first = bag(lots[0])
    assert bag(t.read(1)) == first and len(t.versions()) > 3
    t.vacuum(keep=2)
    assert len(t.versions()) == 2 and bag(t.read()) == bag(lots[0].unionAll(lots[1]).unionAll(lots[2])) and t.read(t.versions()[0]).count() == 270
