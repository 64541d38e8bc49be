import json

import pytest
from pyspark.sql import functions as F

from plazaflow.plans import collection, surveys
from plazaflow.sources import dumps, http, tables
from plazaflow.streaming.ingest import ingest, live_counts

JAN = 1_704_067_200


def line(i, sub="Memes", ts=JAN + 30 * 86400, **more):
    return json.dumps({"id": i, "subreddit": sub, "created_utc": ts, **more})


def test_dump_with_a_long_window(spark, tmp_path):
    path = str(tmp_path / "RC_2024-01.zst")
    dumps.write_dump(path, [line(1, score="12.7"), "{bad", line(2, "other", crosspost=[{"subreddit": "memes"}]), line(3, "MEMES"), line(4)], last_newline=False, window_log=31)
    lines = dumps.read_dumps(spark, [path])
    assert lines.count() == 5 and dumps.read_dumps(spark, [f"file://{path}"]).count() == 5
    got = dumps.extract(lines, "comments", ["memes"]).orderBy("id").collect()
    assert [(r.id, r.subreddit, r.source, r.score) for r in got] == [("1", "Memes", "memes", 12), ("3", "MEMES", "memes", None), ("4", "Memes", "memes", None)]
    v = dumps.verdicts(lines, "comments", ["memes"]).first()
    assert (v.status, v.bad_json, v.rows_total, v.rows) == ("ok", 1, 3, {"memes": 3})


@pytest.mark.parametrize(("lines", "newline", "status"), [([line(1), '{"id": 2, "subr'], False, "truncated"), ([line(1, ts=JAN)], True, "truncated"), ([line(1)], True, "ok")])
def test_verdict(spark, tmp_path, lines, newline, status):
    path = str(tmp_path / "RS_2024-01.zst")
    dumps.write_dump(path, lines, newline)
    assert dumps.verdicts(dumps.read_dumps(spark, [path]), "submissions", ["memes"]).first().status == status


def test_extraction_is_resumable(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "comments").mkdir(parents=True)
    dumps.write_dump(str(src / "comments" / "RC_2024-01.zst"), [line(1), line(2)])
    report = collection.extract_dumps(spark, str(src), str(out), ["memes"], "2024-01", "2024-02", kind="comments").collect()
    assert [(r.file, r.status) for r in report] == [("RC_2024-02.zst", "missing_on_drive")]
    assert tables.read_records(spark, str(out / "comments"), 2024, "2024-01").count() == 2
    late = [line(3, ts=JAN + 31 * 86400 + 28 * 86400)]
    dumps.write_dump(str(src / "RC_2024-02.zst"), late)
    assert collection.extract_dumps(spark, str(src), str(out), ["memes"], "2024-01", "2024-02", kind="comments").count() == 0
    assert tables.read_records(spark, str(out / "comments")).count() == 3
    assert {r.file for r in collection.manifest(spark, str(out)).collect()} == {"RC_2024-01.zst", "RC_2024-02.zst"}


def test_limited_scan(spark, tmp_path):
    path = str(tmp_path / "RC_2024-01.zst")
    dumps.write_dump(path, [line(i) for i in range(10)])
    assert dumps.verdicts(dumps.read_dumps(spark, [path], 10), "comments", ["memes"], limited=True).first().status == "partial_test"


class Server:
    """Records a second apart, three of them in one second; answers in pages."""

    def __init__(self, fail=()):
        self.rows = [{"id": str(i), "created_utc": JAN + max(0, i - 2)} for i in range(20)]
        self.fail = list(fail)
        self.asked = []

    def __call__(self, url):
        from urllib.parse import parse_qs, urlsplit

        p = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        self.asked.append(p)
        if self.fail:
            raise self.fail.pop(0)
        found = [r for r in self.rows if int(p["after"]) <= r["created_utc"] < int(p["before"])]
        return {"data": [{"count": len(found)}] if "aggregate" in p else found[: int(p["limit"])]}


def client(server):
    waits = []
    return http.Client("http://x", server, sleep=waits.append, clock=lambda: 0.0), waits


def test_pages_give_each_record_once():
    c, _ = client(Server())
    assert [r["id"] for r in c.fetch_range("comments", "s", JAN, JAN + 100, page=4)] == [str(i) for i in range(20)]
    assert c.exact_count("comments", "s", JAN, JAN + 5) == 7


def test_client_waits_and_asks_again():
    c, waits = client(Server([http.TooManyRequests(7), OSError("down")]))
    assert len(c.get("comments/search", after=JAN, before=JAN + 3, limit=9)) == 5
    assert 7 in waits and c.requests == 3


def test_fields_are_dropped_when_refused():
    s = Server([http.BadRequest("fields")])
    c, _ = client(s)
    c.get("comments/search", after=JAN, before=JAN + 3, limit=9, fields="id")
    assert "fields" in s.asked[0] and "fields" not in s.asked[1]


def test_questions_that_take_too_long_are_made_smaller():
    class Slow(Server):
        def __call__(self, url):
            from urllib.parse import parse_qs, urlsplit

            p = {k: int(v[0]) for k, v in parse_qs(urlsplit(url).query).items() if k in ("after", "before")}
            if p["before"] - p["after"] > 3_600:
                self.asked.append(p)
                raise http.TooLong("422")
            return super().__call__(url)

    s = Slow()
    c, waits = client(s)
    assert [r["id"] for r in c.fetch_range("comments", "s", JAN, JAN + 5 * 3_600, page=7)] == [str(i) for i in range(20)]
    assert c.exact_count("comments", "s", JAN, JAN + 40 * 3_600) == 20 and set(waits) == {0.5}
    c, waits = client(Server([http.TooLong("422")] * 3))
    assert c.exact_count("comments", "s", JAN, JAN + 5) == 7 and [w for w in waits if w != 0.5] == [2.0, 4.0, 8.0]
    with pytest.raises(http.TooLong):
        client(Server([http.TooLong("422")] * 99))[0].exact_count("comments", "s", JAN, JAN + 5)
    with pytest.raises(http.TooLong):
        list(client(Server([http.TooLong("422")] * 99))[0].fetch_range("comments", "s", JAN, JAN + 5))


def test_errors_are_never_empty_pages():
    class Broken(Server):
        def __call__(self, url):
            return {"error": "internal"} if len(self.asked) < self.bad and not self.asked.append(url) else super().__call__(url.replace("x?", "x?"))

    s = Broken()
    s.bad = 99
    for ask in (lambda c: list(c.fetch_range("comments", "s", JAN, JAN + 9)), lambda c: c.exact_count("comments", "s", JAN, JAN + 9)):
        with pytest.raises(http.ServerError):
            ask(client(s)[0])
    s = Broken()
    s.bad = 2
    c, waits = client(s)
    assert c.exact_count("comments", "s", JAN, JAN + 5) == 7 and [w for w in waits if w != 0.5] == [1.0, 2.0]
    c, waits = client(Server([http.TooManyRequests(5)] * 99))
    with pytest.raises(http.TooManyRequests):
        list(c.fetch_range("comments", "s", JAN, JAN + 9))
    assert [w for w in waits if w != 0.5] == [5] * (http.TRIES - 1)


def test_rates_of_three_pages(spark):
    from plazaflow.operators.counts import estimated_counts

    c, _ = client(Server())
    assert c.page_rates("comments", "s", JAN, JAN + 30, page=5) == [(5, 2, 30), (5, 4, 30), (0, 10, 30)]
    rates = spark.createDataFrame([("s", "2024-01", *r) for r in c.page_rates("comments", "s", JAN, JAN + 30, page=5)], "subreddit string, month string, rows long, seconds long, span long")
    assert estimated_counts(rates).first().n == int((5 / 2 + 5 / 4) / 3 * 30)


def test_a_bad_dump_does_not_stop_the_others(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    end = 1_454_284_800 + 28 * 86400  # in February 2016
    dumps.write_dump(str(src / "RC_2016-02.zst"), [line(1, ts=end), line(2, ts=end)])
    (src / "RC_2016-03.zst").write_bytes(b"this is no zstd data" * 50)
    whole = tmp_path / "whole"
    dumps.write_dump(str(whole), [line(i, ts=end + 60 * 86400, body=str(i * 7919 % 10_007) * 9) for i in range(30_000)])
    (src / "RC_2016-04.zst").write_bytes(whole.read_bytes()[: whole.stat().st_size * 2 // 3])
    dumps.write_dump(str(src / "RC_2016-05.zst"), [])
    mirror = str(tmp_path / "mirror")
    report = collection.extract_dumps(spark, str(src), out, ["memes"], "2016-02", "2016-06", kind="comments", mirrors=(mirror,))
    assert {(r.month, r.status) for r in report.collect()} == {("2016-03", "error"), ("2016-04", "truncated"), ("2016-06", "missing_on_drive")}
    ledger = {r.file[3:10]: r for r in collection.manifest(spark, out).collect()}
    assert {m: r.status for m, r in ledger.items()} == {"2016-02": "ok", "2016-03": "error", "2016-04": "truncated", "2016-05": "ok"}
    assert "zstd" in ledger["2016-03"].error and ledger["2016-02"].rows_total == 2
    counts = {r.month: r["count"] for r in tables.read_records(spark, f"{out}/comments").groupBy("month").count().collect()}
    assert counts["2016-02"] == 2 and counts["2016-04"] == ledger["2016-04"].rows_total > 0 and set(counts) == {"2016-02", "2016-04"}
    assert tables.read_records(spark, f"{mirror}/comments").count() == sum(counts.values())


def test_what_a_reader_says_of_its_file(spark, tmp_path):
    path = str(tmp_path / "RC_2024-01.zst")
    dumps.write_dump(path, [line(1)] * 3)

    def said(**options):
        reader = dumps._Reader({"paths": json.dumps([path]), **options})
        return [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]

    assert [r["problem"] for r in said()] == [None] * 3
    assert said(leastseconds="-1", secondspergb="0")[-1]["problem"] == "stalled"

    class Failing:
        def __init__(self, raw):
            self.raw = raw

        def read(self, n=-1):
            raise OSError(5, "input/output error")

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.close()

        def close(self):
            self.raw.close()

    real = dumps._open
    try:
        dumps._open = lambda p: (Failing(real(p)[0]), 1)
        assert said()[-1]["problem"] == "partial"
    finally:
        dumps._open = real
    path = str(tmp_path / "RC_2024-02.zst")
    assert said()[-1]["problem"] == "source_missing"
    v = dumps.verdicts(dumps.read_dumps(spark, [path]), "comments", ["memes"]).first()
    assert v.status == "source_missing" and v.rows_total == 0


def test_only_and_skip(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for m in ("01", "02", "03"):
        dumps.write_dump(str(src / f"RC_2024-{m}.zst"), [line(1)])
    report = collection.extract_dumps(spark, str(src), out, ["memes"], "2024-01", "2024-03", kind="comments", only=("2024-01", "2024-02"), skip=("RC_2024-02.zst",))
    assert report.count() == 0 and [r.file for r in collection.manifest(spark, out).collect()] == ["RC_2024-01.zst"]


def test_saved_plans_do_not_change(spark, tmp_path):
    months = spark.createDataFrame([("comments", "s", "2024-01", "S", 1000, 10_000, 12_000, 1440)], tables.PLAN_MONTHS)
    batches = spark.createDataFrame([("comments", "s", "2024-01", 1, 0, 5, 10_100)], tables.PLAN_BATCHES)
    path = str(tmp_path / "plan")
    tables.save_plan(months, batches, path)
    tables.save_plan(months.withColumn("slot_minutes", F.lit(60).cast("long")), batches.withColumn("rows", F.lit(1).cast("long")).unionAll(batches.withColumn("batch", F.lit(2))), path)
    spark.createDataFrame([("comments", "s", "2024-01", 1, 9, 9, 9, "9999")], tables.PLAN_BATCHES + ", saved_at string").write.mode("append").json(path + "/batches")
    a, b = tables.read_plan(spark, path)
    assert [r.slot_minutes for r in a.collect()] == [1440]
    assert sorted((r.batch, r.rows) for r in b.collect()) == [(1, 10_100), (2, 10_100)]


def test_reports_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "report")
    tables.write_report(spark.range(3), path)
    with pytest.raises(ZeroDivisionError):
        tables.replaced(spark, path, lambda to: 1 / 0)
    assert spark.read.csv(path, header=True).count() == 3
    tables.write_report(spark.range(5), path)
    assert spark.read.csv(path, header=True).count() == 5 and [p.name for p in tmp_path.iterdir() if p.is_dir()] == ["report"]


def test_plan_and_batches(spark, tmp_path):
    rows = [(str(i), "s", JAN + i * 911 % (31 * 86400)) for i in range(12_000)]
    r = spark.createDataFrame(rows, "id string, subreddit string, created_utc long")
    plan = collection.plan_samples(r, "comments", "S")
    none = spark.createDataFrame([], "subreddit string, month string, batch int, start_pos long, end_pos long, rows long")
    first, entry = collection.take_batch(r, plan, none, 1)
    tables.save_plan(plan.withColumn("kind", F.lit("comments")), entry.withColumn("kind", F.lit("comments")), str(tmp_path / "plan"))
    _, saved = tables.read_plan(spark, str(tmp_path / "plan"))
    second, _ = collection.take_batch(r, plan, saved.select(none.columns), 2)
    a, b = {x.id for x in first.collect()}, {x.id for x in second.collect()}
    assert len(a) >= 10_000 and not a & b and len(a | b) == 12_000


def test_csv_and_cleaners(spark, tmp_path):
    (tmp_path / "Social_Media_Addiction.csv").write_text("age,gender,platform_usage\n20,,Insta\n20,,Insta\n,F,\n30,M,X\n")
    (tmp_path / "reels_attention_span_dataset_12000.csv").write_text("user_id,platform\n1,a\n1,b\n2,N/A\n")
    raw = {f"{k}.csv": v for k, v in tables.read_folder(spark, str(tmp_path)).items()}
    cleaned, combined = surveys.clean_all(raw)
    assert sorted((r.age, r.gender, r.platform_usage) for r in cleaned["Social_Media_Addiction.csv"].collect()) == [(20, "Unknown", "Instagram"), (30, "M", "X")]
    assert combined.count() == 4
    tables.write_csv(combined, str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 4
    with pytest.raises(KeyError):
        surveys.clean_all({"unknown.csv": combined})


def test_sleep_survey(spark):
    rows = [("1", "20", "30", "24", "yes", "night owl"), ("1", "21", "1", "1", "no", None), (None, "200", "30", "25", None, "x"), ("3", "40", "1", "10", "no", "x")]
    cols = ["Respondent ID", "Age", "Doomscroll Sessions per Night", "Avg Doomscroll Session Minutes", "Doomscroller", "Gender"]
    got = {r.respondent_id: r for r in surveys.sleep_survey(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))).collect()}
    assert len(got) == 3 and got[None].age == 30.0 and got["1"].doomscroller is True
    assert got[None].doomscroll_sessions_per_night == 15.5


def test_media_survey(spark):
    base = ["2022-04-18 19:18:47", "21", "Male", "single", "student", None, "Yes", "Facebook, X", "Between 2 and 3 hours"] + ["3"] * 12
    other = ["bad", "300", "nb", "single", "student", "Company", "No", None, "Less than an Hour"] + ["9"] * 12
    df = spark.createDataFrame([base, base, other, other[:1] + ["30"] + other[2:]], ", ".join(f"c{i} string" for i in range(21)))
    got = surveys.media_survey(df).orderBy("age").collect()
    assert len(got) == 3 and got[0].platform_facebook == 1 and got[0].avg_daily_hours_sm == 2.5
    assert {r.gender for r in got} == {"Male", "Other"}


def test_ingest_reads_a_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.jsonl").write_text(line(1) + "\n" + line(2, "other") + "\n")
    for k in range(2):
        ingest(spark, str(folder), "comments", ["memes"], out, str(tmp_path / "check"), str(tmp_path / "ledger"))
        assert spark.read.parquet(out).count() == 1 + k * 0
    (folder / "b.jsonl").write_text(line(3) + "\n")
    ingest(spark, str(folder), "comments", ["memes"], out, str(tmp_path / "check"), str(tmp_path / "ledger"))
    assert spark.read.parquet(out).count() == 2
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2


def test_live_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spark.createDataFrame([("s", JAN), ("s", JAN + 1), ("s", JAN + 7200)], "subreddit string, created_utc long").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("subreddit string, created_utc long").parquet(str(folder))
    q = live_counts(stream).writeStream.outputMode("update").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("select * from live").collect()) == [1, 2]


def test_archive_as_a_data_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            p = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            rows = [{"id": f"{p['subreddit']}{i}", "created_utc": str(JAN + i), "score": "3.9", "over_18": "1", "subreddit": p["subreddit"], "extra": 1} for i in range(250)]
            found = [r for r in rows if int(p["after"]) <= int(r["created_utc"]) < int(p["before"])]
            found = [{"count": len(found)}] if "aggregate" in p else found[: int(p["limit"])]
            body = json.dumps({"data": found}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = http.read_archive(spark, f"http://127.0.0.1:{server.server_port}", "submissions", [("a", JAN, JAN + 1000), ("b", JAN + 10, JAN + 20)], min_interval=0)
        got = df.collect()
        ranges = [("a", JAN, JAN + 1000), ("b", JAN + 10, JAN + 20)]
        counted = http.read_counts(spark, f"http://127.0.0.1:{server.server_port}", "submissions", ranges, min_interval=0).collect()
        rates = http.read_rates(spark, f"http://127.0.0.1:{server.server_port}", "submissions", ranges, min_interval=0).collect()
    finally:
        server.shutdown()
    assert {tuple(r) for r in counted} == {("a", "2024-01", 250), ("b", "2024-01", 10)}
    assert len(rates) == 6 and all(r.span in (1000, 10) for r in rates)
    assert sorted(r.id for r in got if r.subreddit == "b") == sorted(f"b{i}" for i in range(10, 20))
    assert len({r.id for r in got}) == len(got) == 260
    assert {(r.score, r.over_18, r.title) for r in got} == {(3, True, None)}


def test_totals_and_problems_are_sorted(spark, tmp_path):
    from plazaflow.operators import ledger

    rows = [("b", "2024-02", 3, "x", None, None), ("a", "2024-03", None, None, 4, "y"), ("a", "2024-01", 1, "x", 2, "y")]
    path = str(tmp_path / "totals")
    tables.write_totals(spark.createDataFrame(rows, tables.TOTALS).repartition(3), path)
    [part] = (tmp_path / "totals").glob("part-*")
    assert [x.split(",")[:2] for x in part.read_text().splitlines()[1:]] == [["a", "2024-01"], ["a", "2024-03"], ["b", "2024-02"]]
    assert sorted(map(tuple, tables.read_totals(spark, path).collect()), key=repr) == sorted(rows, key=repr)
    log = [("t2", "m", "s", "1", "error", None, "1"), ("t2", "m", "s", "1", "error", "e", "2"), ("t1", "m", "s", "1", "ok", None, "9"), ("t1", "m", "s", "1", "error", "e", "3"), ("t0", "m", "s", "1", "stalled", None, "3")]
    df = spark.createDataFrame(log, "task string, mode string, subreddit string, month string, status string, error string, finished_at string")
    assert [(r.task, r.status, r.error) for r in ledger.task_problems(df).collect()] == [("t0", "stalled", ""), ("t2", "error", "e")]
