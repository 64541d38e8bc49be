"""Benchmark decontamination in DataFrame functions only.

The benchmark's windows, normalised, are a hash set that travels with the plan (``IN`` of many
constants, which Spark evaluates as a hash set); its size is checked, and a larger benchmark is
joined instead. A document is scanned in two steps: pairs of adjacent words are looked up in the set
of the benchmark's pairs, and only a document with a long enough run of known pairs has its windows
built and looked up. The set holds the windows themselves, so that a hit is exact.

For a larger benchmark the windows of documents meet those of the benchmark by 64-bit hashes: in a broadcast hash join
up to ``MOST_HASHES`` of them, else in a shuffle in which each window of the benchmark is dealt over ``SALT`` tasks, since
one passage may be in many documents. What meets is held to the windows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import LOWER, UPPER, ascii_lower, written

#: What separates words, once letters are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows of a benchmark that travel with the plan, and characters of them; beyond either it is joined.
MOST_WINDOWS, MOST_CHARS = 50_000, 16_000_000
#: Hashes of windows that are broadcast, 16 bytes each, and parts into which the documents' windows of one hash are dealt beyond that.
MOST_HASHES, SALT = 1_000_000, 16
HITS = "array<struct<pos:int,len:int,window:string>>"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    flat = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.split(F.when(flat != "", flat), " ")  # null if there are none


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, window, len: every run of ``size`` words of an item; a shorter item is one window."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).filter("w is not null")
    return w.select("item_id", F.explode(F.expr(f"if(size(w) < {size}, array(w), transform(sequence(0, size(w) - {size}), i -> slice(w, i + 1, {size})))")).alias("w")).select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("len"))


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _small(found: DataFrame) -> list[tuple[str, int]] | None:
    """The distinct windows and their lengths, or None if they are more than travel with a plan."""
    n, chars = found.agg(F.count("*"), F.coalesce(F.sum(F.length("window")), F.lit(0))).first()
    if n > MOST_WINDOWS or chars > MOST_CHARS:
        return None
    return [tuple(r) for r in found.select("window", "len").distinct().collect()]


def with_hits(docs: DataFrame, known: list[tuple[str, int]]) -> DataFrame:
    """``docs`` and two columns, _w (its words or null) and _hits (its windows that are in ``known``)."""
    docs = docs.withColumn("_w", words(F.col("text")))
    if not known:
        return docs.withColumn("_hits", F.array().cast(HITS))
    lengths = sorted({n for _, n in known})
    if lengths[0] > 1:  # else every document may have a hit
        pairs = {(a, b) for window, _ in known for w in [window.split(" ")] for a, b in zip(w, w[1:], strict=False)}
        pairs = ",".join(sorted(_quoted(f"{a} {b}") for a, b in pairs))
        mask = f"array_join(transform(sequence(1, size(_w) - 1), i -> if(concat(_w[i - 1], ' ', _w[i]) IN ({pairs}), '1', '0')), '')"
        docs = docs.withColumn("_may", F.expr(f"size(_w) >= {lengths[0]} and contains({mask}, '{'1' * (lengths[0] - 1)}')"))
    else:
        docs = docs.withColumn("_may", F.expr("_w is not null"))
    parts = []
    for n in lengths:
        some = ",".join(sorted(_quoted(window) for window, k in known if k == n))
        parts.append(f"if(size(_w) < {n}, cast(array() as {HITS}), filter(transform(sequence(0, size(_w) - {n}), i -> named_struct('pos', i, 'len', {n}, 'window', array_join(slice(_w, i + 1, {n}), ' '))), h -> h.window IN ({some})))")
    return docs.withColumn("_hits", F.expr(f"if(_may, concat({', '.join(parts)}), cast(array() as {HITS}))")).drop("_may")


def _joined(docs: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """As ``with_hits`` for a benchmark of any size: windows of documents meet those of the benchmark in a join."""
    docs = docs.withColumn("_w", words(F.col("text"))).withColumn("_row", F.monotonically_increasing_id())
    kept = written(docs, "windows")
    known = written(found.select("window", "len").distinct(), "benchmark-windows")
    lengths = [r[0] for r in known.select("len").distinct().collect()]  # at most ``size`` of them
    each = None
    for n in lengths:
        at = kept.filter(F.size("_w") >= n).select("_row", F.expr(f"posexplode(transform(sequence(0, size(_w) - {n}), i -> xxhash64(array_join(slice(_w, i + 1, {n}), ' '))))").alias("pos", "h"))
        at = at.withColumn("len", F.lit(n))
        each = at if each is None else each.unionAll(at)
    if each is None:
        return kept.drop("_row").withColumn("_hits", F.array().cast(HITS))
    hashes = known.select(F.xxhash64("window").alias("h"), "len").distinct()
    if hashes.count() <= MOST_HASHES:
        met = each.join(F.broadcast(hashes), ["h", "len"], "left_semi")
    else:
        dealt = hashes.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = each.withColumn("s", F.pmod("_row", F.lit(SALT)).cast("int")).join(dealt, ["h", "len", "s"], "left_semi")
    met = met.groupBy("_row").agg(F.collect_list(F.struct("pos", "len")).alias("_met"))  # a document has no more hits than words and lengths
    seen = kept.select("_row", "_w").join(met, "_row").select("_row", F.explode(F.expr("transform(_met, m -> named_struct('pos', m.pos, 'len', m.len, 'window', array_join(slice(_w, m.pos + 1, m.len), ' ')))")).alias("hit"))
    seen = seen.join(known.select(F.col("window").alias("_known")), F.col("hit.window") == F.col("_known"), "left_semi")
    hits = seen.groupBy("_row").agg(F.collect_list("hit").alias("_hits"))
    return kept.join(hits, "_row", "left").drop("_row").withColumn("_hits", F.coalesce(F.col("_hits").cast(HITS), F.array().cast(HITS)))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with _w and _hits, the benchmark's windows)."""
    found = windows(benchmark, size)
    known = _small(found)
    return (_joined(docs, found, size) if known is None else with_hits(docs, known)), found


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null, empty or blank text has no words and is clean; a very long text is scanned whole; rows that repeat each get a
    row; an empty table gives an empty result and other columns are ignored; an empty
    benchmark, or one of blank items, leaves all clean; an item that repeats in the benchmark counts once
    by its item_id; items without an id make a hit but are not counted among items.
    """
    scanned, found = scan(docs.select("doc_id", "text"), benchmark, size)
    n_hit = F.expr("size(array_distinct(flatten(transform(_hits, h -> sequence(h.pos, h.pos + h.len - 1)))))")
    scanned = written(scanned.select("doc_id", F.when(F.col("_w").isNull(), 0).otherwise(F.size("_w")).cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.array_distinct("_hits.window").alias("hits")), "hits")
    scanned = scanned.withColumn("_row", F.monotonically_increasing_id())
    clean = scanned.filter("n_hit = 0").select("doc_id", "n_words", "n_hit", F.array().cast("array<string>").alias("items"))
    # a window that many items share brings each of them once; a document has no more windows than words
    owners = found.filter("item_id is not null").select("window", F.col("item_id").cast("string").alias("item")).distinct()
    hit = scanned.filter("n_hit > 0").select("_row", "doc_id", "n_words", "n_hit", F.explode("hits").alias("window"))
    hit = hit.join(owners, "window", "left").groupBy("_row", "doc_id", "n_words", "n_hit").agg(F.array_sort(F.collect_set("item")).alias("items")).drop("_row")
    both = clean.unionByName(hit)
    return both.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, remove: str = "documents") -> DataFrame:
    """``docs`` without what it shares with the benchmark.

    remove="documents": rows with a hit go, the others stay as they are. remove="spans": the words of
    each hit are cut from ``text``, with what stands between them, and a blank takes their place; hits that overlap or
    follow one another are one cut. Words are cut by their place, so equal words elsewhere stay, and the work follows the
    length of the text, however long. Null, empty and blank texts have no hit and stay; rows that repeat are each judged; an
    empty table, or an empty benchmark, changes nothing. The columns are those of ``docs``, whatever their names.
    """
    columns = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"), F.col("text"))
    scanned, _ = scan(inner, benchmark, size)
    if remove == "documents":
        # a filter would be pushed below the scan's own columns and evaluate them once for each word; it cannot pass a row number
        numbered = scanned.select("_all", "_hits", F.monotonically_increasing_id().alias("_row"))
        return numbered.filter("size(_hits) = 0 and _row >= 0").select("_all.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    word = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    # a column that a function reads for each word is named twice where it is read: Catalyst then computes it once
    last = scanned.withColumn("_h", F.expr("array_sort(_hits)"))
    last = last.withColumn("_h", F.expr("filter(_h, (h, k) -> k + 1 = size(_h) or get(_h, k + 1).pos != h.pos)"))
    # of each word the end of the longest hit that starts there, 0 if none does
    gap = "coalesce(get(_h, k + 1).pos, size(_w)) - h.pos - 1"
    ends = last.withColumn("_e", F.expr(f"if(size(_h) = 0, cast(array() as array<int>), concat(array_repeat(0, get(_h, 0).pos), flatten(transform(_h, (h, k) -> concat(array(h.pos + h.len), array_repeat(0, {gap}))))))"))
    covered = ends.withColumn("_c", F.expr(f"if(size(_e) = 0, cast(array() as array<boolean>), transform(sequence(0, size(_e) - 1), i -> exists(slice(_e, greatest(1, i + 2 - {size}), least({size}, i + 1)), e -> e > i)))"))
    parts = covered.withColumn("_v", F.expr(f"regexp_extract_all(text, '({word})', 1)")).withColumn("_s", F.expr(f"split(text, '{word}', -1)"))
    piece = "if(_c[i], if(i > 0 and _c[i - 1], '', concat(_s[i], ' ')), concat(_s[i], _v[i]))"
    cut_text = f"if(size(_hits) = 0, text, concat(array_join(transform(sequence(0, size(_v) - 1), i -> {piece}), ''), _s[size(_v)]))"
    out = parts.withColumn("_text", F.expr(cut_text))
    return out.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"_all.`{c}`").alias(c) for c in columns])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    from plazaflow.session import table

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM bw, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT r, i, dwin.n, item_id FROM dwin JOIN win ON dwin.s = win.s AND dwin.n = win.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN items USING (r)
"""
