"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of characters.

The model is trained on trusted text, a bounded sample of the documents labelled good, of all languages together: texts
quote other languages, and a model of one language alone takes that for a fault. N-gram counts, continuation
counts and the statistics of contexts are tables keyed by n-gram, dealt over the cluster and joined there. An n-gram is a
long, 21 bits a code point, so that no alphabet is cut.

Documents meet the counts in joins: the different n-grams of all documents, gathered by tasks before they are
shuffled, are joined with the tables of each order, which gives every n-gram its probability. Up to ``MOST_GRAMS``
of these probabilities are broadcast and a document adds up those of its n-grams where it stands; more are joined with the
n-grams of each document, counted before they are shuffled and dealt over ``SALT`` parts. A document's perplexity is compared
with a quantile, for its language, of the perplexities of the documents labelled good that the model has not seen.

Before it is cut into characters, a text has its white space made even, and a word that repeats the
one before it becomes one symbol of its own: trusted text has next to no runs of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import build_side, written
from plazaflow.llm.token_blocks import chunks
from plazaflow.session import ensure_importable

#: Bits of a symbol, and the symbols that are no code points: start and end. A repeated word is U+0001.
BITS = 21
START, END = 0x110000, 0x110001
#: Labelled documents that the model is trained on, at most, chosen by a hash of doc_id.
TRUSTED = 20_000
QUANTILE = 0.998
#: Discounts of the counts 1, 2 and more are no less than this: a small sample may show none, and unseen n-grams need their share.
LEAST_DISCOUNT = 0.05
#: A text's perplexity is drawn towards the mean of its language's good texts as if it had so many more symbols of that mean.
PRIOR = 300
#: Probabilities of n-grams that are broadcast, 16 bytes each, and parts into which a hot n-gram's documents are dealt beyond that.
MOST_GRAMS, SALT = 2_000_000, 16
#: Different n-grams that a task holds before it passes them on, and bytes of text that it cuts into n-grams at once.
HELD, AT_ONCE = 1_000_000, 1 << 20
#: Language of the row of the limits that holds for languages without good documents of their own, and for null.
ANY = "\0"


def marked(text: str | None) -> str:
    """The text in the form that is cut into symbols; U+0001 stands for a repeated word."""
    w = (text or "").split()
    return "".join([" " + a if a != b else "\1" for a, b in zip(w, [""] + w)])  # noqa: B905


def trigrams(text: str | None) -> np.ndarray:
    """The trigrams of a text and its end as longs; none for a text without words."""
    s = np.frombuffer(marked(text).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    if not len(s):
        return s
    s = np.concatenate([[START, START], s, [END]])
    return (s[:-2] << (2 * BITS)) | (s[1:-1] << BITS) | s[2:]


def good_rows(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled good, toxic or not: toxicity is not what this classifier judges."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def trusted_rows(labels: DataFrame, most: int) -> DataFrame:
    """doc_id of ``most`` of the documents labelled good and not toxic, by a hash of the id, but no more than about half of them: the others set the limits."""
    clean = good_rows(labels.filter(F.coalesce("toxic", F.lit(0)) == 0))
    h = F.xxhash64("doc_id")
    return clean.filter(F.pmod(h, F.lit(2)) == 0).orderBy(h, "doc_id").limit(most)


GRAMS = "code long, n long"


def gram_counts(texts: DataFrame) -> DataFrame:
    """(code, n) of the trigrams of ``texts(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in chunks(batches, AT_ONCE):
            code, n = np.unique(np.concatenate([trigrams(t) for t in b.column("text").to_pylist()]), return_counts=True)
            both, of = np.unique(np.concatenate([held, code]), return_inverse=True)
            held, count = both, np.bincount(of, np.concatenate([count, n]), len(both)).astype(np.int64)
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count)], names=["code", "n"])
                held, count = held[:0], count[:0]
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count)], names=["code", "n"])

    return texts.select("text").mapInArrow(run, GRAMS).groupBy("code").agg(F.sum("n").alias("n"))


def _tail(code: Column, symbols: int) -> Column:
    """The last symbols of an n-gram."""
    return code.bitwiseAND((1 << (BITS * symbols)) - 1)


def _discounted(counts: DataFrame) -> DataFrame:
    """``counts(code, n)`` with d, the discount of each n."""
    n1, n2, n3, n4 = counts.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d1, d2, d3 = [min(max(LEAST_DISCOUNT, i - (i + 1) * y * after / here), float(i)) if here else LEAST_DISCOUNT for i, here, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return counts.withColumn("d", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))


@dataclass(frozen=True)
class Model:
    """Tables by n-gram: probabilities p1, p2 and p3 of n-grams seen, weights g2 and g3 of the lower order by context; and root, the probability of an unseen symbol."""

    p1: DataFrame
    p2: DataFrame
    p3: DataFrame
    g2: DataFrame
    g3: DataFrame
    root: float

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """``grams(code)`` and lp, the natural logarithm of the probability of the last symbol after the two before it."""

        def met(rows: DataFrame, table: DataFrame, key: Column) -> DataFrame:
            return rows.withColumn("key", key).join(table.withColumnRenamed("code", "key"), "key", "left").drop("key")

        code = F.col("code")
        rows = met(met(met(grams, self.p3, code), self.g3, F.shiftright(code, BITS)), self.p2, _tail(code, 2))
        rows = met(met(rows, self.g2, F.shiftright(_tail(code, 2), BITS)), self.p1, _tail(code, 1))
        one = F.lit(1.0)
        two = F.coalesce("p2", F.coalesce("g2", one) * F.coalesce("p1", F.lit(self.root)))
        return rows.select("code", F.ln(F.coalesce(F.col("p3"), F.coalesce("g3", one) * two)).alias("lp"))


def train(texts: DataFrame) -> Model | None:
    """The model of ``texts(text)``; None if there are none with words."""
    ensure_importable(texts.sparkSession)
    c3 = written(gram_counts(texts), "grams-3")
    c2 = written(c3.groupBy(_tail(F.col("code"), 2).alias("code")).agg(F.count("*").alias("n")), "grams-2")
    c1 = written(c2.groupBy(_tail(F.col("code"), 1).alias("code")).agg(F.count("*").alias("n")), "grams-1")
    share = [F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("g")]
    left = (F.col("n") - F.col("d")) / F.col("total")
    d1, d2, d3 = (_discounted(c) for c in (c1, c2, c3))
    total, g, symbols = d1.agg(*share, F.count("*")).first()
    if not symbols:
        return None
    root = g / (symbols + 1)
    s2, s3 = (written(d.groupBy(F.shiftright("code", BITS).alias("ctx")).agg(*share), "contexts") for d in (d2, d3))
    p1 = written(d1.select("code", ((F.col("n") - F.col("d")) / total + root).alias("p1")), "p1")

    def seen(d: DataFrame, s: DataFrame, lower: DataFrame, symbols: int) -> DataFrame:
        rows = d.withColumn("ctx", F.shiftright("code", BITS)).join(s, "ctx").withColumn("key", _tail(F.col("code"), symbols - 1))
        rows = rows.join(lower.select(F.col("code").alias("key"), F.col(f"p{symbols - 1}").alias("lower")), "key")
        return written(rows.select("code", (left + F.col("g") * F.col("lower")).alias(f"p{symbols}")), f"p{symbols}")

    p2 = seen(d2, s2, p1, 2)
    p3 = seen(d3, s3, p2, 3)
    g2, g3 = (s.select(F.col("ctx").alias("code"), F.col("g").alias(name)) for s, name in ((s2, "g2"), (s3, "g3")))
    return Model(p1, p2, p3, g2, g3, root)


class Table:
    """Logarithms by n-gram in flat arrays: open addressing, a quarter full at most."""

    def __init__(self, code: np.ndarray, lp: np.ndarray):
        bits = max(4, (4 * len(code)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.value = np.zeros(1 << bits)
        at, left = self._slot(code), np.arange(len(code))
        while len(left):
            free = left[self.key[at[left]] < 0]
            self.key[at[free]] = code[free]  # of several that want a slot the last gets it
            left = left[self.key[at[left]] != code[left]]
            at[left] = (at[left] + 1) & self.mask
        self.value[at] = lp

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        """Of n-grams that are all in the table."""
        at = self._slot(code)
        left = np.flatnonzero(self.key[at] != code)
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            left = left[self.key[at[left]] != code[left]]
        return self.value[at]


@dataclass(frozen=True)
class Scorer:
    """Scores documents of the table that it was made for. grams: (code, lp) of all their n-grams; shipped: the same for workers, or None if they are too many."""

    grams: DataFrame
    shipped: object | None

    def __call__(self, docs: DataFrame, carried: list[str]) -> DataFrame:
        """The columns ``carried`` of ``docs(text, ...)``, whose text is taken off, with nll and n_symbols of each row."""
        schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carried)
        rows = docs.select(*carried, F.col("text").alias("_text"))
        return self._broadcast(rows, carried, schema) if self.shipped else self._joined(rows, carried, schema)

    def _broadcast(self, rows: DataFrame, carried: list[str], schema: str) -> DataFrame:
        shipped = self.shipped

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, lp = shipped.value
            table = Table(np.frombuffer(code, np.int64), np.frombuffer(lp))
            for b in chunks(batches, AT_ONCE):
                codes = [trigrams(t) for t in b.column("_text").to_pylist()]
                nll = [-float(table(c).sum()) if len(c) else 0.0 for c in codes]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(nll, pa.float64()), pa.array(map(len, codes), pa.int64())], names=[*carried, "nll", "n_symbols"])

        return rows.mapInArrow(run, schema + "nll double, n_symbols long")

    def _joined(self, rows: DataFrame, carried: list[str], schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            row = TaskContext.get().partitionId() << 40
            for b in chunks(batches, AT_ONCE):
                found = [np.unique(trigrams(t), return_counts=True) for t in b.column("_text").to_pylist()]
                ends = pa.array(np.cumsum([0, *(len(c) for c, _ in found)]).astype(np.int32))
                code, n = (np.concatenate(v) for v in zip(*found, strict=True))
                grams = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(np.arange(row, row + b.num_rows)), pa.array([int(x.sum()) for _, x in found], pa.int64()), grams], names=[*carried, "_row", "n_symbols", "_grams"])
                row += b.num_rows

        counted = written(rows.mapInArrow(run, schema + "_row long, n_symbols long, _grams array<struct<code:long,n:long>>"), "document-grams")
        each = counted.select("_row", F.explode("_grams").alias("g")).select("_row", "g.code", "g.n", F.pmod("_row", F.lit(SALT)).cast("int").alias("s"))
        dealt = self.grams.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        sums = each.join(dealt, ["code", "s"]).groupBy("_row").agg((-F.sum(F.col("n") * F.col("lp"))).alias("nll"))
        return counted.join(sums, "_row", "left").select(*carried, F.coalesce("nll", F.lit(0.0)).alias("nll"), "n_symbols")


def scorer(docs: DataFrame, model: Model, most: int | None = None) -> Scorer:
    """What scores the rows of ``docs(text)``: the different n-grams of all of them with their probabilities."""
    grams = written(model.probabilities(gram_counts(docs).select("code")), "probabilities")
    shipped = None
    if grams.count() <= (MOST_GRAMS if most is None else most):
        found = grams.toArrow()
        shipped = docs.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy().tobytes() for c in ("code", "lp")))
    return Scorer(grams, shipped)


def _perplexity(mean: Column) -> Column:
    return F.exp((F.col("nll") + PRIOR * mean) / (F.col("n_symbols") + PRIOR))


def limits(good: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, mean (nll a symbol) and threshold over ``good(lang, nll, n_symbols)``, documents labelled good; one row, ``ANY``, over those of all languages.

    Means and quantiles are aggregated before they are shuffled, so a language of any share is no task's work.
    """
    good = good.filter("n_symbols > 0")
    good = written(good.withColumn("lang", F.explode(F.array_distinct(F.array(F.coalesce("lang", F.lit(ANY)), F.lit(ANY))))), "good-scores")
    means = written(good.groupBy("lang").agg((F.sum("nll") / F.sum("n_symbols")).alias("mean")), "means")
    dealt = good.withColumn("s", F.pmod(F.xxhash64("nll"), F.lit(SALT))).join(means.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["lang", "s"])
    found = dealt.groupBy("lang").agg(F.first("mean").alias("mean"), F.percentile_approx(_perplexity(F.col("mean")), quantile, 10_000).alias("threshold"))
    return written(found, "quality-limits")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRUSTED, quantile: float = QUANTILE, **more: Column) -> tuple[DataFrame, DataFrame] | None:
    """(scores, limits): doc_id, lang, the columns ``more``, nll and n_symbols of every row of ``docs``, written; None if no document is labelled good."""
    ensure_importable(docs.sparkSession)
    chosen = written(trusted_rows(labels, most), "trusted")  # at most ``most`` ids, so they can be broadcast
    model = train(written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").select("text"), "trusted-text"))
    if model is None:
        return None
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), *[c.alias(name) for name, c in more.items()])
    scored = written(scorer(docs.select("text"), model)(rows, ["doc_id", "lang", *more]), "quality-scores")
    good = scored.join(good_rows(labels), "doc_id", "left_semi")
    unseen = good.join(F.broadcast(chosen), "doc_id", "left_anti")
    return scored, limits((good if unseen.filter("n_symbols > 0").isEmpty() else unseen).select("lang", "nll", "n_symbols"), quantile)


def classify(docs: DataFrame, labels: DataFrame, most: int = TRUSTED, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and keep of every row of ``docs(doc_id, text, lang)``.

    A null, empty or blank text has no symbols, and so the mean perplexity of good texts in its language: it
    is kept. A very long text is scored whole. A language without documents labelled good, or null, is held to the limits of
    all languages together. Rows that repeat are each judged. Without a document labelled good
    there is no model: all rows are kept, with null figures. An empty table gives an empty result. Other columns are ignored.
    """
    found = fit(docs, labels, most, quantile)
    if found is None:
        return docs.select("doc_id", "lang", *[F.lit(None).cast(t).alias(c) for c, t in (("n_symbols", "long"), ("perplexity", "double"), ("threshold", "double"))], F.lit(True).alias("keep"))
    return _judged(*found).select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "keep")


def _judged(rows: DataFrame, limit: DataFrame) -> DataFrame:
    """``rows(lang, nll, n_symbols)`` with perplexity, the threshold of their language and keep."""
    general = limit.filter(F.col("lang") == ANY).first()
    own = limit.filter(F.col("lang") != ANY).select(F.col("lang").alias("_lang"), "mean", "threshold")
    joined = rows.join(own, rows["lang"] == own["_lang"], "left").drop("_lang")
    mean, threshold = (F.coalesce(c, F.lit(general[c])) for c in ("mean", "threshold"))
    return joined.withColumn("perplexity", _perplexity(mean)).withColumn("threshold", threshold).withColumn("keep", F.col("perplexity") <= F.col("threshold"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = TRUSTED, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, in their own columns, whatever their names.

    Null, empty and blank texts stay, as in ``classify``; so do all rows where no document is labelled good; rows that
    repeat are each judged and very long texts read whole; an empty table gives an empty result.
    """
    every = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    found = fit(docs, labels, most, quantile, _hash=every)
    if found is None:
        return docs
    # equal rows have equal verdicts; rows cross the network at most once, to meet the keys of those that go
    gone = written(_judged(*found).filter(~F.col("keep")).select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_gone")).distinct(), "rejected")
    marked_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col("doc_id").alias("_key"), every.alias("_hash"))
    kept = marked_rows.join(build_side(gone), marked_rows["_key"].eqNullSafe(gone["_id"]) & (marked_rows["_hash"] == gone["_gone"]), "left_anti")
    return kept.select("_all.*")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """All documents judged by a model of the trusted ones."""
    from plazaflow.session import table

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
