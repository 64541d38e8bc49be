"""Language-model scores of whole documents.

Words are counted over all training documents. The counts are exact for every word, however many there
are: at most ``FREQUENT`` words, those above a count that a histogram of counts gives, travel to
the workers; occurrences of any other word meet their count in a join. That takes the hot words out of
the join and leaves it a tail in which no word is frequent.

The model is the recurrent network of ``gru``: it predicts frequent words one by one, and for any other
word its *shape* (what it ends in, and its first letter beyond ASCII, if any); within a shape a
word's probability comes from the counts, with 0.5 added and one unseen word more, so that the probabilities of all
texts sum to one at most.

The network learns from every token of every training document, once. Texts become the network's tokens first, two
bytes each, written beside what else is known of their rows. The documents are dealt into ``ROUNDS`` rounds; in a round each
task starts from the same parameters, learns from its own documents as a stream, and the results are averaged, by
their tokens, in groups of tasks and then over the groups. No text and no document comes to the driver.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import written
from plazaflow.llm import gru
from plazaflow.llm.gru import SHAPES, START, WORDS
from plazaflow.llm.token_blocks import chunks
from plazaflow.session import ensure_importable

FREQUENT = 200_000
#: Rounds of learning, groups of tasks whose parameters are averaged first, and the learning rate of the first round, which falls by half with each.
ROUNDS, AVERAGED, RATE = 3, 16, 0.04
#: The end of a document, as a word; no word is empty.
END = ""
#: Distinct words that a counting task holds before it passes them on.
HELD = 300_000


def in_training(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is not 1. A null id is taken as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 1


def shape(word: str) -> int:
    """One of ``SHAPES`` shapes: four kinds of last character, by whether all is ASCII and else three kinds of first letter beyond it."""
    last = word[-1]
    kind = 0 if last.isalpha() else 1 if last.isdigit() else 2 if last in ",.;:!?" else 3
    if word.isascii():
        return kind * 4
    first = next(c for c in word if ord(c) > 127)
    return kind * 4 + 1 + zlib.crc32(first.encode()) % 3


def word_counts(docs: DataFrame) -> DataFrame:
    """word, count and shape over all rows of ``docs(text)``, the ends of documents included; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "count"])
            held.clear()
            return found

        for b in chunks(batches):
            held[b""] += b.num_rows
            for t in b.column("text").to_pylist():
                held.update((t or "").encode("utf-8", "replace").lower().split())
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes = [shape(w) if w else 0 for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("count"), pa.array(shapes, pa.int32())], names=["word", "count", "shape"])

    counts = docs.select("text").mapInArrow(run, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))
    return written(counts.mapInArrow(shaped, "word string, count long, shape int"), "word-counts")


def frequent_words(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """(word, count) of the words above the smallest count that ``most`` words at most exceed, by falling count."""
    # a corpus of N tokens has fewer than sqrt(2 N) different counts
    least, total = None, 0
    for c, n in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).limit(most).collect():
        total += n
        if total > most:
            break
        least = c
    if least is None:
        return []
    found = [(r["word"], r["count"]) for r in counts.filter(F.col("count") >= least).select("word", "count").collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


class Tables:
    """What a worker needs: the frequent words with their counts, and totals. Broadcast as it is; ``frequent`` bounds it."""

    def __init__(self, frequent: list[tuple[str, int]], tokens: int, distinct: int, shapes: list[tuple[int, int]]):
        self.n, self.v = tokens, distinct
        outside = [list(x) for x in shapes]  # (tokens, distinct words) of each shape, without the words that the network has
        for w, c in frequent[:WORDS]:
            k = shape(w) if w else 0
            outside[k][0] -= c
            outside[k][1] -= 1
        self.shape_total = [t + 0.5 * (d + 1) for t, d in outside]
        #: Occurrences of each of the network's tokens in training.
        self.frequency = np.zeros(START, np.int64)
        self.frequency[: len(frequent[:WORDS])] = [c for _, c in frequent[:WORDS]]
        self.frequency[WORDS:] = [t for t, _ in outside]
        self.index = {w.encode(): i for i, (w, _) in enumerate(frequent)}
        c = np.array([c for _, c in frequent], np.float64)
        self.base = np.log10((c + 0.5) / self.total)
        self.token = np.array([i if i < WORDS else WORDS + (shape(w) if w else 0) for i, (w, _) in enumerate(frequent)], np.int64)
        self.inner = np.array([0.0 if i < WORDS else math.log10((x + 0.5) / self.shape_total[shape(w) if w else 0]) for i, (w, x) in enumerate(frequent)])

    @property
    def total(self) -> float:
        return self.n + 0.5 * (self.v + 1)


Rare = tuple[list[bytes], list[int], list[int]]


def _tokens(tables: Tables, text: str | None) -> tuple[np.ndarray, np.ndarray, Rare]:
    """The network's tokens and the places of frequent words of a text and its end; and its other words with their counts and shapes."""
    got = (text or "").encode("utf-8", "replace").lower().split()
    got.append(b"")
    place = np.fromiter(map(tables.index.get, got, repeat(-1)), np.int64, len(got))
    rare = np.flatnonzero(place < 0)
    token = tables.token[place] if len(tables.token) else np.zeros(len(got), np.int64)
    if not len(rare):
        return token, place, ([], [], [])
    missing = [got[i] for i in rare.tolist()]
    other = Counter(missing)
    shapes = {w: shape(w.decode()) if w else 0 for w in other}
    token[rare] = WORDS + np.fromiter(map(shapes.__getitem__, missing), np.int64, len(missing))
    return token, place[place >= 0], (list(other), list(other.values()), list(shapes.values()))


def _rare_column(rare: list[Rare]) -> pa.Array:
    """The other words of each text as lists of structs."""
    ends = np.cumsum([0, *(len(w) for w, _, _ in rare)]).astype(np.int32)
    words, counts, shapes = ([x for r in rare for x in r[i]] for i in range(3))
    kinds = pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int32()), pa.array(shapes, pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(kinds, names=["word", "n", "shape"]))


_ROWS = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, rare array<struct<word:string,n:int,shape:int>>, tokens binary"


def _tokenizer(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables = shipped.value  # unpacked once by each worker
        row = TaskContext.get().partitionId() << 40
        for b in chunks(batches):
            found = [_tokens(tables, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + b.num_rows)),
                    b.column("doc_id").cast(pa.int64()),
                    b.column("held_out"),
                    pa.array([len(t) for t, _, _ in found], pa.int64()),
                    pa.array([len(p) for _, p, _ in found], pa.int64()),
                    pa.array([tables.base[p].sum() for _, p, _ in found], pa.float64()),
                    pa.array([tables.inner[p].sum() for _, p, _ in found], pa.float64()),
                    _rare_column([r for _, _, r in found]),
                    pa.array([t.astype("<u2").tobytes() for t, _, _ in found], pa.binary()),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "inner", "rare", "tokens"],
            )
            row += b.num_rows

    return run


def _learner(shipped, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer = gru.Trainer(gru.from_bytes(shipped.value), rate)
        trainer.learn(np.frombuffer(t, "<u2") for b in batches for t in b.column("tokens").to_pylist())
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([trainer.tokens], pa.int64()), pa.array([gru.to_bytes(trainer.params)], pa.binary())], names=["part", "n", "params"])

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first: list[int] = []

    def found() -> Iterator[tuple[int, bytes]]:
        for b in batches:
            for r in b.to_pylist():
                first.append(r["part"])
                yield r["n"], r["params"]

    n, params = gru.average(found())
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(first[:1], pa.int32()), pa.array([n], pa.int64()), pa.array([params], pa.binary())], names=["part", "n", "params"])


def fit(rows: DataFrame, tables: Tables, rounds: int = ROUNDS, rate: float = RATE) -> gru.Params:
    """The network's parameters from all rows of ``rows(row, held_out, tokens)`` that are not held out; each is read in one round.

    The same rows in the same partitions give the same parameters, whichever task ends first. A task's parameters are all that leaves
    it; ``AVERAGED`` of them at most come to the driver in a round.
    """
    params = gru.first_params(tables.frequency)
    schema = "part int, n long, params binary"
    for k in range(rounds):
        shipped = rows.sparkSession.sparkContext.broadcast(gru.to_bytes(params))
        some = rows.filter((~F.col("held_out")) & (F.pmod("row", F.lit(rounds)) == k)).select("tokens")
        learned = some.mapInArrow(_learner(shipped, rate / 2**k), schema)
        groups = learned.repartition(AVERAGED, F.pmod("part", F.lit(AVERAGED))).sortWithinPartitions("part").mapInArrow(_averaged, schema)
        n, raw = gru.average((r["n"], r["params"]) for r in sorted(groups.collect(), key=lambda r: r["part"]))
        if n:
            params = gru.from_bytes(raw)
    return params


def _scorer(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = gru.from_bytes(shipped.value)
        for b in chunks(batches):
            model = gru.score(params, [np.frombuffer(t, "<u2") for t in b.column("tokens").to_pylist()]) / math.log(10)
            kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(model + b.column("inner").to_numpy())], names=[*kept, "model"])

    return run


def prepare(docs: DataFrame, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame, Tables]:
    """(rows with their tokens, counts of words, tables) of ``docs(doc_id, text)``; both frames are written."""
    docs = docs.select(F.col("doc_id"), "text", (~in_training(F.col("doc_id"))).alias("held_out"))
    counts = word_counts(docs.filter("not held_out"))
    by_shape = {r["shape"]: (r["t"], r["d"]) for r in counts.groupBy("shape").agg(F.sum("count").alias("t"), F.count("*").alias("d")).collect()}
    shapes = [by_shape.get(k, (0, 0)) for k in range(SHAPES)]
    tables = Tables(frequent_words(counts, frequent), sum(t for t, _ in shapes), sum(d for _, d in shapes), shapes)
    shipped = docs.sparkSession.sparkContext.broadcast(tables)
    return written(docs.mapInArrow(_tokenizer(shipped), _ROWS), "lm-rows"), counts, tables


def score(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs(doc_id, text)``.

    A null, empty or blank text is its end alone. Rows that repeat each get a row, and count each time
    where they are in training. A very long text is learned from and scored whole. An empty table gives an empty
    result. Without training documents no word is known and the network is not fitted. Other columns are ignored.
    """
    ensure_importable(docs.sparkSession)
    rows, counts, tables = prepare(docs, frequent)
    shipped = docs.sparkSession.sparkContext.broadcast(gru.to_bytes(fit(rows, tables)))
    scored = rows.drop("rare").mapInArrow(_scorer(shipped), "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n", "r.shape")
    met = rare.join(counts.select("word", "count"), "word", "left").withColumn("c", F.coalesce("count", F.lit(0)))
    in_shape = F.element_at(F.array(*[F.lit(float(x)) for x in tables.shape_total]), F.col("shape") + 1)
    tail = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(tables.total))).alias("b"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / in_shape)).alias("m"),
    )
    zero = F.lit(0)
    return scored.join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", zero)).cast("long").alias("n_known"),
        F.lit(tables.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("m", zero)).alias("score"),
    )


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    """All documents scored by what the training ones teach."""
    from plazaflow.session import table

    return score(table(spark, sf_dir, "documents"))
