"""Exact maximum-inner-product search by ball trees.

Candidates are dealt into shards by a hash of their row; a shard's vectors form a ball tree, split at the median
along the direction between two far points down to leaves of at most ``LEAF``. Each tree is built once, by one task,
and written as a row. A search streams the queries of a shard past its tree: the inner product of q with
anything in a ball of centre c and radius r is at most q.c + |q| r, nodes are taken in descending order of that
bound, and a query leaves a node, and all below it, whose bound is under its current k-th score.

The k-th scores are passed on between shards: in a first round a query searches one shard, in a second about the square
root of them, in a third the rest, and each round starts from the k-th score of all rounds before.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plazaflow.llm.common import cut, written
from plazaflow.session import ensure_importable

LEAF = 128
#: Candidates of a shard, about, and queries that go past a tree at once.
SHARD, QUERIES = 100_000, 4_000
#: The score of no candidate; its negative is a long too.
NONE = -(2**63) + 1
NO_ID = 2**63 - 1
FOUND = "query_id long, vec_id long, score long, qrow long"


def scaled(c: Column, by: int = 64) -> Column:
    """floor(by * x) of each component, as long; null for a vector that takes no part."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(c.isNotNull() & ~bad, F.transform(c, lambda x: F.floor(x.cast("double") * by).cast("long")))


class BallTree:
    """A ball tree over the rows of ``x``. order: rows by leaf; of each node lo and hi, its part of the order, left and right, its
    children (-1 for a leaf), centre and radius; node 0 is the root, none if there are no rows."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        nodes: list[list[int]] = []
        todo = [(0, len(x), -1, 0)] if len(x) else []
        while todo:
            lo, hi, parent, side = todo.pop()
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            nodes.append([lo, hi, -1, -1])
            if hi - lo <= LEAF:
                continue
            rows = x[self.order[lo:hi]]
            a = rows[np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1))]
            b = rows[np.argmax(((rows - a) ** 2).sum(axis=1))]
            half = (hi - lo) // 2  # by rank and not by value: equal vectors are split too
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows @ (b - a), half)]
            me = len(nodes) - 1
            todo += [(lo, lo + half, me, 0), (lo + half, hi, me, 1)]
        self.lo, self.hi, self.left, self.right = np.array(nodes, np.int64).reshape(-1, 4).T.copy()
        parts = [x[self.order[lo:hi]] for lo, hi in zip(self.lo, self.hi, strict=True)]
        self.centre = np.array([p.mean(axis=0) for p in parts]).reshape(len(parts), x.shape[1])
        self.radius = np.array([np.sqrt(((p - c) ** 2).sum(axis=1).max()) for p, c in zip(parts, self.centre, strict=True)])


#: The arrays of a shard, each a binary column of its row; what the search needs beside the tree is in the tree's order.
ARRAYS = {"x": np.int64, "ids": np.int64, "rows": np.int64, "lo": np.int64, "hi": np.int64, "left": np.int64, "right": np.int64, "centre": np.float64, "radius": np.float64}


class Shard:
    """The candidates of a shard in the order of its tree: x (longs), ids and rows, and the nodes."""

    def __init__(self, width: int, **arrays: np.ndarray):
        self.width = width
        for name, a in arrays.items():
            setattr(self, name, a.reshape(-1, width) if name in ("x", "centre") and width else a)
        if not width:
            self.x, self.centre = np.zeros((len(self.ids), 0), np.int64), np.zeros((len(self.lo), 0))
        self.largest = float(np.abs(self.x).max(initial=0))

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Shard:
        t = BallTree(x.astype(np.float64))
        return cls(x.shape[1], x=x[t.order], ids=ids[t.order], rows=rows[t.order], lo=t.lo, hi=t.hi, left=t.left, right=t.right, centre=t.centre, radius=t.radius)

    def packed(self) -> list[bytes]:
        """The arrays as bytes; vectors in the narrowest integers that hold them."""
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if self.largest <= np.iinfo(k).max)
        return [kind.encode() + self.x.astype(kind).tobytes() if name == "x" else np.ascontiguousarray(getattr(self, name), k).tobytes() for name, k in ARRAYS.items()]

    @classmethod
    def unpacked(cls, width: int, packed: list[bytes]) -> Shard:
        arrays = {name: np.frombuffer(raw[3:], raw[:3].decode()).astype(np.int64) if name == "x" else np.frombuffer(raw, k) for (name, k), raw in zip(ARRAYS.items(), packed, strict=True)}
        return cls(width, **arrays)


class Best:
    """The k best (score, id) of each of n queries, best first; ``kth`` is the score to reach."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.score = np.full((n, k), NONE, np.int64)
        self.id = np.full((n, k), NO_ID, np.int64)
        self.kth = least.astype(np.float64)

    def offer(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Candidates in any order; a query may have many."""
        who, of = np.unique(query, return_inverse=True)
        k = self.score.shape[1]
        row = np.concatenate([np.repeat(np.arange(len(who)), k), of])
        s = np.concatenate([self.score[who].ravel(), score])
        i = np.concatenate([self.id[who].ravel(), ident])
        order = np.lexsort((i, -s, row))
        row, s, i = row[order], s[order], i[order]
        first = np.searchsorted(row, np.arange(len(who)))
        take = first[:, None] + np.arange(k)
        self.score[who], self.id[who] = s[take], i[take]
        self.kth[who] = np.maximum(self.kth[who], self.score[who, -1])


Found = list[tuple[np.ndarray, np.ndarray]]


def search(shard: Shard, q: np.ndarray, q_rows: np.ndarray, k: int, least: np.ndarray) -> Found:
    """(score, id) of the k best of each query among the candidates, ties to the smaller id; those under ``least`` may be left out.

    q_rows: identities of the queries' rows; a query's own row is no candidate. Each query first goes down to its most
    promising leaf; then nodes are taken in descending order of the best bound that any query has for them, with the queries whose
    bound still reaches their k-th score.
    """
    best = Best(len(q), k, least)
    if not len(shard.lo) or not len(q):
        return [(np.zeros(0, np.int64),) * 2] * len(q)
    width = max(shard.width, q.shape[1])  # the shorter are filled up with zeros
    x, centre = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (shard.x, shard.centre))
    q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
    wide = max(shard.largest, float(np.abs(q).max(initial=0))) ** 2 * max(1, width)
    kind = np.float32 if wide < 2**23 else np.float64 if wide < 2**52 else np.int64  # in which products are exact
    x, goal, fq = x.astype(kind), q.astype(kind), q.astype(np.float64)
    norm = np.sqrt((fq**2).sum(axis=1))
    slack = 1e-6 * (1 + norm * (np.abs(centre).max(initial=0) * max(1.0, width**0.5) + shard.radius.max()))  # rounding never hides a node

    def bounds(at: np.ndarray, node: int) -> np.ndarray:
        b = fq[at] @ centre[node] + norm[at] * shard.radius[node]
        return b + 1e-6 * np.abs(b) + slack[at]

    def visit(at: np.ndarray, leaf: int) -> None:
        lo, hi = shard.lo[leaf], shard.hi[leaf]
        score = goal[at] @ x[lo:hi].T
        r, c = np.nonzero(score >= best.kth[at][:, None])
        other = q_rows[at[r]] != shard.rows[lo + c]
        r, c = r[other], c[other]
        if len(r):
            best.offer(at[r], score[r, c].astype(np.int64), shard.ids[lo + c])

    home = np.zeros(len(q), np.int64)
    level = {0: np.arange(len(q))}
    while level:
        below: dict[int, np.ndarray] = {}
        for node, at in level.items():
            if shard.left[node] < 0:
                home[at] = node
                visit(at, node)
                continue
            left, right = int(shard.left[node]), int(shard.right[node])
            first = bounds(at, left) >= bounds(at, right)
            below |= {n: some for n, some in ((left, at[first]), (right, at[~first])) if len(some)}
        level = below
    every = np.arange(len(q))
    start = bounds(every, 0)
    heap = [(-float(start.max()), 0, every, start)]
    while heap:
        _, node, at, bound = heapq.heappop(heap)
        at = at[bound >= best.kth[at]]
        if shard.left[node] < 0:
            at = at[home[at] != node]
            if len(at):
                visit(at, node)
            continue
        for child in (int(shard.left[node]), int(shard.right[node])) if len(at) else ():
            b = bounds(at, child)
            some = b >= best.kth[at]
            if some.any():
                heapq.heappush(heap, (-float(b[some].max()), child, at[some], b[some]))
    return [(s[s != NONE], i[s != NONE]) for s, i in zip(best.score, best.id, strict=True)]


def _matrix(v: pd.Series, width: int) -> np.ndarray:
    """Rows of longs; a shorter vector is filled up with zeros."""
    if all(len(x) == width for x in v):
        return np.concatenate(list(v)).reshape(len(v), width) if width else np.zeros((len(v), 0), np.int64)
    out = np.zeros((len(v), width), np.int64)
    for i, x in enumerate(v):
        out[i, : len(x)] = x
    return out


def _width(v: pd.Series) -> int:
    return max(map(len, v), default=0)


TREES = "shard int, width int, " + ", ".join(f"{name} binary" for name in ARRAYS)


def _tree(rows: pd.DataFrame) -> pd.DataFrame:
    width = _width(rows["v"])
    made = Shard.of(_matrix(rows["v"], width), rows["vec_id"].to_numpy(), rows["row"].to_numpy())
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "width": [width], **{name: [raw] for name, raw in zip(ARRAYS, made.packed(), strict=True)}})


def _searcher(k: int, block: int):
    """Rows sorted by shard with each shard's tree first, then its queries: what each batch of queries finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for b in batches:
            shards = b.column("shard").to_numpy()
            is_tree = b.column("width").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | is_tree[1:] | is_tree[:-1]]))
            for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                if is_tree[lo]:
                    [r] = b.slice(lo, 1).to_pylist()
                    at, tree = r["shard"], Shard.unpacked(r["width"], [r[name] for name in ARRAYS])
                    continue
                if shards[lo] != at:
                    continue  # a shard without candidates
                for i in range(lo, hi, block):
                    part = b.slice(i, min(block, hi - i))
                    v = part.column("v").to_pandas()
                    ids, rows = (part.column(c).to_numpy() for c in ("vec_id", "row"))
                    found = search(tree, _matrix(v, _width(v)), rows, k, part.column("least").to_numpy())
                    n = [len(s) for s, _ in found]
                    columns = np.repeat(ids, n), np.concatenate([x for _, x in found]), np.concatenate([s for s, _ in found]), np.repeat(rows, n)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "qrow"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best candidates of every query in ``vectors(vec_id, embedding)``.

    Every row but the query's own is a candidate. The score is the inner product of the scaled integer
    vectors; a vector shorter than another counts as filled up with zeros. Ties go to the smaller vec_id,
    and among rows that repeat one, each is a candidate with a rank of its own. Vectors that are null or
    hold null or non-finite components, and rows without vec_id, take no part. Fewer candidates than ``k``
    give fewer rows, an empty table none. A query row that repeats gives its result once per row. Other columns are ignored.

    shard: candidates of a tree, about; block: queries that go past a tree at once.
    """
    spark = vectors.sparkSession
    ensure_importable(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v"), is_query.alias("is_query")).filter("vec_id is not null and v is not null")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    # enough shards to occupy the cores, as long as a shard is worth a tree: queries go to one task a shard
    shards = max(1, -(-n // shard), min(2 * spark.sparkContext.defaultParallelism, n // 2_000))
    home = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    trees = written(rows.select("vec_id", "v", "row", home.alias("shard")).groupBy("shard").applyInPandas(_tree, TREES), "ball-trees")
    names = [c for c in trees.columns if c != "shard"]
    nothing = {c: F.lit(None).cast(trees.schema[c].dataType) for c in names}
    first = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int")
    queries = rows.filter("is_query").select("vec_id", "v", "row", first.alias("home")).withColumn("least", F.lit(float("-inf")))
    ends = sorted({1, min(shards, 1 + math.isqrt(shards)), shards})
    found = None
    for lo, hi in zip([0, *ends], ends, strict=False):
        if found is not None:
            kth = F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).cast("double")
            kth = found.groupBy(F.col("qrow").alias("row")).agg(kth.alias("kth"))  # k scores of each shard at most
            queries = queries.drop("least").join(kth, "row", "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
        each = queries.withColumn("o", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))).withColumn("shard", F.pmod(F.col("home") + F.col("o"), F.lit(shards)).cast("int"))
        asked = each.select("shard", F.lit(1).alias("seq"), *[x.alias(c) for c, x in nothing.items()], "vec_id", "v", "row", "least")
        no_query = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("vec_id", "v", "row", "least")]
        met = trees.select("shard", F.lit(0).alias("seq"), *names, *no_query).unionByName(asked)
        dealt = met.repartition(shards, "shard").sortWithinPartitions("shard", "seq")
        more = cut(dealt.mapInArrow(_searcher(k, block), FOUND))
        found = more if found is None else found.unionByName(more)
    best = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")  # at most k rows a query and shard
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of every twentieth vector among all."""
    from plazaflow.session import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS e, row_number() OVER () AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20
"""
