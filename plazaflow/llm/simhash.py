"""SimHash near-duplicates by anchor-point covering.

Of two 64-bit fingerprints that differ in at most 2 k - 1 bits, one of k blocks differs in at most one bit.
The points of a block are covered by the anchors of the code that is a perfect Hamming code in its low bits
([15, 11] where the block is long enough, else [7, 4]) and every value in its other bits: the covering radius is 1. A
fingerprint *owns* its nearest anchor in each block and is replicated to every anchor within radius plus
threshold whose owners can be one bit away, so each near pair meets where one of the two is owner. At an
anchor owners are compared with all. With three blocks (up to 5 bits) a fingerprint is in about 41 places.

Equal fingerprints are one point from the start, so that a group of exact copies of any size costs
one row. Anchors with more than ``GROUP`` points are cut into chunks that meet pairwise in different
tasks. What leaves an anchor is a spanning forest, never all pairs.

A pair can be held to a similarity besides: each point then carries the size of its set of shingles and a *sketch*, two
bits for each of 64 ranges of hashes, of the smallest hash in it. Of two sets of n and m shingles and a Jaccard similarity
of t at least, no more ranges differ than shingles do, (1 - t) / (1 + t) (n + m), and by chance a mean of
64 (1 - t) 2/3; pairs beyond the former, or six standard deviations beyond the latter (a chance of about 1e-9), are
dropped before texts are compared.

``deduplicate`` links by the similarity itself. Near fingerprints are candidates; so are, for the pairs that differ in
more bits, texts that share a shingle of their prefixes: two sets of a similarity of t or more share one of the first
n - ceil(t n) + 1 of their n shingles in any order that is the same for all sets. The order is by the counts of buckets of
shingles: common ones come last. Texts that meet at such a shingle are compared by their sketches in its task, which
passes on a spanning forest of those alike, and the connected groups of candidates are held to the similarity of their
whole sets. Texts that share a passage alone never meet as texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import build_side, cut, written
from plazaflow.llm.token_blocks import chunks
from plazaflow.session import ensure_importable

THRESHOLD = 4
#: Points of an anchor that one task compares at once.
GROUP = 16_384
PAIRS = 1 << 18
#: Points of a group from which it is swept point by point rather than pair by pair.
SWEPT = 1024
#: Ranges of hashes in a sketch.
RANGES = 64
#: Buckets of shingles whose counts order them, and points that a task remembers.
BUCKETS, SEEN = 1 << 18, 1 << 19
#: Buckets whose counts are one row of 32 kB: rows of megabytes make the driver's heap grow to its limit and stay there.
PIECE = 1 << 12
#: Texts that meet at one shingle, about, beyond which they are cut into chunks.
MEETING = 1 << 18
#: Shingles of a component beyond which it is cut into chunks.
SHINGLES = 1 << 17
#: Tasks among which the rows of a large star are dealt.
SALT = 8


def shingle_hashes(text: str | None, words_per_shingle: int) -> bytes:
    """XXH64, seed 42, of each shingle of a whole text, repeats included, 8 bytes each with the highest first."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space only
    n = len(words) - words_per_shingle + 1
    digest = xxhash.xxh64_digest
    if n <= 1:
        return digest(b" ".join(words), 42) if words else b""
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    return b"".join([digest(flat[i:j], 42) for i, j in zip(starts, (ends[words_per_shingle - 1 :] - 1).tolist(), strict=True)])


def fingerprint(hashes: bytes) -> int:
    """Bit by bit, whether more than half of the hashes have it; 0 if there are none."""
    view = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(view), 1 << 16):
        bits += np.unpackbits(view[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(view)).tobytes(), "big")


def shingle_set(hashes: bytes) -> np.ndarray:
    """The different hashes, sorted."""
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def sketch(shingles: np.ndarray) -> tuple[int, int]:
    """Two bits for each of ``RANGES`` ranges of hashes: 1 to 3 of the smallest in it, 0 if there is none; as two longs."""
    out = [0, 0]
    if len(shingles):
        ranges = (shingles >> np.uint64(58)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
        value = (1 + (shingles[first] & np.uint64(0xFFFFFF)) % np.uint64(3)) << (2 * (ranges[first] % 32)).astype(np.uint64)
        half = int(np.searchsorted(ranges[first], 32))
        out = [int(value[:half].sum()), int(value[half:].sum())]
    return out[0], out[1]


class Alike:
    """Says which pairs of points may have the similarity; size, low, high: of each point."""

    def __init__(self, similarity: float, size: np.ndarray, low: np.ndarray, high: np.ndarray):
        mean = RANGES * (1 - similarity) * 2 / 3
        self.most, self.similarity = math.floor(mean + 6 * math.sqrt(mean) + 1), similarity
        self.size, self.low, self.high = size, low, high

    def __call__(self, a, b) -> np.ndarray:
        """For points a and b, numbers or arrays that broadcast."""
        n, m = self.size[a], self.size[b]
        x, y = self.low[a] ^ self.low[b], self.high[a] ^ self.high[b]
        one, every = np.uint64(1), np.uint64(0x5555555555555555)
        different = np.bitwise_count((x | (x >> one)) & every).astype(np.int64) + np.bitwise_count((y | (y >> one)) & every)
        t = self.similarity
        bound = np.minimum(np.floor((1 - t) / (1 + t) * (n + m) + 1e-6), self.most)
        return (different <= bound) & (np.minimum(n, m) >= t * np.maximum(n, m) - 1e-6)


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, keep: str = "doc_id") -> DataFrame:
    """The column ``keep`` and the fingerprint ``fp`` as a signed long of every row."""
    ensure_importable(docs.sparkSession)
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            fps = [fingerprint(shingle_hashes(x.as_py(), words_per_shingle)) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[keep, "fp"])

    return docs.select(keep, "text").mapInArrow(run, f"{keep} {kind}, fp long")


def blocks_for(most_bits: int) -> list[tuple[int, int]]:
    """Start and number of bits of each block."""
    k = most_bits // 2 + 1
    ends = [-(-64 * i // k) for i in range(k + 1)]
    return [(i, j - i) for i, j in zip(ends, ends[1:], strict=False)]


def _nearest(code_bits: int):
    """Maps values to the nearest anchor: the syndrome, the exclusive or of the numbers from 1 of the set code bits, names the bit to flip."""
    s = np.zeros(1 << code_bits, np.uint8)
    for bit in range(code_bits):
        s[1 << bit : 2 << bit] = s[: 1 << bit] ^ (bit + 1)
    flip = np.concatenate([[0], 1 << np.arange(code_bits)]).astype(np.int64)[s]
    return lambda x: x ^ flip[x & ((1 << code_bits) - 1)]


def anchors(fps: np.ndarray, most_bits: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index of fingerprint, anchor key, owner) of the covering."""
    n = len(fps)
    index, key, owner = [], [], []
    for k, (start, bits) in enumerate(blocks_for(most_bits)):
        nearest = _nearest(15 if bits >= 15 else 7)
        x = ((fps >> np.uint64(start)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        # the anchors that own some point at most one bit away from x
        near = np.concatenate([nearest(x)[:, None], nearest(x[:, None] ^ (np.int64(1) << np.arange(bits, dtype=np.int64)))], axis=1)
        order = np.sort(near, axis=1)
        fresh = np.concatenate([np.ones((n, 1), bool), order[:, 1:] != order[:, :-1]], axis=1)
        row, col = np.nonzero(fresh)
        got = order[row, col]
        index.append(row)
        key.append(got | (k << 24))
        owner.append(got == near[row, 0])
    return np.concatenate(index), np.concatenate(key), np.concatenate(owner)


def _replicate(most_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                row, key, owner = anchors(part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), most_bits)
                rest = [c for c in part.schema.names]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(owner), *part.take(pa.array(row)).columns], names=["anchor", "owner", *rest])

    return run


def forest(left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of nodes, the smallest index each is connected to, with the edges left - right added."""
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        for end in (label[left], label[right], left, right):
            np.minimum.at(after, end, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def sweep(n: int, near, owner: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Edges (one, others) of a spanning forest of the pairs of n points that ``near(one, others)`` says are near, of which one is an owner.

    A point that has been reached is not compared with another that has, so a group of copies costs few comparisons.
    """
    owner = np.ones(n, bool) if owner is None else owner
    owners, rest = np.flatnonzero(owner), np.flatnonzero(~owner)
    while len(owners):
        reached, owners = [int(owners[0])], owners[1:]
        while reached and len(owners) + len(rest):
            i = reached.pop()
            hit = near(i, owners)
            if hit.any():
                found, owners = owners[hit], owners[~hit]
                reached += found.tolist()
                yield i, found
            if owner[i] and len(rest):
                hit = near(i, rest)
                if hit.any():
                    found, rest = rest[hit], rest[~hit]
                    reached += found.tolist()
                    yield i, found


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by their first, a group, in arrays that end where a group does."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        x = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        whole = int(np.searchsorted(x[0], x[0][-1]))  # the last group may go on in the next batch
        if whole:
            held.append([v[:whole] for v in x])
        if held and (whole or held[-1][0][-1] != x[0][0]):
            yield [np.concatenate(v) for v in zip(*held, strict=True)]
            held = []
        held.append([v[whole:] for v in x])
    if held:
        yield [np.concatenate(v) for v in zip(*held, strict=True)]


def _bounds(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group begins, and its size."""
    first = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    return first, np.diff(np.concatenate([first, [len(group)]]))


def _linked(node: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    label = np.arange(len(node))
    for left, right in pairs:
        if len(left):
            label = forest(left, right, label)
    linked = np.flatnonzero(label != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], names=["a", "b"])


def _groups(most_bits: int, similarity: float):
    """Edges of a spanning forest from rows sorted by group, in which a near pair has at least one owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, owner, node, signed, *rest in whole_groups(batches):
            fp = signed.view(np.uint64)
            alike = Alike(similarity, rest[0], rest[1].view(np.uint64), rest[2].view(np.uint64)) if rest else None

            def near(a, b) -> np.ndarray:
                found = np.bitwise_count(fp[a] ^ fp[b]) <= most_bits  # noqa: B023
                if alike and found.any():  # noqa: B023
                    found &= alike(a, b)  # noqa: B023
                return found

            yield _linked(node, _near_pairs(group, near, owner))

    return run


def _near_pairs(group: np.ndarray, near, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that connect all points of a group that are near, one of them an owner; rows are sorted by group."""
    first, size = _bounds(group)
    large = size >= SWEPT
    for at, n in zip(first[large].tolist(), size[large].tolist(), strict=True):
        for i, found in sweep(n, lambda i, others: near(at + i, at + others), owner[at : at + n]):  # noqa: B023
            yield np.full(len(found), at + i), at + found
    # many small groups at once: owners with all of theirs, pairs of owners once
    of = np.repeat(np.arange(len(first)), size)
    own = np.flatnonzero(owner & ~large[of])
    for left, right in _pieces(own, first[of[own]], size[of[own]]):
        once = (left < right) | ~owner[right]
        left, right = left[once], right[once]
        keep = near(left, right)
        yield left[keep], right[keep]


def _pieces(left: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each of ``left`` with the ``length`` places from ``start``, about ``PAIRS`` at once."""
    total = np.concatenate([[0], np.cumsum(length)])
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        m = length[lo:hi]
        one = np.repeat(left[lo:hi], m)
        yield one, np.arange(len(one)) + np.repeat(start[lo:hi] - np.cumsum(m) + m, m)
        lo = hi


def near_edges(points: DataFrame, most_bits: int = THRESHOLD, similarity: float = 0.0) -> DataFrame:
    """Edges (a, b) among the nodes of ``points(node, fp)`` that connect all that are linked; with a similarity also ``n, low, high``."""
    rest = ["node", "fp", *["n", "low", "high"] * (similarity > 0)]
    points = points.select(*rest)
    rows = points.mapInArrow(_replicate(most_bits), "anchor int, owner boolean, node long, fp long" + ", n long, low long, high long" * (similarity > 0))
    keys = points.select("fp").mapInArrow(_replicate(most_bits), "anchor int, owner boolean, fp long")
    counts = keys.groupBy("anchor").count().filter(F.col("count") > GROUP)
    # written rather than checkpointed: the size is then known, and Spark broadcasts it only if it is small
    large = written(counts.select("anchor", F.ceil(F.col("count") / GROUP).cast("int").alias("chunks")), "large-anchors")
    # an anchor of n points falls into c chunks, and the points of chunk i meet those of chunk j in group (i, j), i <= j
    split = rows.join(large, "anchor", "left").withColumn("c", F.coalesce("chunks", F.lit(1)))
    split = split.withColumn("i", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    split = split.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    group = F.when(F.col("c") == 1, F.col("anchor").cast("long")).otherwise(F.xxhash64("anchor", F.least("i", "j"), F.greatest("i", "j")).bitwiseOR(F.lit(-1 << 63)))
    dealt = split.select(group.alias("group"), "owner", *rest).repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_groups(most_bits, similarity), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``, root the smallest node reachable.

    Rounds of large star and small star until nothing changes, which takes a number of rounds in the square of the
    logarithm of the nodes at most. Edges are cut off from their lineage in the shared folder after each round, and the
    edges of a large star are dealt over ``SALT`` tasks.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int")
    every = F.sequence(F.lit(0), F.lit(SALT - 1))

    def met(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.withColumn("s", salt).join(least.withColumn("s", F.explode(every)), ["a", "s"])

    def mark(rows: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(rows.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())

    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := mark(now)) != before:
        before = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = met(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = met(large, small).select("b", "m").unionAll(small.select(F.col("a").alias("b"), "m"))
        now = cut(star.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, most_bits: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs(doc_id, text)``.

    Rows are linked when their fingerprints differ in at most ``most_bits`` bits; component_id is the
    smallest doc_id reachable. Null, empty and blank texts have fingerprint 0 and are linked like any
    other. Null doc_ids are kept, and are passed over in choosing component_id, which is null only where
    a component has no other; rows that repeat a doc_id each get a row. An empty table gives an empty
    result; other columns of ``docs`` are ignored.
    """
    found = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words_per_shingle), "fingerprints")
    points = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")))
    labels = components(near_edges(points, most_bits))
    rooted = points.select("fp", "least", F.col("node").alias("p")).join(labels, F.col("p") == labels["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id"))
    return found.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7)


POINT = ("fp", "node", "n", "low", "high")


def _points(words_per_shingle: int):
    """Of every row fingerprint, a hash of the set of shingles, which is the number of the point, its size and sketch; and in last rows the task's counts of buckets, ``PIECE`` in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.zeros(BUCKETS, np.int64), None
        for b in chunks(batches):
            hashes = [shingle_hashes(x.as_py(), words_per_shingle) for x in b.column("text")]
            sets = [shingle_set(h) for h in hashes]
            total += np.bincount((np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            low, high = zip(*map(sketch, sets), strict=True)
            unsigned = [[fingerprint(h) for h in hashes], [_node(x) for x in sets], list(map(len, sets)), low, high]
            key = b.column("key")
            yield pa.RecordBatch.from_arrays([key, *(pa.array(np.array(v, np.uint64).view(np.int64)) for v in unsigned), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names=["key", *POINT, "piece", "buckets"])
        if key is not None:
            pieces = [x.astype("<i8").tobytes() for x in np.split(total, range(PIECE, BUCKETS, PIECE))]
            n = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, key.type), *(pa.nulls(n, pa.int64()) for _ in POINT), pa.array(range(n), pa.int32()), pa.array(pieces, pa.binary())], names=["key", *POINT, "piece", "buckets"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column("piece").to_pylist(), b.column("buckets"), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(raw.as_py(), "<i8")
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "buckets"])


def bucket_counts(made: DataFrame) -> np.ndarray:
    """The tasks' counts in ``made(piece, buckets)`` added up where they are; the driver gets the sums alone, in small rows."""
    counts = np.zeros(BUCKETS, np.int64)
    sums = made.filter("buckets is not null").select("piece", "buckets").repartition(16, "piece").mapInArrow(_added, "piece int, buckets binary")
    for r in sums.collect():
        counts[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["buckets"], "<i8")
    return counts


def prefix(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set of which it shares one with any set that is similar; rare ones first."""
    n = len(shingles)
    order = np.lexsort((shingles, counts[(shingles % np.uint64(BUCKETS)).astype(np.int64)]))
    return shingles[order[: n - math.ceil(similarity * n - 1e-9) + 1]]


def _prefixes(shipped, words_per_shingle: int, similarity: float, meeting: int, remembered: int):
    """The points at each shingle of their prefixes. A shingle where many meet has groups of chunks, of which each point is in as many as there are chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shipped.value, set()
        noise = counts.mean()  # what other shingles add to the count of a bucket
        for b in chunks(batches):
            fronts, points = [], []
            for t in b.column("text"):
                x = shingle_set(shingle_hashes(t.as_py(), words_per_shingle))
                node = _node(x)
                if node in seen or not len(x):
                    continue
                if len(seen) < remembered:
                    seen.add(node)  # copies that this task meets later would say the same
                fronts.append(prefix(x, counts, similarity))
                points.append((node, len(x), *sketch(x)))
            if not points:
                continue
            token = np.concatenate(fronts)
            point = np.repeat(np.array(points, np.uint64).view(np.int64), [len(f) for f in fronts], axis=0)
            many = 1 + np.maximum(0, (counts[(token % np.uint64(BUCKETS)).astype(np.int64)] - noise) // meeting).astype(np.int64)
            group = token.view(np.int64).copy()
            if (many > 1).any():
                row = np.repeat(np.arange(len(token)), many)
                c, j = many[row], np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                i = point[row, 0].view(np.uint64) % c.astype(np.uint64)
                pair = np.minimum(i.astype(np.int64), j) * c + np.maximum(i.astype(np.int64), j)
                group = np.where(c > 1, (token[row] ^ ((pair.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64), group[row])
                point = point[row]
            yield pa.RecordBatch.from_arrays([pa.array(group), *(pa.array(np.ascontiguousarray(v)) for v in point.T)], names=["group", "node", "n", "low", "high"])

    return run


def _meetings(similarity: float):
    """Edges of a spanning forest of the points alike in each group, from rows sorted by group and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, node, size, low, high in whole_groups(batches):
            alone = np.concatenate([[True], (group[1:] != group[:-1]) | (node[1:] != node[:-1])])  # one row of each point
            first, n = _bounds(group[alone])
            place = np.flatnonzero(alone)[np.repeat(n > 1, n)]
            if not len(place):
                continue
            group, node, size, low, high = (v[place] for v in (group, node, size, low, high))
            alike = Alike(similarity, size, low.view(np.uint64), high.view(np.uint64))

            yield _linked(node, _near_pairs(group, alike, np.ones(len(node), bool)))

    return run


def similar_sets(sets: list[np.ndarray], counts: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of all pairs of sorted sets whose Jaccard similarity is ``similarity`` or more."""
    fronts = [prefix(x, counts, similarity) for x in sets]
    token = np.unique(np.concatenate(fronts), return_inverse=True)[1].astype(np.int32)
    shared = np.bincount(token) > 1
    fronts = [f[shared[f]] for f in np.split(token, np.cumsum([len(f) for f in fronts])[:-1])]
    at: dict[int, list[int]] = {}
    for i, front in enumerate(fronts):
        for t in front.tolist():
            at.setdefault(t, []).append(i)
    waiting = [True] * len(sets)
    for root in range(len(sets)):
        if not waiting[root]:
            continue
        waiting[root] = False
        reached = [root]
        while reached:
            i = reached.pop()
            others = set()
            for t in fronts[i].tolist():
                at[t] = [j for j in at[t] if waiting[j]]
                others.update(at[t])
            x, n = sets[i], len(sets[i])
            for j in others:
                y = sets[j]
                m = len(y)
                if min(n, m) < similarity * max(n, m) - 1e-6:
                    continue
                both = int((x[np.minimum(np.searchsorted(x, y), n - 1)] == y).sum())
                if both / (n + m - both) >= similarity:
                    waiting[j] = False
                    reached.append(j)
                    yield i, j


def _verified(shipped, words_per_shingle: int, similarity: float):
    """Edges of texts with similar sets from rows sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        group, nodes, sets = None, [], []

        def edges() -> pa.RecordBatch:
            found = np.array(list(similar_sets(sets, counts, similarity)), np.int64).reshape(-1, 2)
            node = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], names=["a", "b"])

        for b in chunks(batches):
            for g, node, x in zip(*(b.column(c).to_pylist() for c in ("group", "node", "text")), strict=True):
                if g != group:
                    if len(nodes) > 1:
                        yield edges()
                    group, nodes, sets = g, [], []
                nodes.append(node)
                sets.append(shingle_set(shingle_hashes(x, words_per_shingle)))
        if len(nodes) > 1:
            yield edges()

    return run


def similar_edges(keyed: DataFrame, found: DataFrame, counts: np.ndarray, words_per_shingle: int, most_bits: int, similarity: float) -> DataFrame:
    """Edges (a, b) among the nodes of ``found`` (see ``_points``) that connect all whose texts in ``keyed(key, text)`` are similar.

    Sets of shingles are made anew where they are needed: they take more room than the texts.
    """
    shipped = keyed.sparkSession.sparkContext.broadcast(counts)
    fronts = keyed.select("text").mapInArrow(_prefixes(shipped, words_per_shingle, similarity, MEETING, SEEN), "group long, node long, n long, low long, high long")
    meetings = fronts.repartition("group").sortWithinPartitions("group", "node").mapInArrow(_meetings(similarity), "a long, b long")
    near = near_edges(cut(found.select(*POINT).distinct()), most_bits, similarity)
    labels = components(near.unionAll(meetings))
    labels = labels.unionAll(labels.select(F.col("root").alias("node"), "root").distinct())
    # one copy of each set that has a candidate; large components fall into chunks that meet pairwise
    first = labels.join(found.groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n")), "node")
    sizes = first.groupBy("root").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("c"))
    members = written(first.join(sizes, "root").select("key", "node", "root", "c"), "candidates")
    split = keyed.join(build_side(members), "key").withColumn("i", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    split = split.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    group = F.when(F.col("c") == 1, F.col("root")).otherwise(F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")))
    dealt = split.select(group.alias("group"), "node", "text").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_verified(shipped, words_per_shingle, similarity), "a long, b long")


def deduplicate(docs: DataFrame, words_per_shingle: int = 5, most_bits: int = 7, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component: the first by doc_id, nulls last, then by a hash of the row.

    Rows are linked when the Jaccard similarity of their sets of shingles is ``similarity`` or more; every such pair
    is found. A text of fewer words than a shingle has the whole sequence as its one shingle; null, empty and blank texts
    have none and are copies of one another, so that one of them stays. Very long texts are compared whole. Only keys take
    part in the choice; rows cross the network once, to meet the keys of those that go, and are not sorted. Rows that are
    equal in every column count as copies of one another. An empty table gives an empty result; columns are those of ``docs``,
    whatever their names.
    """
    ensure_importable(docs.sparkSession)
    every = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*every).alias("_all"), "doc_id", "text", F.xxhash64(*every).alias("_tie"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_tie"))
    keyed = marked.select(key.alias("key"), "text")
    kind = keyed.schema["key"].dataType.simpleString()
    # equal sets: one point
    made = written(keyed.mapInArrow(_points(words_per_shingle), f"key {kind}, " + "".join(f"{c} long, " for c in POINT) + "piece int, buckets binary"), "fingerprints")
    found = made.filter("buckets is null").drop("piece", "buckets")
    counts = bucket_counts(made)
    labels = components(similar_edges(keyed, found, counts, words_per_shingle, most_bits, similarity)).select(F.col("node").alias("n"), "root")
    points = found.groupBy("node").agg(F.min("key").alias("first"))
    rooted = points.join(labels, F.col("node") == F.col("n"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    of = cut(rooted.select("node", "root").join(stay, "root").select("node", "stays"))
    gone = written(found.select("key", "node").join(of, "node").filter("key <> stays").select(F.col("key.doc_id").alias("_id"), F.col("key._tie").alias("_gone")), "duplicates")
    kept = marked.join(build_side(gone), marked["doc_id"].eqNullSafe(gone["_id"]) & (marked["_tie"] == gone["_gone"]), "left_anti")
    same = written(found.groupBy("key").count().filter("count > 1").select(F.col("key.doc_id").alias("_id"), F.col("key._tie").alias("_same")), "equal-rows")
    if same.isEmpty():
        return kept.select("_all.*")
    equal = marked["doc_id"].eqNullSafe(same["_id"]) & (marked["_tie"] == same["_same"])
    once = kept.join(same, equal, "left_semi").dropDuplicates(["doc_id", "_tie"])
    return kept.join(same, equal, "left_anti").unionByName(once).select("_all.*")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components over all documents."""
    from plazaflow.session import table

    return near_duplicates(table(spark, sf_dir, "documents"))
