"""Byte-level byte-pair encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry
costs one probe and one comparison. Tier two merges the bytes of any other pre-token, held as a
doubly linked list, by a heap of (rank, position).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.token_blocks import chunks
from plazaflow.session import ensure_importable

#: Distinct pre-tokens whose ids a worker remembers; others are encoded again when they come back.
REMEMBERED = 400_000


class PerfectHash:
    """Minimal perfect hash by hash and displace: keys fall into buckets, largest first; each bucket's
    displacement is the first that sends all its keys to free slots; buckets of one key name their slot."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64)
        bucket = low % self.buckets
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(count) - count
        taken = np.zeros(n, bool)
        self.displace = [0] * self.buckets
        slot = np.zeros(n, np.int64)
        free: Iterator[int] | None = None
        for b in np.argsort(-count, kind="stable"):
            k = order[first[b] : first[b] + count[b]]
            if len(k) > 1:
                d = 1
                while True:
                    at = (high[k] ^ (d * 0x9E3779B1 & 0xFFFFFFFF)) * 0x45D9F3B1 % 0x7FFFFFFF % n
                    if not taken[at].any() and len(set(at.tolist())) == len(k):
                        break
                    d += 1
                self.displace[b], slot[k] = d, at
                taken[at] = True
            elif len(k):
                free = free or iter(np.flatnonzero(~taken).tolist())
                slot[k[0]] = at = next(free)
                self.displace[b] = -1 - at
            else:
                break
        self.ids = [0] * n
        self.keys = [b""] * n
        for i, s in enumerate(slot.tolist()):
            self.ids[s], self.keys[s] = i, keys[i]

    def find(self, key: bytes) -> int:
        """The key's place in the list it was built from, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.displace[(h & 0xFFFFFFFF) % self.buckets]
        at = -1 - d if d < 0 else ((h >> 32) ^ (d * 0x9E3779B1 & 0xFFFFFFFF)) * 0x45D9F3B1 % 0x7FFFFFFF % self.n
        return self.ids[at] if self.keys[at] == key else -1


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    return [found[i] for i in range(len(found))]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: of adjacent pairs the one of lowest rank, leftmost on ties, is merged until none is left."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
    before = list(range(-1, n))
    rank_of = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank_of(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := rank_of(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


#: Characters of a text that are split into pre-tokens at once.
PIECE = 1 << 20


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE`` characters, cut before single blanks between other characters: a pre-token always starts there."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash | None = None, remembered: int = REMEMBERED):
        import regex

        self.remembered = remembered

        self.tokens = tokens
        self.table = table or PerfectHash(tokens)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.fresh: list[str] = []  # of the known words those beyond the number that is remembered

    def pre_token(self, word: bytes) -> list[int]:
        found = self.table.find(word)
        return [found] if found >= 0 else merge(word, self.ranks)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if text and len(text) > PIECE:
                out.append(np.concatenate([ids for piece in pieces(text) for ids in self._encode([piece])]))
            else:
                out += self._encode([text])
        return out

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        known, out = self.known, []
        for text in texts:
            words = self.split(text) if text else []
            try:
                ids = b"".join(map(known.__getitem__, words))
            except KeyError:
                for w in words:
                    if w not in known:
                        known[w] = np.array(self.pre_token(w.encode()), "<u4").tobytes()
                        if len(known) > self.remembered:
                            self.fresh.append(w)
                ids = b"".join(map(known.__getitem__, words))
            out.append(np.frombuffer(ids, "<u4"))
            if len(self.fresh) > 20_000:
                for w in self.fresh:
                    del known[w]
                self.fresh.clear()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _codec(tokens: list[bytes], pattern: str, table: PerfectHash, remembered: int, made: dict = {}) -> Codec:  # noqa: B006
    """One codec a worker, so that what it has learned serves later tasks too."""
    key = (len(tokens), pattern, hash(tokens[-1]) if tokens else 0, remembered)
    if key not in made:
        made.clear()
        made[key] = Codec(tokens, pattern, table, remembered)
    return made[key]


def round_trip(docs: DataFrame, ranks: str, pattern: str, texts: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Encode and decode every text of ``docs(doc_id, text)``, in one map over the rows and without a shuffle.

    Gives doc_id, n_tokens, ids_sha256, decoded_sha256; with ``texts`` every other column of ``docs``
    too, ``text`` being the decoded one, and the ids. A null text counts as empty (no ids, digests of
    the empty string); rows that repeat are each encoded; an empty table gives an empty result. Columns
    of ``docs`` that bear a result's name give way to it. The vocabulary that is broadcast has a fixed size.
    remembered: distinct pre-tokens whose ids a worker keeps, about 200 bytes each; it changes no result.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    tokens = read_ranks(ranks)
    shipped = spark.sparkContext.broadcast((tokens, PerfectHash(tokens)))
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = [c for c in docs.columns if c not in [*made, "ids"]] if texts else ["doc_id"]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if texts else ["text"]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in keep]).schema), "n_tokens long, ids_sha256 string, decoded_sha256 string", *(["ids array<int>"] if texts else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value[0], pattern, shipped.value[1], remembered)
        decimal = [b"%d" % i for i in range(len(codec.tokens))]
        for b in chunks(batches):
            encoded = codec.encode(b.column("text").to_pylist())
            decoded = [codec.decode(ids) for ids in encoded]
            got = [
                pa.array([len(x) for x in encoded], pa.int64()),
                pa.array([hashlib.sha256(b",".join(map(decimal.__getitem__, x.tolist()))).hexdigest() for x in encoded], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            ]
            columns = [pa.array(decoded, pa.binary()).cast(pa.string()) if texts and c == "text" else b.column(c) for c in keep]
            ids = [pa.array(encoded, pa.list_(pa.int32()))] if texts else []
            yield pa.RecordBatch.from_arrays([*columns, *got, *ids], names=[*keep, *made, *["ids"] * texts])

    return rows.mapInArrow(run, schema)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers as P

    from plazaflow.session import table

    return round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
