"""Token ids in patched frame-of-reference blocks.

A shard is a run of *segments*; a segment holds whole documents and is one row of a Parquet
table (``shard, seq, start, n_ids, doc_ids, payload``), so that Spark's commit protocol makes a
lost executor's half-written output vanish and any store Spark can write to will do. Layout of
``payload``, little endian:

    b"PFB1" | u32 n_ids | u32 n_docs | u32 n_blocks
    u32 length of each document, end id included
    u32 start of each block in the body | u32 minimum | u8 width | u16 exceptions, of each block
    body: for each block 256 values less the minimum, their low ``width`` bits packed;
          then u8 positions and u32 high parts of the exceptions

The width of a block is the number of bits of its 90th percentile.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import scratch
from plazaflow.llm.word_table import WordTable
from plazaflow.session import ensure_importable

BLOCK = 256
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 18
MAGIC = b"PFB1"
#: Distinct words whose ids a worker remembers; others are encoded again when they come back.
REMEMBERED = 1_500_000

SEGMENTS = "shard int, seq int, start long, n_ids long, doc_ids array<long>, payload binary"


def pack(ids: np.ndarray, lengths: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A segment's payload. ids: of all its documents, below 2**32; lengths: ids of each document."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = struct.pack("<4sIII", MAGIC, n, len(lengths), blocks) + lengths.astype("<u4").tobytes()
    if not n:
        return head
    x = np.full(blocks * BLOCK, ids[-1], np.uint32)  # the last block is filled up with the last id
    x[:n] = ids
    x = x.reshape(blocks, BLOCK)
    least = x.min(axis=1)
    x -= least[:, None]
    pivot = np.sort(x, axis=1)[:, min(BLOCK - 1, int(percentile * BLOCK))]
    width = np.frexp(pivot.astype(np.float64))[1].astype(np.uint8)  # bits of the pivot; 0 for 0
    high = x >> np.minimum(width, 31)[:, None]
    high[width == 32] = 0
    rows, cols = np.nonzero(high)
    n_exc = np.bincount(rows, minlength=blocks)
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.concatenate([[0], np.cumsum(size + 5 * n_exc)])
    body = np.zeros(start[-1], np.uint8)
    for w in np.unique(width):
        if w:
            k = np.flatnonzero(width == w)
            bits = (x[k][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
            body[start[k][:, None] + np.arange(size[k[0]])] = np.packbits(bits.astype(np.uint8).reshape(len(k), -1), axis=1, bitorder="little")
    if len(rows):
        rank = np.arange(len(rows)) - np.concatenate([[0], np.cumsum(n_exc)])[rows]
        at = start[rows] + size[rows]
        body[at + rank] = cols
        value = high[rows, cols].astype("<u4").view(np.uint8).reshape(-1, 4)
        body[(at + n_exc[rows] + 4 * rank)[:, None] + np.arange(4)] = value
    return b"".join([head, start[:-1].astype("<u4").tobytes(), least.astype("<u4").tobytes(), width.tobytes(), n_exc.astype("<u2").tobytes(), body.tobytes()])


class Segment:
    """Reads a payload. ``block(k)`` decodes one block alone, by the index of block starts."""

    def __init__(self, payload: bytes):
        magic, self.n_ids, n_docs, self.blocks = struct.unpack_from("<4sIII", payload)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = 16
        self.lengths = np.frombuffer(payload, "<u4", n_docs, at)
        at += 4 * n_docs
        self.starts = np.frombuffer(payload, "<u4", self.blocks, at).astype(np.int64)
        self.least = np.frombuffer(payload, "<u4", self.blocks, at + 4 * self.blocks)
        self.width = np.frombuffer(payload, np.uint8, self.blocks, at + 8 * self.blocks)
        self.n_exc = np.frombuffer(payload, "<u2", self.blocks, at + 9 * self.blocks).astype(np.int64)
        self.body = np.frombuffer(payload, np.uint8, offset=at + 11 * self.blocks)

    def _decode(self, ks: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ks), BLOCK), np.uint32)
        for w in np.unique(self.width[ks]):
            if w:
                sel = np.flatnonzero(self.width[ks] == w)
                raw = self.body[self.starts[ks[sel]][:, None] + np.arange(int(w) * BLOCK // 8)]
                bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(-1, w)
                wide = np.zeros((len(bits), 32 if w > 16 else 16), np.uint8)
                wide[:, :w] = bits
                out[sel] = np.packbits(wide, axis=1, bitorder="little").view("<u4" if w > 16 else "<u2").reshape(len(sel), BLOCK)
        n = self.n_exc[ks]
        if n.any():
            row = np.repeat(np.arange(len(ks)), n)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = (self.starts[ks] + self.width[ks].astype(np.int64) * (BLOCK // 8))[row]
            col = self.body[at + rank]
            high = self.body[(at + n[row] + 4 * rank)[:, None] + np.arange(4)].copy().view("<u4").ravel()
            out[row, col] |= high << self.width[ks][row].astype(np.uint32)
        return out + self.least[ks][:, None]

    def block(self, k: int) -> np.ndarray:
        return self._decode(np.array([k]))[0][: self.n_ids - k * BLOCK]

    def ids(self) -> np.ndarray:
        return self._decode(np.arange(self.blocks)).ravel()[: self.n_ids]


class WordEncoder:
    """Ids of texts by a tokenizer whose tokens never cross white space.

    Each distinct word between ASCII white space goes through the tokenizers library once and
    is remembered; a text's ids are its words' ids joined. Special tokens' strings in a text are
    ordinary text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.table = WordTable(self._encode_each, REMEMBERED)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.table.encode([(x or "").encode("utf-8", "replace") for x in texts])

    def _encode_each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words go through the tokenizer as one text; a token belongs to the word it starts in."""
        text = b" ".join(words).decode()
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        begins = np.fromiter(map(itemgetter(0), found.offsets), np.int64, len(ids))
        size = np.fromiter(map(len, text.split(" ")), np.int64, len(words))
        ends = np.searchsorted(begins, np.cumsum(size + 1) - 1)  # tokens that start before the blank after the word
        return ids, np.diff(ends, prepend=0)


def word_encoder(path: str, made: dict[str, WordEncoder] = {}) -> WordEncoder:  # noqa: B006
    """One encoder a worker, so that what it has learned serves later tasks too."""
    if path not in made:
        made.clear()
        made[path] = WordEncoder(path)
    return made[path]


def chunks(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes at most, one row at least."""
    for b in batches:
        step = max(1, int(b.num_rows * most / max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _encoder(path: str, end_id: int, segment_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq, start = TaskContext.get().partitionId(), 0, 0
        encoder = word_encoder(path)
        schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, size
            lengths = np.array([len(x) for x in held], np.int64)
            payload = pack(np.concatenate(held), lengths)
            out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((shard, seq, start, size, list(docs), payload), schema, strict=True)], schema=schema)
            seq, start, size = seq + 1, start + size, 0
            docs.clear()
            held.clear()
            return out

        end = np.array([end_id], "<u4")
        for b in chunks(batches):
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist()), strict=True):
                docs.append(doc)
                held.append(np.concatenate([ids, end]))
                size += len(ids) + 1
                if size >= segment_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs(doc_id, text)`` and write the shards to ``path``, documents in ascending order of doc_id.

    Shards are ranges of doc_id, so the only shuffle is one range partitioning of the texts. A null
    text counts as empty and yields the end id alone; null doc_ids come first; rows that repeat a
    doc_id follow one another in the order of a hash of their text; an empty table gives no segment;
    columns besides the two are ignored. A document is never split, so a segment exceeds
    ``segment_ids`` by less than one document.
    """
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    rows.mapInArrow(_encoder(vocabulary, end_id, segment_ids), SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def shard_starts(segments: DataFrame) -> dict[int, int]:
    """Ids before each shard. One number a shard comes to the driver; shards are as many as the writing job had tasks."""
    out, total = {}, 0
    for shard, n in sorted(segments.groupBy("shard").agg(F.sum("n_ids")).collect()):
        out[shard] = total
        total += n
    return out


def read_tokens(spark, path: str) -> DataFrame:
    """Per document of the shards in ``path``: doc_id, start, n_tokens, ids_crc32 and shard, all from the decoded ids."""
    ensure_importable(spark)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    starts = shard_starts(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                seg = Segment(r["payload"])
                ids, n = seg.ids().astype("<u4"), seg.lengths.astype(np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e]) for k, e in zip(n, ends, strict=True)]
                first = starts[r["shard"]] + r["start"]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(first + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([r["shard"]] * len(n), pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op1_token_blocks(spark, sf_dir: str) -> DataFrame:
    """Every document encoded, written in the block format and read back."""
    import public_tokenizers

    from plazaflow.session import table

    path = scratch(spark, "token-blocks")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)
