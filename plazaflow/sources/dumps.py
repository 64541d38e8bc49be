"""Monthly dumps: zstd-compressed JSON lines, one file a kind and month.

Such dumps are one zstd frame with a window of up to 2**31 bytes, which Spark's text reader refuses, so
a Python data source reads them: a partition a file, in pieces of bounded size. A frame can't be
entered in the middle; on a cluster the files are many. Spark lists the files; a path with a scheme is
opened by pyarrow's file systems (hdfs, s3, gs and others), any other as a local file.

A file that cannot be read does not stop the others: its lines end with one row that says what happened
(``problem``, a status of the ledger, and ``error``). A frame that is no zstd data is an ``error`` and gives no records;
a read that fails half way is ``partial`` and what was read is kept; a file that is gone is ``source_missing``; one
that takes longer than its size allows is ``stalled``.
"""

from __future__ import annotations

import io
import json
import os
import re
import time
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plazaflow.functions.coerce import coerced
from plazaflow.functions.months import is_truncated
from plazaflow.schemas import KINDS, SCHEMAS, TRUNCATED_AFTER_DAYS
from plazaflow.session import written

NAME = re.compile(r"(RC|RS)_(\d{4})-(\d{2})\.zst$")
WINDOW = 2**31
PIECE = 16 << 20
#: Seconds that a file may take: so many for each GB of it, and so many at least.
SECONDS_PER_GB, LEAST_SECONDS = 240.0, 1800.0
LINES = "file string, line_no bigint, value string, terminated boolean, problem string, error string"
LINE_SCHEMA = pa.schema([("file", pa.string()), ("line_no", pa.int64()), ("value", pa.string()), ("terminated", pa.bool_()), ("problem", pa.string()), ("error", pa.string())])


def _open(path: str) -> tuple[Any, int]:
    """The file and its size."""
    if "://" not in path:
        local = path.removeprefix("file:")
        return open(local, "rb"), os.path.getsize(local)
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None), system.get_file_info(inner).size or 0


def _gone(path: str) -> bool:
    try:
        _open(path)[0].close()
    except OSError:
        return True
    return False


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.limit = int(options.get("limitbytes", options.get("limitBytes", "0")))
        self.per_gb, self.least = (float(options.get(k.lower(), options.get(k, v))) for k, v in (("secondsPerGb", SECONDS_PER_GB), ("leastSeconds", LEAST_SECONDS)))

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        """The lines of a file, and a row without a value where it has none or cannot be read."""
        import zstandard

        name, number, rest, taken = os.path.basename(partition.path), 0, b"", 0
        began = time.monotonic()

        def batch(lines: list[bytes], terminated: bool) -> pa.RecordBatch:
            nonlocal number
            values = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
            first, number = number, number + len(lines)
            n = len(lines)
            return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(first, number), pa.int64()), values, pa.array([terminated] * n), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], schema=LINE_SCHEMA)

        def last(problem: str | None = None, error: str | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": name, "terminated": True, "problem": problem, "error": error}], schema=LINE_SCHEMA)

        try:
            raw, size = _open(partition.path)
        except OSError as e:
            yield last("source_missing", f"cannot be opened: {e}")
            return
        allowed = max(self.least, self.per_gb * size / 1e9)
        try:
            with raw, zstandard.ZstdDecompressor(max_window_size=WINDOW).stream_reader(raw, read_across_frames=True) as stream:
                while piece := stream.read(PIECE):
                    taken += len(piece)
                    *lines, rest = (rest + piece).split(b"\n")
                    if lines:
                        yield batch(lines, True)
                    if self.limit and taken >= self.limit:
                        return
                    if time.monotonic() - began > allowed:
                        yield last("stalled", f"not read in {allowed:.0f} seconds; {taken} bytes of text came")
                        return
        except zstandard.ZstdError as e:
            yield last("error", f"no valid zstd data after {taken} bytes of text: {e}")
            return
        except OSError as e:
            if _gone(partition.path):
                yield last("source_missing", f"went away while it was read: {e}")
            else:
                yield last("partial", f"could not be read beyond {taken} bytes of text: {e}")
            return
        if rest.strip():
            yield batch([rest], False)
        elif not number:
            yield last()


class DumpSource(DataSource):
    """Format ``discussion_dump``: options paths (a JSON list), limitBytes (of decompressed text a file; 0: all), secondsPerGb and leastSeconds."""

    @classmethod
    def name(cls) -> str:
        return "discussion_dump"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_dumps(spark: SparkSession, paths: list[str], limit_bytes: int = 0) -> DataFrame:
    """file, line_no, value and terminated (false for a last line without its newline) of every line; a row without a value says what is wrong with its file, or that it is empty."""
    from plazaflow.session import ensure_importable

    ensure_importable(spark)
    spark.dataSource.register(DumpSource)
    return spark.read.format("discussion_dump").option("paths", json.dumps(paths)).option("limitBytes", str(limit_bytes)).load()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_dumps`` for files that Spark's text reader can open, with any path and splittable where not compressed; lines are not numbered."""
    return spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.lit(None).cast("bigint").alias("line_no"), "value", F.lit(True).alias("terminated"), *[F.lit(None).cast("string").alias(c) for c in ("problem", "error")])


def list_dumps(spark: SparkSession, root: str) -> DataFrame:
    """file, path, bytes, in_folder of the dumps under ``root`` and its folders comments and submissions. Nothing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "R[CS]_*.zst").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path", "bytes", F.col("path").rlike("/(comments|submissions)/[^/]+$").alias("in_folder"))


def collect_jobs(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """The expected files with the path found for each, that in its kind's folder first; null path: missing."""
    best = listing.groupBy("file").agg(F.max_by(F.struct("path", "bytes"), F.struct(F.col("in_folder"), F.col("path"))).alias("x")).select("file", "x.path", "x.bytes")
    return expected.join(best, "file", "left")


def name_parts(file: Column) -> dict[str, Column]:
    """kind, year and month of a dump's file name."""
    prefix = F.regexp_extract(file, NAME.pattern, 1)
    kind = F.when(prefix == "RC", KINDS["RC"]).when(prefix == "RS", KINDS["RS"])
    return {"kind": kind, "year": F.regexp_extract(file, NAME.pattern, 2).try_cast("int"), "month": F.regexp_extract(file, r"(\d{4}-\d{2})\.", 1)}


def wanted_prefilter(names: list[str]) -> str:
    """A regular expression that a line of a wanted source fits, in any case; it costs less than parsing the line."""
    return r'(?i)"subreddit"\s*:\s*"(?:' + "|".join(re.escape(n) for n in sorted(names)) + ')"'


def parse(lines: DataFrame, kind: str) -> DataFrame:
    """The lines with ``bad`` (no valid JSON object) and the kind's columns, typed. Keys that are missing are null, other keys are dropped."""
    schema = SCHEMAS[kind]
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("_j", F.from_json("value", raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("value").isNotNull() & (F.col("_j").isNull() | F.col("_j._bad").isNotNull())
    return parsed.select(*lines.columns, bad.alias("bad"), *[coerced(F.col(f"_j.{f.name}"), f.dataType).alias(f.name) for f in schema])


def _source(wanted: list[str]) -> Column:
    """The name as it was asked for of a wanted source, else null."""
    asked = F.create_map(*[x for n in wanted for x in (F.lit(n.lower()), F.lit(n))])
    return F.try_element_at(asked, F.lower("subreddit"))


def extract(lines: DataFrame, kind: str, wanted: list[str]) -> DataFrame:
    """The records of the wanted sources, ``source`` being the name as it was asked for. A record that only mentions a source is not one of it."""
    found = parse(lines.filter(F.col("value").rlike(wanted_prefilter(wanted))), kind).filter(~F.col("bad"))
    return found.withColumn("source", _source(wanted)).filter("source is not null").drop("bad", "value", "terminated", "problem", "error")


def staged(lines: DataFrame, kind: str, wanted: list[str]) -> DataFrame:
    """What records and verdicts are both made of, from one reading of the lines: file, problem, error, terminated, bad, created_utc, and of
    wanted records source and record."""
    p = parse(lines, kind)
    source = F.when(~F.col("bad"), _source(wanted))
    record = F.when(source.isNotNull(), F.struct(*[F.col(f.name) for f in SCHEMAS[kind]]))
    return p.select("file", "problem", "error", "terminated", "bad", "created_utc", source.alias("source"), record.alias("record"))


def records(stage: DataFrame) -> DataFrame:
    """The wanted records of ``staged`` rows, with file and source; a file that is an ``error`` or was not there gives none."""
    spoilt = stage.filter(F.col("problem").isin("error", "source_missing")).select("file").distinct()
    return stage.filter("source is not null").join(F.broadcast(spoilt), "file", "left_anti").select("file", "record.*", "source")  # a row a file at most


def judge(stage: DataFrame, limited: bool = False) -> DataFrame:
    """A ledger record a file of ``staged`` rows: status, error, rows by source, bad lines, first and last time.

    What the reader says of a file stands. Else the last line may lack its newline if it is whole, and a month whose
    data stop more than two days before its end is truncated. Times are those of all its records.
    """
    hit = F.col("source").isNotNull()
    per = stage.groupBy("file").agg(
        F.max("problem").alias("problem"), F.max("error").alias("_error"),
        F.count_if(F.col("bad") & F.col("terminated")).alias("bad_json"),
        F.max(F.col("bad") & ~F.col("terminated")).alias("_cut"),
        F.min("created_utc").alias("first_ts"), F.max("created_utc").alias("last_ts"), F.count_if(hit).alias("rows_total"),
    )
    rows = stage.filter(hit).groupBy("file", F.lower("source").alias("s")).agg(F.count("*").alias("n")).groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("rows"))
    parts = name_parts(F.col("file"))
    late = F.coalesce(is_truncated(parts["month"], F.col("last_ts"), TRUNCATED_AFTER_DAYS), F.lit(False))
    status = F.lit("partial_test") if limited else F.when(F.col("_cut") | late, "truncated").otherwise("ok")
    error = F.when(F.col("_cut"), "the last record is cut off").when(late, F.concat(F.lit("no record after "), F.date_format(F.timestamp_seconds("last_ts"), "yyyy-MM-dd HH:mm")))
    none = F.create_map().cast("map<string,bigint>")
    error = F.lit(None).cast("string") if limited else error
    return per.join(rows, "file", "left").select("file", parts["kind"].alias("kind"), F.coalesce("problem", status).alias("status"), F.when(F.col("problem").isNotNull(), F.col("_error")).otherwise(error).alias("error"), F.coalesce("rows", none).alias("rows"), "rows_total", "bad_json", "first_ts", "last_ts")


def verdicts(lines: DataFrame, kind: str, wanted: list[str], limited: bool = False) -> DataFrame:
    """``judge`` of the lines."""
    return judge(staged(lines, kind, wanted), limited)


def write_dumps(lines: DataFrame, root: str) -> DataFrame:
    """Write ``lines(file, line_no, value)`` as one dump a file under ``root`` and return file and lines written of each.

    A file's lines are streamed by one task, as a reader will stream them; it is written beside and moved into place, so
    that a task that runs again replaces what it left.
    """
    from plazaflow.session import ensure_importable

    ensure_importable(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard

        system, inner = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:")))
        system.create_dir(inner, recursive=True)
        name, number, out, raw, temporary = None, 0, None, None, ""

        def close() -> pa.RecordBatch:
            out.close()
            raw.close()
            system.move(temporary, f"{inner}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64())], names=["file", "lines"])

        for b in batches:
            for file, value in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                if file != name:
                    if name is not None:
                        yield close()
                    name, number, temporary = file, 0, f"{inner}/.{file}-{uuid.uuid4().hex}"
                    raw = system.open_output_stream(temporary, compression=None)
                    out = zstandard.ZstdCompressor(level=3).stream_writer(raw, closefd=False)
                out.write(value.encode() + b"\n")
                number += 1
        if name is not None:
            yield close()

    return written(lines.select("file", "line_no", "value").repartition("file").sortWithinPartitions("file", "line_no").mapInArrow(run, "file string, lines bigint"), "dumps-written")


def write_dump(path: str, lines: list[str], last_newline: bool = True, window_log: int = 27) -> None:
    """A small dump, for tests and trials."""
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(3, window_log=window_log)
    data = "\n".join(lines) + ("\n" if last_newline and lines else "")
    with open(path, "wb") as f, zstandard.ZstdCompressor(compression_params=params).stream_writer(f) as out:
        out.write(io.BytesIO(data.encode()).getvalue())
