"""Records and counts from a paged HTTP server of monthly archives.

One partition of the data source is one (source, start, end) range; Spark's scheduler is the pool, its
task retry the retry. The client keeps a minimum time between requests, waits out refusals for too many
requests, and backs off exponentially on failures. Tasks cannot share a clock: each keeps as many times the
minimum as tasks can run at once, so that together they stay under the server's ceiling.

An answer that holds an error is a failure like any other: it is asked for again and raised in the end, never
taken for an empty page. A server that says a question took it too long (422) is asked a smaller one.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plazaflow.schemas import SCHEMAS

Fetch = Callable[[str], Any]
#: Seconds of a wait at most, and tries of a request.
LONGEST_WAIT, TRIES = 300.0, 8
#: Seconds of the smallest window of records, and how often such a window may take the server too long.
LEAST_SPAN, LEAST_TRIES = 60, 30
#: The same for counts.
HOUR, HOUR_TRIES = 3_600, 20
#: Records of a page.
PAGE = 100


class TooManyRequests(Exception):
    def __init__(self, wait: float | None = None):
        super().__init__("too many requests")
        self.wait = wait


class BadRequest(Exception):
    pass


class TooLong(Exception):
    """The server gave up on the question; a smaller one may do."""


class ServerError(Exception):
    """An answer that holds an error in place of data."""


def fetch_json(url: str, timeout: float = 60) -> Any:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code == 429:
            reset = e.headers.get("X-RateLimit-Reset") or e.headers.get("Retry-After")
            raise TooManyRequests(float(reset) if reset and reset.isdigit() else None) from e
        if e.code == 400:
            raise BadRequest(str(e)) from e
        if e.code == 422:
            raise TooLong(str(e)) from e
        raise


class Client:
    def __init__(self, base: str, fetch: Fetch = fetch_json, min_interval: float = 0.5, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.base, self.fetch, self.min_interval, self.sleep, self.clock = base.rstrip("/"), fetch, min_interval, sleep, clock
        self.last = float("-inf")
        self.requests = 0

    def get(self, path: str, tries: int = TRIES, smaller: bool = False, **params: Any) -> list[dict]:
        """The data of an answer. A server that refuses ``fields`` is asked without.

        smaller: the caller asks less when a question takes the server too long, so ``TooLong`` is raised at once. Any other
        failure is raised after so many tries.
        """
        for attempt in range(tries):
            wait = self.last + self.min_interval - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last, self.requests = self.clock(), self.requests + 1
            query = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
            try:
                answer = self.fetch(f"{self.base}/{path}?{query}")
                if isinstance(answer, dict) and answer.get("error"):
                    raise ServerError(f"{path}: {answer['error']}")
                return (answer.get("data") if isinstance(answer, dict) else answer) or []
            except BadRequest:
                if params.get("fields") is None:
                    raise
                params["fields"] = None
            except TooManyRequests as e:
                if attempt == tries - 1:
                    raise
                self.sleep(min(LONGEST_WAIT, e.wait or 2.0**attempt))
            except (OSError, ValueError, TooLong, ServerError) as e:
                if attempt == tries - 1 or (smaller and isinstance(e, TooLong)):
                    raise
                self.sleep(min(LONGEST_WAIT, 2.0**attempt))
        raise BadRequest(f"{path}: refused {tries} times")

    def fetch_range(self, kind: str, subreddit: str, start: int, end: int, fields: list[str] | None = None, page: int = PAGE) -> Iterator[dict]:
        """Records of [start, end), ascending, each once.

        Pages are asked for in windows, a quarter as long when one took the server too long and twice as long after an
        answer. The smallest is asked for again with growing waits. The next page starts in the second where the last
        ended, since a second can hold more records than a page has left.
        """
        at, span, seen, failed = start, end - start, set(), 0
        while at < end:
            stop = min(end, at + max(1, span))
            try:
                rows = self.get(f"{kind}/search", smaller=True, subreddit=subreddit, after=at, before=stop, limit=page, sort="asc", fields=",".join(fields) if fields else None)
            except TooLong:
                if span > LEAST_SPAN:
                    span = max(LEAST_SPAN, span // 4)
                    continue
                failed += 1
                if failed >= LEAST_TRIES:
                    raise
                self.sleep(min(120.0, 2.0**failed))
                continue
            failed = 0
            last = at
            fresh = 0
            for r in rows:
                ts = int(float(r.get("created_utc") or 0))
                if r.get("created_utc") is None or not at <= ts < end or r.get("id") in seen:
                    continue
                if ts > last:
                    last, seen = ts, set()
                seen.add(r.get("id"))
                fresh += 1
                yield r
            if len(rows) < page:
                at, seen = (stop, set()) if stop > at else (at + 1, set())
            elif last > at or fresh:
                at = last
            else:
                at += 1  # a second with more records than a page, all seen
            span = min(end - start, span * 2)

    def exact_count(self, kind: str, subreddit: str, start: int, end: int) -> int:
        """Records of [start, end); a range that takes the server too long is counted in four parts, down to an hour, and an hour again after a wait."""
        total, todo, failed = 0, [(start, end)], 0
        while todo:
            a, b = todo.pop()
            try:
                total += sum(int(r.get("count", 0)) for r in self.get(f"{kind}/search/aggregate", tries=4, smaller=True, subreddit=subreddit, after=a, before=b, aggregate="subreddit"))
            except TooLong:
                if b - a > HOUR:
                    step = max(HOUR, -(-(b - a) // 4))
                    todo += [(x, min(b, x + step)) for x in range(a, b, step)]
                    continue
                failed += 1
                if failed > HOUR_TRIES:
                    raise
                self.sleep(min(120.0, 2.0**failed))
                todo.append((a, b))
        return total

    def page_rates(self, kind: str, subreddit: str, start: int, end: int, page: int = PAGE) -> list[tuple[int, int, int]]:
        """(records, seconds that they span, seconds of the range) of three short pages, from its start, its first and its second third.

        A page that is not full spans all that was left. ``counts.estimated_counts`` makes a count of them.
        """
        out = []
        for k in range(3):
            at = start + (end - start) * k // 3
            rows = self.get(f"{kind}/search", subreddit=subreddit, after=at, before=end, limit=page, sort="asc", fields="id,created_utc")
            times = [int(float(r["created_utc"])) for r in rows if r.get("created_utc") is not None and float(r["created_utc"]) < end]
            out.append((len(times), max(times) - at if len(times) >= page else end - at, end - start))
        return out

    def statistics(self, kind: str, subreddit: str, start: str, end: str) -> list[tuple[float, float]]:
        """(time, value) pairs of the server's own monthly statistics."""
        return [(float(r["date"]), float(r["value"])) for r in self.get("time_series", key=f"r/{subreddit}/{kind}/count", after=start, before=end, precision="month")]


class _Range(InputPartition):
    def __init__(self, subreddit: str, start: int, end: int):
        self.subreddit, self.start, self.end = subreddit, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Range(*r) for r in json.loads(self.options["ranges"])]

    def _client(self) -> Client:
        return Client(self.options["url"], min_interval=float(self.options.get("min_interval", "0.5")))

    def read(self, partition: _Range) -> Iterator[tuple]:
        kind = self.options["kind"]
        fields = SCHEMAS[kind].fields
        for r in self._client().fetch_range(kind, partition.subreddit, partition.start, partition.end, [f.name for f in fields]):
            yield tuple(_typed(r.get(f.name), f.dataType) for f in fields)


class _CountReader(_Reader):
    def read(self, partition: _Range) -> Iterator[tuple]:
        kind, sub, start, end = self.options["kind"], partition.subreddit, partition.start, partition.end
        month = time.strftime("%Y-%m", time.gmtime(start))
        client = self._client()
        how = self.options.get("how", "exact")
        if how == "exact":
            yield sub, month, client.exact_count(kind, sub, start, end), None, None, None
        elif how == "rates":
            for rows, seconds, span in client.page_rates(kind, sub, start, end):
                yield sub, month, None, rows, seconds, span
        else:
            raise ValueError("how is 'exact' or 'rates'")


def _typed(v: Any, kind: T.DataType) -> Any:
    """As ``functions.coerce.coerced``, for a value that JSON has already given a type."""
    if v is None:
        return None
    if isinstance(kind, T.LongType):
        try:
            return int(float(v))
        except (TypeError, ValueError, OverflowError):
            return None
    if isinstance(kind, T.BooleanType):
        return v.lower() in ("true", "1") if isinstance(v, str) else bool(v)
    return v if isinstance(v, str) else str(v)


class ArchiveSource(DataSource):
    """Format ``discussion_archive``: options url, kind, ranges (a JSON list of [source, start, end]), min_interval."""

    @classmethod
    def name(cls) -> str:
        return "discussion_archive"

    def schema(self) -> T.StructType:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class CountSource(DataSource):
    """Format ``discussion_counts``: options url, kind, ranges, min_interval and how: exact (n of each range) or rates (of three pages each)."""

    @classmethod
    def name(cls) -> str:
        return "discussion_counts"

    def schema(self) -> str:
        return COUNTS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _CountReader(dict(self.options))


COUNTS = "subreddit string, month string, n bigint, rows bigint, seconds bigint, span bigint"


def _read(spark: SparkSession, source: type[DataSource], ranges: list[tuple[str, int, int]], min_interval: float, **options: str) -> DataFrame:
    from plazaflow.session import ensure_importable

    ensure_importable(spark)
    spark.dataSource.register(source)
    at_once = max(1, min(len(ranges), spark.sparkContext.defaultParallelism))
    return spark.read.format(source.name()).options(ranges=json.dumps([list(r) for r in ranges]), min_interval=str(min_interval * at_once), **options).load()


def read_archive(spark: SparkSession, url: str, kind: str, ranges: list[tuple[str, int, int]], min_interval: float = 0.5) -> DataFrame:
    """Records of the ranges. ``min_interval`` holds for all tasks together."""
    return _read(spark, ArchiveSource, ranges, min_interval, url=url, kind=kind)


def read_counts(spark: SparkSession, url: str, kind: str, ranges: list[tuple[str, int, int]], min_interval: float = 0.5) -> DataFrame:
    """subreddit, month (that of the start) and n, the exact count of each range."""
    return _read(spark, CountSource, ranges, min_interval, url=url, kind=kind, how="exact").select("subreddit", "month", "n")


def read_rates(spark: SparkSession, url: str, kind: str, ranges: list[tuple[str, int, int]], min_interval: float = 0.5) -> DataFrame:
    """What ``counts.estimated_counts`` takes: subreddit, month, rows, seconds and span of three pages of each range."""
    return _read(spark, CountSource, ranges, min_interval, url=url, kind=kind, how="rates").drop("n")
