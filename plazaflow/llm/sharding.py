"""A table of immutable shards with size-tiered compaction, in DataFrame functions only.

``append`` writes arrivals as small shards. A shard's tier is the number of times the growth factor
fits between the smallest tier's size and its own; when a tier has enough shards they are merged into
files of the target size. Every change ends in a manifest ``_versions/v%010d``: a Parquet table of the
shards that belong to the version and the schema of its rows, written beside and renamed into place: of
two writers that start from the same version one gets the name and the other starts again from the new
one. Readers see whole versions only, and shards that no manifest names are not there. Versions stay
readable until ``vacuum`` is asked to delete them.

The rename is atomic on HDFS and on local disks. Object stores copy instead: there, use a table format that
has a commit service of its own, or let one writer at a time commit.

The schema of a version has every column that an arrival ever had; a shard that lacks one reads as null there.

Merging packs files into scan partitions by their size and writes each partition as one file: no
shuffle, so no key can be hot.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "path string, bytes long, rows long, tier int"
MB = 1 << 20


@dataclass(frozen=True)
class Sizes:
    """Sizes of files in bytes: target of merged files, upper end of tier 0, growth of tiers, shards that make a tier full, rows of an arrival's shard at most."""

    target: int = 128 * MB
    smallest: int = 1 * MB
    growth: int = 4
    full: int = 4
    arrival_rows: int = 50_000


def merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """The fields of both, old ones first. A column that comes back with another type, or in other letters' case, is refused."""
    known = {f.name.lower(): f for f in old}
    out = list(old)
    for f in new:
        same = known.get(f.name.lower())
        if same is None:
            out.append(T.StructField(f.name, f.dataType, True))
        elif (same.name, same.dataType) != (f.name, f.dataType):
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} does not go with {same.name} {same.dataType.simpleString()} of the table")
    return T.StructType(out)


class ShardTable:
    def __init__(self, spark: SparkSession, root: str, sizes: Sizes = Sizes()):  # noqa: B008
        self.spark, self.root, self.sizes = spark, root.rstrip("/"), sizes
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, x: str):
        return self._jvm.org.apache.hadoop.fs.Path(x)

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        at = self._path(f"{self.root}/_versions")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version, by default the newest; no rows before the first commit."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self._manifest(known[-1] if version is None else version)

    def _manifest(self, *versions: int) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(*[f"{self.root}/_versions/v{v:010d}/shards" for v in versions])

    def schema(self, version: int | None = None) -> T.StructType:
        """The columns of a version, by default the newest; none before the first commit."""
        known = self.versions()
        if not known:
            return T.StructType()
        path = f"{self.root}/_versions/v{known[-1] if version is None else version:010d}/schema"
        return T.StructType.fromJson(json.loads(self.spark.read.schema("value string").text(path).first()["value"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest, with the columns of its schema. The list of its files comes to the driver, as for any scan."""
        return self._rows(self.spark, [r["path"] for r in self.manifest(version).select("path").collect()], self.schema(version))

    def _rows(self, spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _shards(self, folder: str) -> DataFrame:
        """Manifest rows of the files that a job has just written to ``folder``."""
        files = self.spark.read.parquet(folder).select("_metadata.file_path", "_metadata.file_size")
        s = self.sizes
        tier = F.greatest(F.lit(0), F.ceil(F.log(F.col("file_size") / s.smallest) / F.log(F.lit(float(s.growth))))).cast("int")
        return files.groupBy("file_path", "file_size").agg(F.count("*").alias("rows")).select(F.col("file_path").alias("path"), F.col("file_size").alias("bytes"), "rows", F.when(F.col("file_size") >= s.target // 2, F.lit(None)).otherwise(tier).alias("tier"))

    def _commit(self, after: int, shards: DataFrame, schema: T.StructType | None = None) -> bool:
        """Publish ``shards``, with the newest schema unless another is given, as the version after ``after``; False if another writer has taken that number."""
        new = f"{self.root}/_versions/_new-{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(f"{new}/shards")
        self.spark.createDataFrame([((schema or self.schema()).json(),)], "value string").coalesce(1).write.text(f"{new}/schema")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(new), self._path(f"{self.root}/_versions/v{after + 1:010d}"), no_overwrite)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "exists" in str(e):
                self._fs.delete(self._path(new), True)
                return False
            raise
        return True

    def append(self, df: DataFrame) -> int:
        """Add the rows of ``df`` as small shards and return the new version. An empty ``df`` adds a version without shards of its own.

        New columns join the table's; those that ``df`` lacks are null in its rows; a type that does not fit is a ValueError, and nothing is written.
        """
        merged_schema(self.schema(), df.schema)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", self.sizes.arrival_rows).option("compression", "zstd").parquet(folder)
        own = self._shards(folder)
        while True:
            last = (self.versions() or [0])[-1]
            before, known = (self.manifest(last), self.schema(last)) if last else (self.manifest(), T.StructType())
            if self._commit(last, before.unionByName(own), merged_schema(known, df.schema)):
                return last + 1

    def full_tiers(self) -> list[int]:
        """Tiers with enough shards to merge; shards of at least half the target have none."""
        found = self.manifest().filter("tier is not null").groupBy("tier").count().filter(F.col("count") >= self.sizes.full)
        return sorted(r["tier"] for r in found.collect())  # as many rows as tiers

    def compact(self) -> int | None:
        """Merge the shards of every full tier, and commit; None if no tier is full. Other shards stay as they are.

        If another writer commits first, the merge is kept when its shards are all still there and undone otherwise.
        """
        tiers = self.full_tiers()
        if not tiers:
            return None
        old = self.manifest().filter(F.col("tier").isin(tiers))
        merged = [r["path"] for r in old.select("path").collect()]
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        packer = self.spark.newSession()  # its settings are its own: files are packed by size into partitions, each of which is written as one
        packer.conf.set("spark.sql.files.maxPartitionBytes", str(self.sizes.target))
        packer.conf.set("spark.sql.files.openCostInBytes", "0")
        packer.conf.set("spark.sql.files.minPartitionNum", "1")
        self._rows(packer, merged, self.schema()).write.option("compression", "zstd").parquet(folder)
        own = self._shards(folder)
        gone = self.spark.createDataFrame([(p,) for p in merged], "path string")
        while True:
            last = self.versions()[-1]
            now = self.manifest(last)
            if now.join(gone, "path", "left_semi").count() != len(merged):
                self._fs.delete(self._path(folder), True)
                return None
            if self._commit(last, now.join(gone, "path", "left_anti").unionByName(own), self.schema(last)):
                return last + 1

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the newest ``keep``, and the shards that only those name. Returns how many shards went."""
        known = self.versions()
        old, stay = known[:-keep], known[-keep:]
        if not old:
            return 0
        gone = [r["path"] for r in self._manifest(*old).select("path").distinct().join(self._manifest(*stay).select("path").distinct(), "path", "left_anti").collect()]
        for v in old:
            self._fs.delete(self._path(f"{self.root}/_versions/v{v:010d}"), True)
        for p in gone:
            self._fs.delete(self._path(p), False)
        return len(gone)


def shard(df: DataFrame, root: str, sizes: Sizes = Sizes()) -> ShardTable:  # noqa: B008
    """Append ``df`` to the shard table at ``root`` and merge until no tier is full.

    Rows are kept as they are, with their nulls, repetitions and very long texts; columns are those of all arrivals
    (see ``ShardTable.append``), two names of one arrival that differ in case alone are Spark's error. An empty table gives a
    version without rows of its own, whose columns are known. Older versions stay. Merging a tier makes fewer and
    larger shards, so it ends.
    """
    out = ShardTable(df.sparkSession, root, sizes)
    out.append(df)
    count = None
    while out.full_tiers():
        before, count = count, out.manifest().count()
        if before is not None and count >= before:
            break  # what is left cannot be packed any closer
        out.compact()
    return out


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents, arriving in three lots of different sizes, sharded, compacted and read back from the committed version."""
    from plazaflow.llm.common import scratch
    from plazaflow.session import table

    docs, root = table(spark, sf_dir, "documents"), scratch(spark, "shards")
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    arrivals = ShardTable(spark, root)
    for some in (lot < 1, (lot >= 1) & (lot < 5)):
        arrivals.append(docs.filter(some))
    back = shard(docs.filter(lot >= 5), root).read()
    return back.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


OP7_SQL = "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents"
