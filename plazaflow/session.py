"""Session helpers shared by every part of the library: tables, workers' imports, the shared folder."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Environment of Python workers, which live as long as their executor: arrays of 16 MB and more, and what is free beyond 32 MB, go back to the system.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "16777216", "MALLOC_TRIM_THRESHOLD_": "33554432", "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Bytes of the batches that go to Python workers: the setting, Spark's default, and what takes its place, since a batch is held on both sides.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed on their machines.

    Only the search path and the memory settings that workers start with are changed, and the size of batches where the session
    has Spark's default; a cluster without a shared
    code folder should ship the package with ``--py-files`` instead.
    """
    root = str(Path(__file__).resolve().parents[1])
    environment = getattr(spark.sparkContext, "environment", None)
    if environment is None:
        return
    if spark.conf.get(BATCH_BYTES[0], None) == BATCH_BYTES[1]:
        spark.conf.set(BATCH_BYTES[0], BATCH_BYTES[2])
    for name, value in WORKER_MEMORY.items():
        environment.setdefault(name, value)
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)
    if root not in sys.path:
        sys.path.append(root)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the session has one.

    A folder of our own is made only where none is set and everything runs on one machine, as in local tests; on
    a cluster that is an error, since executors do not see one another's folders.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="plazaflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder. Results read it lazily, so it stays until ``clean``."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How much ``scratch`` has made so far; what is made from then on is what ``clean`` may delete alone."""
    return len(_made)


def clean(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete what ``scratch`` has made, or what it has made ``since`` but for the paths to keep, once no result that reads it is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = [p for p in _made[since:] if p not in keep]
    _made[since:] = [p for p in _made[since:] if p in keep]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once and read from Parquet in the shared folder from then on: lineage is cut, lost executors do no
    harm, and Spark knows the size when it plans what reads it."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
