"""From raw documents to token ids, in stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plazaflow.llm import bpe, common, decontaminate, quality, simhash
from plazaflow.session import clean, made, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier keeps, in their own columns.

    Null, empty and blank texts stay, and all where no document is labelled good; rows that repeat are each judged, very long
    texts whole; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, null ids last.

    Null, empty and blank texts are copies of one another; rows that repeat are one group; very long texts are compared whole; an
    empty table stays empty.
    """
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark.

    Null, empty and blank texts share none; rows that repeat are each judged; very long texts are scanned whole; an empty table
    or benchmark takes nothing away.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and their text as the ids decode to.

    A null text becomes an empty one without ids; rows that repeat are each encoded, very long texts whole; a column of
    ``documents`` that bears a result's name gives way to it; an empty table stays empty.
    """
    import public_tokenizers as P

    return bpe.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, texts=True, remembered=150_000)  # workers still hold what the stages before left


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: No SQL has the rows of the first stage; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has written on its way is deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = common.scratch(spark, name)
            docs.write.option("compression", "zstd").parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            clean(spark, before, (path,))
    return docs
