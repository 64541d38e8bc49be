"""What several operators share: the shared scratch folder, row keys and ASCII-only lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.session import clean, scratch, shared_dir, written

__all__ = ["ascii_lower", "build_side", "clean", "cut", "scratch", "shared_dir", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from then on; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of keys that are broadcast at most.
MOST_KEYS = 500_000


def build_side(keys: DataFrame) -> DataFrame:
    """``keys``, written and a few numbers wide, as the side of a join that is built: broadcast up to ``MOST_KEYS`` rows, else
    hashed after a shuffle, so that the whole rows on the other side are never sorted."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys.hint("shuffle_hash")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and no other letter changed.

    ``lower`` knows all of Unicode, so it serves only where a string is pure ASCII.
    """
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))
