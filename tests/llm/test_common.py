import os

import pytest
from pyspark.sql import functions as F

from plazaflow.llm import common


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_scratch_is_deleted_when_told(spark):
    df = common.written(spark.range(5), "x")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(path)
    common.clean(spark)
    assert not os.path.exists(path)


@pytest.mark.parametrize("text", ["ÀBC xYZ", "ABC", "", None, "İI", "[`{"])
def test_only_ascii_letters_change(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(common.ascii_lower(F.col("t"))).first()[0]
    assert got == (text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
