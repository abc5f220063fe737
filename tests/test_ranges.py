"""Windows dealt by ranges against plain windows over the name."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranges import running_max, trailing

KIND = "g string, t int, v double"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    hot = [("a", t, draw.choice([None, draw.random()])) for t in draw.sample(range(5000), 300)]
    others = [("b", 3, 1.0), (None, 9, 2.0), (None, None, 4.0), (None, 2500, 0.5), ("c", 4999, None), ("c", 1, None)]
    return hot + others


@pytest.mark.parametrize("ranges", [1, 2, 40, 256])
@pytest.mark.parametrize("back", [0, 1, 13])
def test_trailing_frames(spark, rows, ranges, back):
    df = spark.createDataFrame(rows, KIND)

    def made(w):
        return {"n": F.count("*").over(w.rowsBetween(-back, 0)), "s": F.sum("v").over(w.rowsBetween(-back, 0)), "l": F.lag("v", back).over(w)}

    want = df.select("*", *[c.alias(k) for k, c in made(W.partitionBy("g").orderBy("t")).items()])
    got = trailing(df, "g", "t", back, made, ranges)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("ranges", [1, 2, 40, 256])
def test_running_max(spark, rows, ranges):
    df = spark.createDataFrame(rows, KIND)
    over = W.partitionBy("g").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("*", F.max("v").over(over).alias("m"))
    assert sorted(map(str, running_max(df, "g", "t", "v", "m", ranges).collect())) == sorted(map(str, want.collect()))


def test_empty_tables(spark):
    df = spark.createDataFrame([], KIND)
    assert trailing(df, "g", "t", 3, lambda w: {"l": F.lag("v").over(w)}).collect() == []
    assert running_max(df, "g", "t", "v", "m").collect() == []
