"""Windows over hot keys, cut into ranges: the same rows as plain windows, and no task that holds a key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from finsignal.operators import fundamentals, grid, paging, pieces, quotes


def hot(spark, n=3000):
    """Half of the rows under one key, some under a null key, values with gaps, times with ties."""
    draw = random.Random(5)
    rows = [(None if i % 50 == 1 else 0 if i % 2 else draw.randrange(40), i // 3, i, None if draw.random() < 0.3 else float(draw.randrange(100))) for i in range(n)]
    return spark.createDataFrame(rows, "k long, t long, id long, v double").repartition(5)


def rows(df, *columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("n_pieces", [1, 7, 40])
def test_same_as_plain_windows(spark, n_pieces):
    df = hot(spark)
    for n in (1, 2, 5, 60):
        plain = quotes.rolling(df.where("v is not null"), "k", ["t", "id"], "v", n)
        cut = quotes.rolling(df.where("v is not null"), "k", ["t", "id"], "v", n, n_pieces)
        columns = ["k", "id", "v", F.round("rolling_mean", 6).alias("m"), F.round("rolling_stddev", 6).alias("s")]
        assert rows(plain.select(*columns), "k", "id", "v", "m", "s") == rows(cut.select(*columns), "k", "id", "v", "m", "s")
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.withColumn("last", F.last("v", ignorenulls=True).over(w))
    assert rows(plain, "k", "id", "v", "last") == rows(pieces.carry_last(df, ["k"], ["t", "id"], "v", "last", n_pieces), "k", "id", "v", "last")


def test_as_of_and_lines(spark):
    df = hot(spark).where("k is not null")
    left, right = df.where("id % 3 = 0").select("k", "t", "id"), df.where("id % 3 <> 0 and v is not null").select("k", F.col("t").alias("rt"), "v")
    plain, cut = (paging.as_of(left, right, ["k"], "t", "rt", "v", n) for n in (None, 16))
    assert plain.columns == cut.columns and rows(plain, "k", "t", "id", "v") == rows(cut, "k", "t", "id", "v")
    lines = spark.createDataFrame([("d" if i % 3 else f"e{i % 7}", i, "Interim dividend" if i % 11 == 0 else "0" if i % 13 == 0 else f"{i}.5") for i in range(900)], "doc_id string, line_no int, line string")
    assert rows(fundamentals.next_line_value(lines, "interim"), "doc_id", "value") == rows(fundamentals.next_line_value(lines, "interim", 9), "doc_id", "value")
    cells = spark.createDataFrame([("t" if i % 2 else "u", i, f"20{i % 90 + 10}" if i % 17 == 0 else "x") for i in range(600)], "doc string, r int, c string")
    assert rows(grid.carry_year(cells, ["doc"], "r", F.col("c")), "doc", "r", "year") == rows(grid.carry_year(cells, ["doc"], "r", F.col("c"), 8), "doc", "r", "year")


def test_a_hot_key_is_spread(spark):
    """One key with half of the rows lies in about half of the ranges, each about as large as any other."""
    spread = pieces.cut(hot(spark, 20_000), ["k"], ["t", "id"], 20)
    sizes = [r["count"] for r in spread.groupBy(pieces.PART).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 20_000 / 20
    assert spread.where("k = 0").select(pieces.PART).distinct().count() >= 9
    halo = pieces.with_halo(hot(spark, 20_000), ["k"], ["t", "id"], ["v"], 4, 1, 20).where("_fs_halo")
    assert 0 < halo.count() <= 19 * 5
    with pytest.raises(ValueError):
        pieces.cut(spark.range(3), ["id"], ["id"], 0)


def test_no_rows(spark):
    none = hot(spark).limit(0)
    assert pieces.carry_last(none, ["k"], ["t", "id"], "v", "last", 4).count() == 0
    assert quotes.rolling(none, "k", ["t", "id"], "v", 3, 4).count() == 0
