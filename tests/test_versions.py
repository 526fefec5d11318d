"""Partition-wise updates, pruning, deep pages and JDBC reads."""

import datetime as dt
import glob
import shutil

import pytest
from pyspark.sql import functions as F

from finsignal.operators import paging
from finsignal.operators.versions import PartitionedTable
from finsignal.sources import readers

SCHEMA = "period date, k string, a double, b double"


def month(m):
    return dt.date(2026, m, 1)


def table(spark, tmp_path):
    rows = [(month(m), f"k{i}", float(i) if i % 2 else None, 1.0) for m in range(1, 13) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    held = PartitionedTable(spark, str(tmp_path / "t"), df.schema, "period")
    held.replace(df)
    return held, rows


def test_an_update_writes_its_month_alone(spark, tmp_path):
    held, rows = table(spark, tmp_path)
    assert sorted(map(tuple, held.read().collect()), key=str) == sorted(rows, key=str)
    new = spark.createDataFrame([(month(3), "k0", 9.0, 9.0), (month(3), "k9", 5.0, None)], SCHEMA)
    assert held.upsert(new, ["period", "k"], ["a", "b"]) == 1
    assert {p.split("period=")[1][:10] for p in glob.glob(f"{tmp_path}/t/data/v=1/*/*.parquet")} == {"2026-03-01"}
    got = {(r["period"], r["k"]): (r["a"], r["b"]) for r in held.read().collect()}
    assert len(got) == len(rows) + 1 and got[month(3), "k0"] == (9.0, 1.0) and got[month(3), "k9"] == (5.0, None) and got[month(4), "k0"] == (None, 1.0)
    assert held.read(0).count() == len(rows)  # older versions stay readable
    again = sorted(map(str, held.read().collect()))
    held.upsert(new, ["period", "k"], ["a", "b"])
    assert sorted(map(str, held.read().collect())) == again
    with pytest.raises(ValueError):
        held.upsert(new, ["k"], ["a"])


def test_a_failed_update_changes_nothing(spark, tmp_path):
    held, rows = table(spark, tmp_path)
    bad = spark.createDataFrame([(month(5), "k0", 1.0, 1.0)], SCHEMA).withColumn("a", F.when(F.col("k") == "k0", F.raise_error(F.lit("broken"))).otherwise(F.col("a")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        held.replace(bad)
    assert held.read().count() == len(rows)
    spark.createDataFrame([("x", 1)], "partition string, version long").write.parquet(f"{tmp_path}/t/versions/n=1")
    shutil.os.remove(f"{tmp_path}/t/versions/n=1/_SUCCESS")  # a list that was not finished
    assert held.read().count() == len(rows)
    good = spark.createDataFrame([(month(5), "k7", 1.0, 1.0)], SCHEMA)
    assert held.upsert(good, ["period", "k"], ["a", "b"]) == 1 and held.read().count() == len(rows) + 1
    empty = PartitionedTable(spark, str(tmp_path / "none"), good.schema, "period")
    assert empty.read().count() == 0 and empty.replace(good.limit(0)) == 0 and empty.read().count() == 0


def test_ranges_and_joins_open_few_partitions(spark, tmp_path):
    held, _ = table(spark, tmp_path)
    few = held.read().where(paging.between(F.col("period"), month(4), month(5)))
    plan = few._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters:") : plan.index("PushedFilters")]
    assert "period" in filters and ">=" in filters and few.count() == 12
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    assert all("period=2026-04-01" in f or "period=2026-05-01" in f for f in files(few))
    reports = spark.createDataFrame([(month(7), "x"), (month(8), "y")], "period date, name string")
    joined = held.read().join(F.broadcast(reports.where("name = 'x'")), "period")
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString().lower() and joined.count() == 6


def test_deep_pages(spark):
    df = spark.range(1000).select(((F.col("id") * 7) % 13).alias("s"), F.col("id").alias("k"), F.lit("x").alias("t")).repartition(4)
    order = [F.desc("s"), F.asc("k")]
    pages = paging.ordered_pages(df, order, 8)
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    assert pages.total() == 1000 and len(pages.starts) > 4
    for offset in (0, 1, 119, 500, 873, 995, 1000, 5000):
        assert [tuple(r) for r in pages.window(30, offset).collect()] == want[offset : offset + 30]
    assert [tuple(r) for n in range(1, 12) for r in pages.page(n, 100).collect()] == want
    plan = pages.window(5, 900)._jdf.queryExecution().executedPlan().toString()
    assert "_fs_part" in plan[plan.index("PartitionFilters:") : plan.index("PushedFilters")]
    assert paging.ordered_pages(df.limit(0), order, 4).window(5, 0).count() == 0


def test_jdbc(spark, tmp_path):
    """Spark's own Derby: the whole table, in ranges, with a pushed filter."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(100).select(F.col("id").alias("ID"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("D"), (F.col("id") * 2).alias("V"))
    df.coalesce(1).write.format("jdbc").options(url=url, dbtable="ticks", **driver).save()
    want = sorted(map(tuple, df.collect()))
    for on, parts in ((None, 1), ("ID", 4), ("D", 3)):
        got = readers.read_jdbc(spark, url, "ticks", on, parts, **driver)
        assert got.rdd.getNumPartitions() == parts and sorted(map(tuple, got.collect())) == want
    few = readers.read_jdbc(spark, url, "ticks", "ID", 4, **driver).where("V >= 190").select("ID")
    assert "V" in few._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1] and few.count() == 5
    df.limit(1).write.format("jdbc").options(url=url, dbtable="one", **driver).save()
    assert readers.read_jdbc(spark, url, "one", "ID", 4, **driver).count() == 1
