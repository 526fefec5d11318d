"""Readers for landed files, all with declared schemas."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .dims import SCHEMAS


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A stored table; with a known name its declared schema is used instead of the files'."""
    reader = spark.read.schema(SCHEMAS[name]) if name else spark.read
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, on: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A stored table over JDBC. With `on` (a number, date or timestamp column) it is read in `parts` ranges at once, whose
    bounds the database tells in one query; filters and columns are pushed into each range's query."""
    load = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more).load()
    bounds = load(query=f"SELECT MIN({on}) AS LOW, MAX({on}) AS HIGH FROM {name}").first() if on else (None, None)
    if bounds[0] is None or bounds[0] == bounds[1]:
        return load(dbtable=name)
    low, high = (str(int(x)) if isinstance(x, (int, float, Decimal)) else str(x) for x in bounds)
    return load(dbtable=name, partitionColumn=on, lowerBound=low, upperBound=high, numPartitions=str(parts))


def read_quotes_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Quote rows of successful envelopes; anything else gives no rows. An envelope a file, or with `lines` one a line."""
    raw = spark.read.schema(SCHEMAS["quotes_json"]).option("multiLine", str(not lines).lower()).json(path)
    return raw.where("success").selectExpr("inline(data)")


def read_feed_entries(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Feed entries from JSON lines, or from RSS files (fmt='xml'): one row an item, with the feed's own fields. Feeds are
    numbered by file name, as label and url name them; entries by their place in the feed."""
    if fmt == "xml":
        item = "struct<title: string, description: string, link: string, guid: string, pubDate: string, summary: string, updated: string, encoded: string>"
        feeds = spark.read.schema(f"title string, link string, item array<{item}>").format("xml").option("rowTag", "channel").option("ignoreNamespace", "true").load(path)
        named = feeds.select(F.input_file_name().alias("feed_url"), F.col("title").alias("feed_title"), F.posexplode("item").alias("entry_ord", "i"))
        order = dims_by_name(named)
        return named.join(F.broadcast(order), "feed_url").select(
            "feed_ord", F.col("entry_ord").cast("long").alias("entry_ord"), "feed_url", F.regexp_extract("feed_url", r"([^/]+?)(\.[A-Za-z]+)?$", 1).alias("label"), "feed_title", "i.title", "i.summary", "i.description", "i.link", F.col("i.guid").alias("id"),
            F.when(F.col("i.encoded").isNotNull(), F.array(F.struct(F.col("i.encoded").alias("value")))).alias("content"), F.col("i.pubDate").alias("published"), "i.updated",
        )
    return spark.read.schema(SCHEMAS["feed_entries"]).json(path)


def dims_by_name(named: DataFrame) -> DataFrame:
    """(feed_url, feed_ord): landed feed files, a short list, numbered by name."""
    return named.select("feed_url").distinct().select("feed_url", (F.row_number().over(Window.orderBy("feed_url")) - 1).alias("feed_ord"))


def read_table_grid(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(SCHEMAS["table_grid"]).format(fmt).load(path)


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, line): stripped non-empty lines of text files."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value")
    return report_lines(raw, "doc_id", "value")


def report_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """The same from a text column; line numbers count kept lines from 0."""
    kept = F.filter(F.transform(F.split(F.col(text), "\n"), strip), lambda x: x != "")
    return df.select(F.col(doc), F.posexplode(kept).alias("line_no", "line"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["pages"]).parquet(path)


def fallback_source(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """`primary`, or `fallback` when it has no rows; fallback_used tells which."""
    spare = fallback.join(primary.limit(1).select(F.lit(True).alias("_any")), F.lit(True), "left_anti")
    return primary.withColumn("fallback_used", F.lit(False)).unionByName(spare.withColumn("fallback_used", F.lit(True)))
