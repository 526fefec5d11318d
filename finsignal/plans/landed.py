"""Queries that go through files: stand-ins of the given tables are written as the files that jobs land, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import grid as G
from ..operators import macro as M
from ..operators import quotes as Q
from ..operators import upsert as U
from ..session import table
from ..sources import readers as R
from ..storage import new_path
from .market import ORACLE as MARKET_SQL
from .market import quote_totals, raw_quotes
from .macro_queries import _M, months
from .reports import ORACLE as REPORT_SQL
from .reports import _grid


def feed_dates(spark, sf):
    """Publication times of feeds in several forms, and times of quotes with and without a zone, as seconds since 1970."""
    e = table(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    feed, iso = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 5
    published = F.when(kind == 0, feed).when(kind == 1, F.lit("soon")).when(kind == 3, F.concat(iso, F.lit("Z"))).when(kind == 4, F.date_format("ts", "d MMM yyyy HH:mm:ss '+0300'"))
    updated = F.when(kind == 1, feed).when(kind == 2, F.lit("n/a"))
    stamp = F.when(kind == 0, F.concat(iso, F.lit("Z"))).when(kind == 1, iso).when(kind == 2, F.lit("")).when(kind == 3, F.concat(iso, F.lit("-02:00"))).otherwise(F.lit("yesterday"))
    return e.select("event_id", F.unix_timestamp(V.parse_feed_date(published, updated)).alias("published"), F.unix_timestamp(V.parse_timestamp_iso(stamp)).alias("stamped"))


def landed_quotes(spark, sf):
    """Quotes in envelopes, one a user; every seventh user's envelope reports a failure and so gives none."""
    raw = raw_quotes(table(spark, sf, "events").where("user_id is not null")).withColumns({"lastUpdated": F.lit(None).cast("string")})
    data = F.collect_list(F.struct("ticker", "name", "volume", "price", "change", "lastUpdated", "timestamp")).alias("data")
    whole = raw.groupBy("ticker").agg(data).select((F.substring("ticker", 3, 20).cast("long") % 7 != 0).alias("success"), "data", F.lit("m").alias("meta"))
    folder = new_path(spark, "envelopes")
    whole.write.json(folder)
    return quote_totals(Q.ingest_quotes(R.read_quotes_json(spark, folder, lines=True)))


def landed_envelopes(spark, sf):
    """Extractor envelopes, one a year; every third year's failed, and one without a list of data."""
    m = months(spark, sf)
    data = F.collect_list(F.struct("month", "year", F.col("fuel_price").cast("string").alias("fuel")))
    year = F.col("year").cast("int")
    some = m.groupBy("year").agg(data.alias("data")).select(F.lit("fuel").alias("table_name"), F.concat("year", F.lit("-12-31")).alias("report_date"), F.when(year % 3 == 0, "failed").otherwise("success").alias("status"), F.concat(F.lit("u"), "year").alias("source_url"), F.when(year % 4 != 0, F.col("data")).alias("data"))
    folder = new_path(spark, "envelopes")
    some.write.json(folder)
    schema = "table_name string, report_date string, status string, source_url string, data array<struct<month string, year string, fuel string>>"
    return M.records_of(spark.read.schema(schema).json(folder)).select("report_date", "source_url", "month", "year", V.normalize_numeric(F.col("fuel")).alias("fuel"))


def landed_grids(spark, sf):
    """grid_parse over grids that were written as JSON lines."""
    folder = new_path(spark, "grids")
    _grid(spark, sf).write.json(folder)
    return G.parse_grid(R.read_table_grid(spark, folder), ["table_idx"], G.GRIDS["fuel"])


def landed_pages(spark, sf):
    folder = new_path(spark, "pages")
    table(spark, sf, "pages").write.parquet(folder)
    return R.read_pages(spark, folder).select("page_id", "url", F.char_length("html").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("digest"))


def landed_rows(spark, sf):
    """Rows appended in two goes, by partitions, and read as a stored table; then as the spare of an empty source."""
    folder, documents = new_path(spark, "rows"), table(spark, sf, "documents").select("doc_id", "source", "lang")
    for part in (F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1):
        U.append(documents.where(part), folder, ["lang"])
    stored = R.read_table(spark, folder)
    out = None
    for name, first in (("whole", stored), ("empty", stored.where("lang = 'no such'"))):
        part = R.fallback_source(first, documents.where("doc_id % 3 = 0")).groupBy(F.lit(name).alias("name"), "lang", "fallback_used").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (feed_dates, landed_quotes, landed_envelopes, landed_grids, landed_pages, landed_rows)}
_SECONDS = "epoch(date_trunc('second', ts))::BIGINT"
ORACLE = {
    "feed_dates": f"SELECT event_id, CASE event_id % 5 WHEN 2 THEN NULL WHEN 4 THEN {_SECONDS} - 10800 ELSE {_SECONDS} END AS published, CASE event_id % 5 WHEN 0 THEN {_SECONDS} WHEN 1 THEN {_SECONDS} - 10800 WHEN 3 THEN {_SECONDS} + 7200 END AS stamped FROM events",
    "landed_quotes": MARKET_SQL["quote_parse"].replace("AS change FROM events)", "AS change FROM events WHERE user_id % 7 <> 0)"),
    "landed_envelopes": f"WITH {_M} SELECT year || '-12-31' AS report_date, 'u' || year AS source_url, month, year, fuel_price AS fuel FROM m WHERE year::INTEGER % 3 <> 0 AND year::INTEGER % 4 <> 0",
    "landed_grids": REPORT_SQL["grid_parse"],
    "landed_pages": "SELECT page_id, url, length(html)::INTEGER AS n_chars, md5(html) AS digest FROM pages",
    "landed_rows": "SELECT 'whole' AS name, lang, false AS fallback_used, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'empty', lang, true, count(*) FROM documents WHERE doc_id % 3 = 0 GROUP BY lang",
}
