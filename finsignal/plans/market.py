"""Quote queries; events stand in for ticks, lineitem for priced rows, part for tickers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import blank_counts
from ..operators import paging as P
from ..operators import quotes as Q
from ..operators import upsert as U
from ..session import table


def raw_quotes(e):
    """Events as raw quote strings; every eleventh price is N/A, every thirteenth has a thousands comma, every
    seventeenth volume is blank."""
    value = F.col("value").cast("decimal(12,2)")
    price = F.when(F.col("event_id") % 11 == 0, "N/A").when(F.col("event_id") % 13 == 0, F.concat(F.lit("1,"), F.lpad(value.cast("string"), 6, "0"))).otherwise(value.cast("string"))
    volume = F.when(F.col("event_id") % 17 == 0, "").otherwise((F.col("user_id") * 1000).cast("string"))
    change = F.concat(F.when(F.col("event_id") % 2 == 0, "+").otherwise("-"), ((F.col("event_id") % 700) / 100).cast("decimal(6,2)").cast("string"), F.lit("%"))
    return e.select("event_id", F.concat(F.lit(" t"), "user_id").alias("ticker"), F.col("event_type").alias("name"), volume.alias("volume"), price.alias("price"), change.alias("change"), F.lit("2026-03-02T10:00:00Z").alias("timestamp"))


def _raw(spark, sf):
    return raw_quotes(table(spark, sf, "events"))


def quote_totals(rows):
    return rows.groupBy("ticker", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price_sum"), F.sum("volume").alias("volume_sum"), F.sum("daily_change").alias("change_sum"), F.sum(F.col("daily_change_pct").cast("decimal(12,2)")).alias("pct_sum"))


def quote_parse(spark, sf):
    return quote_totals(Q.ingest_quotes(_raw(spark, sf).drop("event_id")))


def quote_quarantine(spark, sf):
    """Rows by the first rule they fail."""
    return Q.ingest_quotes(_raw(spark, sf)).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def quote_blanks(spark, sf):
    return blank_counts(_raw(spark, sf), ["price", "volume", "change"])


def quote_change(spark, sf):
    li = table(spark, sf, "lineitem")
    price, pct = F.col("l_extendedprice").cast("decimal(10,3)"), ((F.col("l_discount") - 0.05) * 100).cast("decimal(8,4)")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", Q.daily_change(price, pct).alias("daily_change"))


def quote_volatility(spark, sf):
    li = table(spark, sf, "lineitem")
    pct = ((F.col("l_discount") - 0.05) * 100).cast("decimal(8,4)")
    return li.groupBy("l_returnflag").agg(F.sum(Q.volatility_proxy(pct).cast("decimal(18,4)")).alias("volatility_sum"), F.count(F.lit(1)).alias("n"))


def quote_latest(spark, sf):
    return P.latest_per_key(table(spark, sf, "events"), ["user_id"], "ts", ["event_id", "value"])


def quote_top(spark, sf):
    last = P.latest_per_key(table(spark, sf, "events"), ["user_id"], "ts", ["event_id", "value"])
    return Q.top_quotes(last, "value", "user_id", 10)


def quote_search(spark, sf):
    return Q.search_quotes(table(spark, sf, "part"), "p_brand", "p_name", " RED ").select("p_partkey", "p_name", "p_brand")


def quote_exact(spark, sf):
    """First row of an exact ticker."""
    return P.first_per_key(table(spark, sf, "part").where(F.upper("p_brand") == "BRAND#7"), ["p_brand"], [F.col("p_partkey")]).select("p_partkey", "p_name", "p_brand")


def quote_rolling(spark, sf):
    """Rolling mean over 5 ticks of a user, in cents so that sums are exact; variances times 60 are whole."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("double").alias("cents"))
    r = Q.rolling(e, "user_id", ["ts", "event_id"], "cents", 5)
    return r.select("event_id", "user_id", (F.round(F.col("rolling_mean") * 5 * 4 * 3).cast("long")).alias("mean_x60"), F.round(F.col("rolling_stddev") * F.col("rolling_stddev") * 60).cast("long").alias("variance_x60"))


def _hot(e):
    """Events with half of all users made one user, whose rows no one task should hold."""
    return e.withColumn("user_id", F.when(F.col("user_id") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id")))


def hot_rolling(spark, sf):
    """quote_rolling where one user has half of all ticks: ranges of ticks with the four ticks before them."""
    e = _hot(table(spark, sf, "events")).select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("double").alias("cents"))
    r = Q.rolling(e, "user_id", ["ts", "event_id"], "cents", 5, pieces=64)
    return r.select("event_id", "user_id", (F.round(F.col("rolling_mean") * 5 * 4 * 3).cast("long")).alias("mean_x60"), F.round(F.col("rolling_stddev") * F.col("rolling_stddev") * 60).cast("long").alias("variance_x60"))


def hot_asof(spark, sf):
    """asof_price where one user has half of all events: last views are handed on between ranges of events."""
    e = _hot(table(spark, sf, "events"))
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("last_view"))
    return P.as_of(buys, views, ["user_id"], "ts", "view_ts", "last_view", pieces=64).select("event_id", "user_id", "last_view")


def deep_page(spark, sf):
    """Rows 5,000 to 5,020 of all order lines by price: a page deep in the order, out of one range of 64."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return P.ordered_pages(lines, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]).window(20, 5000)


def quote_bars(spark, sf):
    return Q.ohlc(table(spark, sf, "events").where("value is not null"), "ts", "event_type", "value", "1 day")


def quote_ids(spark, sf):
    """Ids for appended ticks and what they carry, after 1000 stored ones, in time order."""
    return U.assign_ids(table(spark, sf, "events"), [F.col("ts"), F.col("event_id")], 1000, 16).select("event_id", "id", "event_type", "props")


def asof_price(spark, sf):
    """Each purchase with the user's last view value at or before it."""
    e = table(spark, sf, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("last_view"))
    return P.as_of(buys, views, ["user_id"], "ts", "view_ts", "last_view").select("event_id", "user_id", "last_view")


_DISC = "((l_discount - 0.05) * 100)::DECIMAL(8,4)"


def _half_even(x: str, places: int, wide: int) -> str:
    """DuckDB: round a decimal half to even through whole numbers."""
    scaled = f"(({x}) * {10**places}::HUGEINT)::DECIMAL(38,{wide})"
    return f"(CASE WHEN abs({scaled} - trunc({scaled})) = 0.5 THEN 2 * round({scaled} / 2) ELSE round({scaled}) END)::DECIMAL(38,0)"


_RAW = """raw AS (SELECT event_id, 't' || user_id AS ticker, event_type AS name, CASE WHEN event_id % 17 = 0 THEN '' ELSE (user_id * 1000)::VARCHAR END AS volume,
  CASE WHEN event_id % 11 = 0 THEN 'N/A' WHEN event_id % 13 = 0 THEN '1,' || lpad(value::DECIMAL(12,2)::VARCHAR, 6, '0') ELSE value::DECIMAL(12,2)::VARCHAR END AS price,
  (CASE WHEN event_id % 2 = 0 THEN '' ELSE '-' END || ((event_id % 700) / 100)::DECIMAL(6,2)::VARCHAR) AS change FROM events)"""
_PARSED = f"""{_RAW}, q AS (SELECT upper(ticker) AS ticker, CASE WHEN price = 'N/A' THEN 'missing_price' WHEN volume = '' THEN 'missing_volume' END AS reason,
  try_cast(replace(price, ',', '') AS DECIMAL(10,3)) AS p, try_cast(volume AS BIGINT) AS v, change::DECIMAL(12,2) AS c FROM raw)"""

QUERIES = {f.__name__: f for f in (quote_parse, quote_quarantine, quote_blanks, quote_change, quote_volatility, quote_latest, quote_top, quote_search, quote_exact, quote_rolling, quote_bars, quote_ids, asof_price, hot_rolling, hot_asof, deep_page)}
_HOT = "hot AS (SELECT * REPLACE (CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END AS user_id) FROM events)"
_LATEST = "SELECT user_id, max(ts) AS ts, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY user_id"
ORACLE = {
    "quote_quarantine": f"WITH {_PARSED} SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM q GROUP BY ALL",
    "quote_blanks": f"WITH {_RAW} SELECT count(*) AS n_rows, count(*) FILTER (price = 'N/A') AS blank_price, count(*) FILTER (volume = '') AS blank_volume, 0::BIGINT AS blank_change FROM raw",
    "quote_latest": _LATEST,
    "quote_top": f"SELECT * FROM ({_LATEST}) ORDER BY value DESC, user_id LIMIT 10",
    "quote_search": "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%red%' OR p_brand ILIKE '%red%'",
    "quote_exact": "SELECT p_partkey, p_name, p_brand FROM part WHERE upper(p_brand) = 'BRAND#7' ORDER BY p_partkey LIMIT 1",
    "quote_rolling": "SELECT event_id, user_id, round(avg(c) OVER w * 60)::BIGINT AS mean_x60, round(stddev_samp(c) OVER w * stddev_samp(c) OVER w * 60)::BIGINT AS variance_x60 FROM (SELECT *, round(value * 100)::DOUBLE AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "deep_page": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20 OFFSET 5000",
    "hot_rolling": f"WITH {_HOT} SELECT event_id, user_id, round(avg(c) OVER w * 60)::BIGINT AS mean_x60, round(stddev_samp(c) OVER w * stddev_samp(c) OVER w * 60)::BIGINT AS variance_x60 FROM (SELECT *, round(value * 100)::DOUBLE AS c FROM hot) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "hot_asof": f"WITH {_HOT}, v AS (SELECT user_id, ts, max(value) AS value FROM hot WHERE event_type = 'view' GROUP BY ALL) SELECT p.event_id, p.user_id, v.value AS last_view FROM (SELECT * FROM hot WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "quote_bars": "SELECT date_trunc('day', ts)::TIMESTAMP AS bar_start, event_type, arg_min(value, struct_pack(a := ts, b := value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, struct_pack(a := ts, b := value)) AS close, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "quote_ids": "SELECT event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS id, event_type, props FROM events",
    "asof_price": "SELECT p.event_id, p.user_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "quote_parse": f"WITH {_PARSED} SELECT ticker, reason, count(*) AS n, sum(p) AS price_sum, sum(v)::BIGINT AS volume_sum, sum(({_half_even(_half_even('p::DECIMAL(18,6) * c / 100', 4, 6) + ' / 10000::DECIMAL(38,4)', 3, 6)} / 1000)::DECIMAL(10,3)) AS change_sum, sum(c) AS pct_sum FROM q GROUP BY ALL",
    "quote_change": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ({_half_even(_half_even(f'l_extendedprice::DECIMAL(10,3) * {_DISC} / 100', 4, 9) + ' / 10000::DECIMAL(38,4)', 3, 6)} / 1000)::DECIMAL(10,3) AS daily_change FROM lineitem",
    "quote_volatility": f"SELECT l_returnflag, sum(abs({_DISC})::DECIMAL(18,4)) AS volatility_sum, count(*) AS n FROM lineitem GROUP BY ALL",
}
