"""Indicator queries; orders by month stand in for monthly indicators, with values taken out by month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import macro as M
from ..operators import paging as P
from ..operators import upsert as U
from ..operators.versions import PartitionedTable
from ..session import table
from ..storage import new_path

COLUMNS = ["inflation", "fuel_price", "cbk_rate", "usd_rate", "euro_rate", "pound_rate"]
INDICATORS = {"inflation": ["inflation"], "fuel": ["fuel_price"], "cbr": ["cbk_rate"], "exchange": ["usd_rate", "euro_rate", "pound_rate"]}
ORDER = ["period"]


def months(spark, sf):
    """One row a month: counts of orders by priority as exact doubles; column k is null where month % 7 = k + 1."""
    o = table(spark, sf, "orders")
    period = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    pri = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    counts = [F.count_if(F.col("o_orderpriority") == p) for p in pri] + [F.count(F.lit(1))]
    grouped = o.groupBy(period.alias("period")).agg(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(counts)])
    m = F.month("period") % 7
    values = [F.when(m != i + 1, F.col(f"v{i}")).alias(c) for i, c in enumerate(COLUMNS)]
    return grouped.select("period", *values, F.date_format("period", "MMMM").alias("month"), F.year("period").cast("string").alias("year"))


def macro_stats(spark, sf):
    return M.statistics(months(spark, sf), COLUMNS, ORDER)


def macro_stats_long(spark, sf):
    return M.statistics_long(months(spark, sf), COLUMNS, ORDER)


def macro_stats_year(spark, sf):
    return M.statistics(P.complete_rows(months(spark, sf), ["inflation"]).where("year = '1997'"), ["inflation"], ORDER)


def macro_summary(spark, sf):
    return M.summary(months(spark, sf), ORDER, INDICATORS)


def macro_compare_months(spark, sf):
    return M.compare_months(months(spark, sf), "period", dt.date(1996, 3, 1), dt.date(1997, 3, 1), COLUMNS)


def macro_compare_years(spark, sf):
    return M.compare_periods(months(spark, sf), COLUMNS, F.col("year") == "1996", F.col("year") == "1997")


def macro_compare_periods(spark, sf):
    first, second = (F.col("period").between(F.lit(a), F.lit(b)) for a, b in ((dt.date(1995, 1, 1), dt.date(1996, 6, 1)), (dt.date(1998, 2, 1), dt.date(1999, 12, 1))))
    return M.compare_periods(months(spark, sf), COLUMNS, first, second)


def macro_search(spark, sf):
    found = M.search(months(spark, sf), {"month": "May", "year": None}, {"inflation": (10, None), "usd_rate": (None, 10**6), "period": (dt.date(1996, 1, 1), None)})
    return P.offset_limit(found.select("period", *COLUMNS), [F.col("period")], 4, 1)


def macro_last_n(spark, sf):
    return P.last_n(months(spark, sf).select("period", "inflation"), ["period"], 6)


def macro_history(spark, sf):
    full = P.complete_rows(months(spark, sf), INDICATORS["exchange"]).select("period", *INDICATORS["exchange"])
    return P.offset_limit(full, [F.col("period")], 10, 5)


def macro_latest_year(spark, sf):
    m = months(spark, sf)
    last = m.agg(F.max("year").alias("year"))
    return m.join(F.broadcast(last), "year").select("period", "year", "month", "inflation")  # one row


def macro_month(spark, sf):
    return months(spark, sf).where("month = 'June'").select("period", *COLUMNS)


def _gappy(spark, sf):
    return months(spark, sf).where(F.month("period") % 5 != 0)


def macro_trend_join(spark, sf):
    return M.previous_period(_gappy(spark, sf), "period", "inflation", "trend").select("period", "inflation", "trend")


def macro_trend_lag(spark, sf):
    return M.month_over_month(_gappy(spark, sf), "period", "inflation", "trend", ["year"]).select("period", "inflation", "trend")


def _stored(spark, sf):
    return months(spark, sf).where(F.month("period") % 2 == 0)


def _incoming(spark, sf):
    m = months(spark, sf)
    return m.select("month", "year", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in COLUMNS])


def upsert_state(spark, sf):
    return U.fill_null_upsert(_stored(spark, sf), _incoming(spark, sf), ["month", "year"], COLUMNS)


def upsert_partitions(spark, sf):
    """upsert_state into a table kept by year: each year's months arrive as an update that rewrites that year alone."""
    stored = _stored(spark, sf)
    held = PartitionedTable(spark, new_path(spark, "months"), stored.select("month", "year", *COLUMNS).schema, "year")
    held.replace(stored)
    incoming = _incoming(spark, sf)
    for year in ("1996", "1998"):
        held.upsert(incoming.where(F.col("year") == year), ["month", "year"], COLUMNS)
    return held.read()


def upsert_actions(spark, sf):
    return U.action_counts(upsert_state(spark, sf))


def _frames(spark, sf):
    every = _incoming(spark, sf)
    return {name: every.select("month", "year", *cs).where(F.length("month") % (i + 2) != 0) for i, (name, cs) in enumerate(INDICATORS.items())}


def refresh_pivot(spark, sf):
    return M.refresh_all(_stored(spark, sf), _frames(spark, sf), ["month", "year"], INDICATORS)


def refresh_indicator(spark, sf):
    """One indicator from raw strings: upper-case months, thousands commas, blanks; trends over the new state."""
    m = months(spark, sf)
    raw = F.when(F.col("fuel_price").isNull(), " ").otherwise(F.format_number("fuel_price", 1))
    records = m.select(F.upper(F.when(F.month("period") % 6 == 5, "Foo").otherwise(F.col("month"))).alias("month"), F.concat(F.lit(" "), "year").alias("year"), raw.alias("diesel_price"))
    stored = _stored(spark, sf).select("month", "year", F.when(F.month("period") % 4 == 0, F.col("fuel_price")).alias("fuel_price"))
    return M.refresh_indicator(stored, records, {"diesel_price": "fuel_price"}, {"fuel_price": "fuel_trend"})


def refresh_counts(spark, sf):
    return M.refresh_counts(_stored(spark, sf), _frames(spark, sf), ["month", "year"], INDICATORS)


def refresh_rollup(spark, sf):
    counts = refresh_counts(spark, sf).withColumns({"status": F.when(F.col("source") == "fuel", "failed").otherwise("success"), "report_date": F.when(F.col("source") != "cbr", F.concat(F.lit("d-"), "source"))})
    return M.refresh_rollup(counts)


def update_by_key(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("quality"), "lang")
    return U.update_by_key(d, table(spark, sf, "labels"), "doc_id", "quality")


def insert_strict(spark, sf):
    """Labels as a batch against documents of one language: inserted and conflicting rows with their kind."""
    fresh, conflicts = U.insert_strict(table(spark, sf, "labels"), table(spark, sf, "documents").where("lang = 'en'"), ["doc_id"])
    return fresh.withColumn("kind", F.lit("inserted")).unionByName(conflicts.withColumn("kind", F.lit("conflict"))).select("doc_id", "kind")


def semi_ids(spark, sf):
    return U.requested(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").where("toxic = 1"), "doc_id")


_PRI = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_V = ", ".join([f"count(*) FILTER (o_orderpriority = '{p}')::DOUBLE AS v{i}" for i, p in enumerate(_PRI)] + ["count(*)::DOUBLE AS v5"])
_M = f"""m AS (SELECT period, {", ".join(f"CASE WHEN month(period) % 7 <> {i + 1} THEN v{i} END AS {c}" for i, c in enumerate(COLUMNS))}, strftime(period, '%B') AS month, strftime(period, '%Y') AS year
  FROM (SELECT date_trunc('month', o_orderdate)::DATE AS period, {_V} FROM orders GROUP BY ALL))"""


def _stats(c: str) -> str:
    return f"min({c}) AS {c}_min, max({c}) AS {c}_max, sum({c}::DECIMAL(28,6))::DOUBLE / count({c}) AS {c}_avg, arg_max({c}, period) AS {c}_latest, arg_min({c}, period) AS {c}_earliest, count({c}) AS {c}_count"


def _sides(c: str, a: str, b: str) -> str:
    avg = [f"sum({c}::DECIMAL(28,6)) FILTER ({x})::DOUBLE / nullif(count({c}) FILTER ({x}), 0)" for x in (a, b)]
    avg = [f"CAST(sum({c}::DECIMAL(28,6)) FILTER ({x}) AS DOUBLE) / nullif(count({c}) FILTER ({x}), 0)" for x in (a, b)]
    return f"{avg[0]} AS {c}_avg_a, count({c}) FILTER ({a}) AS {c}_count_a, {avg[1]} AS {c}_avg_b, count({c}) FILTER ({b}) AS {c}_count_b, {avg[1]} - {avg[0]} AS {c}_delta"


_IN = f"i AS (SELECT month, year, {', '.join(f'coalesce({c}, -1.0) AS {c}' for c in COLUMNS)} FROM m), s AS (SELECT * FROM m WHERE month(period) % 2 = 0)"


def _upsert(source: str, columns: list[str]) -> str:
    filled = " OR ".join(f"(s.{c} IS NULL AND x.{c} IS NOT NULL)" for c in columns)
    return f"""SELECT coalesce(s.month, x.month) AS month, coalesce(s.year, x.year) AS year, {", ".join(f"coalesce(s.{c}, x.{c}) AS {c}" for c in columns)},
  CASE WHEN s.month IS NULL THEN 'inserted' WHEN x.month IS NULL THEN 'kept' WHEN {filled} THEN 'updated' ELSE 'unchanged' END AS action FROM s FULL JOIN {source} x ON s.month = x.month AND s.year = x.year"""


_ACTIONS = "count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action IN ('inserted', 'updated')) AS saved"
_KEEP = [f"length(month) % {i + 2} <> 0" for i in range(4)]
_PIVOT = "p AS (SELECT month, year, " + ", ".join(f"CASE WHEN {_KEEP[i]} THEN {c} END AS {c}" for i, cs in enumerate(INDICATORS.values()) for c in cs) + f" FROM i WHERE {' OR '.join(_KEEP)})"
_SRC = " UNION ALL ".join(f"SELECT '{n}' AS source, {_ACTIONS} FROM ({_upsert(f'(SELECT * FROM i WHERE {_KEEP[k]})', cs)})" for k, (n, cs) in enumerate(INDICATORS.items()))
_G = f"WITH {_M}, g AS (SELECT * FROM m WHERE month(period) % 5 <> 0)"

QUERIES = {f.__name__: f for f in (
    macro_stats, macro_stats_long, macro_stats_year, macro_summary, macro_compare_months, macro_compare_years, macro_compare_periods, macro_search, macro_last_n, macro_history, macro_latest_year, macro_month,
    macro_trend_join, macro_trend_lag, upsert_state, upsert_partitions, upsert_actions, refresh_pivot, refresh_indicator, refresh_counts, refresh_rollup, update_by_key, insert_strict, semi_ids,
)}
_P1, _P2 = "period BETWEEN DATE '1995-01-01' AND DATE '1996-06-01'", "period BETWEEN DATE '1998-02-01' AND DATE '1999-12-01'"
ORACLE = {
    "macro_stats": f"WITH {_M} SELECT {', '.join(map(_stats, COLUMNS))} FROM m",
    "macro_stats_long": f"WITH {_M} SELECT indicator, min(value) AS min, max(value) AS max, arg_max(value, period) AS latest, arg_min(value, period) AS earliest, count(value) AS count FROM (SELECT period, {', '.join(COLUMNS)} FROM m) UNPIVOT INCLUDE NULLS (value FOR indicator IN ({', '.join(COLUMNS)})) GROUP BY indicator",
    "macro_stats_year": f"WITH {_M} SELECT {_stats('inflation')} FROM m WHERE year = '1997' AND inflation IS NOT NULL",
    "macro_summary": f"WITH {_M} SELECT count(*) AS total, min(period) AS earliest, max(period) AS latest, " + ", ".join(f"count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in cs)}) AS {n}_complete" for n, cs in INDICATORS.items()) + " FROM m",
    "macro_compare_months": f"WITH {_M} SELECT a.period AS period_a, b.period AS period_b, " + ", ".join(f"a.{c} AS {c}_a, b.{c} AS {c}_b, b.{c} - a.{c} AS {c}_delta" for c in COLUMNS) + " FROM m a, m b WHERE a.period = DATE '1996-03-01' AND b.period = DATE '1997-03-01'",
    "macro_compare_years": f"WITH {_M} SELECT " + ", ".join(_sides(c, "year = '1996'", "year = '1997'") for c in COLUMNS) + " FROM m",
    "macro_compare_periods": f"WITH {_M} SELECT " + ", ".join(_sides(c, _P1, _P2) for c in COLUMNS) + " FROM m",
    "macro_search": f"WITH {_M} SELECT period, {', '.join(COLUMNS)} FROM m WHERE month = 'May' AND inflation >= 10 AND usd_rate <= 1000000 AND period >= DATE '1996-01-01' ORDER BY period LIMIT 4 OFFSET 1",
    "macro_last_n": f"WITH {_M} SELECT period, inflation FROM m ORDER BY period DESC LIMIT 6",
    "macro_history": f"WITH {_M} SELECT period, usd_rate, euro_rate, pound_rate FROM m WHERE usd_rate IS NOT NULL AND euro_rate IS NOT NULL AND pound_rate IS NOT NULL ORDER BY period LIMIT 10 OFFSET 5",
    "macro_latest_year": f"WITH {_M} SELECT period, year, month, inflation FROM m WHERE year = (SELECT max(year) FROM m)",
    "macro_month": f"WITH {_M} SELECT period, {', '.join(COLUMNS)} FROM m WHERE month = 'June'",
    "macro_trend_join": f"{_G} SELECT g.period, g.inflation, g.inflation - b.inflation AS trend FROM g LEFT JOIN g b ON b.period = g.period - INTERVAL 1 MONTH",
    "macro_trend_lag": f"{_G} SELECT period, inflation, CASE WHEN lag(period) OVER w = period - INTERVAL 1 MONTH THEN inflation - lag(inflation) OVER w END AS trend FROM g WINDOW w AS (PARTITION BY year ORDER BY period)",
    "upsert_partitions": f"""WITH {_M}, {_IN}, u AS ({_upsert('i', COLUMNS)}) SELECT month, year, {", ".join(COLUMNS)} FROM u WHERE year IN ('1996', '1998')
  UNION ALL SELECT month, year, {", ".join(COLUMNS)} FROM s WHERE year NOT IN ('1996', '1998')""",
    "upsert_state": f"WITH {_M}, {_IN} {_upsert('i', COLUMNS)}",
    "upsert_actions": f"WITH {_M}, {_IN} SELECT {_ACTIONS} FROM ({_upsert('i', COLUMNS)})",
    "refresh_pivot": f"WITH {_M}, {_IN}, {_PIVOT} {_upsert('p', COLUMNS)}",
    "refresh_indicator": f"""WITH {_M}, s AS (SELECT month, year, CASE WHEN month(period) % 4 = 0 THEN fuel_price END AS fuel_price FROM m WHERE month(period) % 2 = 0), x AS (SELECT month, year, fuel_price FROM m WHERE month(period) % 6 <> 5),
  u AS (SELECT *, strptime('1 ' || month || ' ' || year, '%d %B %Y')::DATE AS period FROM ({_upsert('x', ['fuel_price'])})) SELECT u.*, u.fuel_price - b.fuel_price AS fuel_trend FROM u LEFT JOIN u b ON b.period = u.period - INTERVAL 1 MONTH""",
    "refresh_counts": f"WITH {_M}, {_IN} {_SRC}",
    "refresh_rollup": f"WITH {_M}, {_IN}, c AS ({_SRC}) SELECT 4::BIGINT AS sources, 1::BIGINT AS failed, sum(saved)::BIGINT AS rows_saved, 'd-exchange' AS report_date, 'partial_success' AS status FROM c",
    "update_by_key": "SELECT d.doc_id, coalesce(l.quality, 0)::INTEGER AS quality, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)",
    "insert_strict": "SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'inserted' ELSE 'conflict' END AS kind FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') d USING (doc_id)",
    "semi_ids": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
}
