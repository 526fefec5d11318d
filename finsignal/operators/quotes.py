"""Quotes: parsing, derived figures, rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import quarantine, required
from ..functions.text import strip
from ..functions.values import parse_change_pct, parse_price, parse_timestamp_iso, parse_volume
from .pieces import over_pieces


def daily_change(price: Column, pct: Column) -> Column:
    """price * pct / 100 in decimals: half to even at 4 places, stored at 3."""
    return F.bround(F.bround(price.cast("decimal(18,6)") * pct.cast("decimal(12,6)") / F.lit(100), 4), 3).cast("decimal(10,3)")


def volatility_proxy(pct: Column) -> Column:
    """Size of the move, 4 places."""
    return F.bround(F.abs(pct.cast("decimal(18,6)")), 4).cast("double")


def ingest_quotes(raw: DataFrame) -> DataFrame:
    """Raw quote rows (strings) to market rows, with a reason where a row is unusable."""
    checked = quarantine(raw, required(["ticker", "name", "price", "volume", "change"], ["price", "volume", "change"]))
    pct, price = parse_change_pct(F.col("change")), parse_price(F.col("price"))
    return checked.select(
        F.upper(strip(F.col("ticker"))).alias("ticker"), strip(F.col("name")).alias("company"), price.alias("price"), parse_volume(F.col("volume")).alias("volume"), daily_change(price, pct).alias("daily_change"),
        pct.alias("daily_change_pct"), volatility_proxy(pct).alias("volatility"), parse_timestamp_iso(F.col("timestamp"), F.current_timestamp()).alias("timestamp"), "reason",
    )


def search_quotes(df: DataFrame, ticker: str, company: str, term: str | None) -> DataFrame:
    """Ticker or company fragment without case; blank: all."""
    term = (term or "").strip().lower()
    return df if not term else df.where(F.lower(F.col(ticker)).contains(term) | F.lower(F.col(company)).contains(term))


def top_quotes(df: DataFrame, by: str, tie: str, limit: int, descending: bool = True) -> DataFrame:
    order = F.desc(by) if descending else F.asc(by)
    return df.orderBy(order, tie).limit(limit)


def rolling(df: DataFrame, key: str, order: list[str], value: str, n: int, pieces: int | None = None) -> DataFrame:
    """rolling_mean and rolling_stddev over the last n rows of a key, this one included. With `pieces`, rows are cut into
    that many ranges of (key, order), and each gets the n - 1 rows before it, so a key may hold any share of the rows."""
    columns = {"rolling_mean": lambda w: F.avg(value).over(w.rowsBetween(-(n - 1), 0)), "rolling_stddev": lambda w: F.stddev_samp(value).over(w.rowsBetween(-(n - 1), 0))}
    if pieces:
        return over_pieces(df, [key], order, [value], columns, before=n - 1, pieces=pieces)
    return df.withColumns({name: make(Window.partitionBy(key).orderBy(*order)) for name, make in columns.items()})


def ohlc(df: DataFrame, ts: str, key: str, value: str, every: str) -> DataFrame:
    """Open, high, low, close and sum of tumbling windows by key."""
    first, last = F.min_by(value, F.struct(ts, value)), F.max_by(value, F.struct(ts, value))
    bars = df.groupBy(F.window(ts, every), key).agg(first.alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), last.alias("close"), F.count(F.lit(1)).alias("n"))
    return bars.select(F.col("window.start").alias("bar_start"), key, "open", "high", "low", "close", "n")
