"""Report lines to fundamentals, and ratios with market prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_quotes
from ..functions.values import first_statement_value, last_long_date
from ..sources.dims import METRIC_LABELS
from .pieces import over_pieces

DIVIDENDS = ("interim dividend", "final dividend")


def label_values(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, field, value): the first line of each label that carries a value. labels(label, field): a short list."""
    known = labels.select(fold_quotes(F.col("label")).alias("_label"), "field")
    hits = lines.join(F.broadcast(known), fold_quotes(F.col("line")).startswith(F.col("_label")))
    valued = hits.withColumn("value", first_statement_value(F.col("line"))).where("value is not null")
    return valued.groupBy("doc_id", "field").agg(F.min_by("value", "line_no").alias("value"))


def next_line_value(lines: DataFrame, phrase: str, pieces: int | None = None) -> DataFrame:
    """(doc_id, value): the first non-zero value of a line with the phrase, or of the line after it. With `pieces`, lines
    are cut into that many ranges, each with the line that follows it, so one document may hold any share of the lines."""
    own = lines.select("doc_id", "line_no", "line", first_statement_value(F.col("line")).alias("_own"))
    following = {"_next": lambda w: F.lead("_own").over(w)}
    if pieces:
        both = over_pieces(own, ["doc_id"], ["line_no"], ["_own"], following, after=1, pieces=pieces)
    else:
        both = own.withColumns({n: make(Window.partitionBy("doc_id").orderBy("line_no")) for n, make in following.items()})
    value = F.coalesce("_own", "_next")
    return both.where(F.lower("line").contains(phrase.lower())).withColumn("value", value).where((F.col("value").isNotNull()) & (F.col("value") != 0)).groupBy("doc_id").agg(F.min_by("value", "line_no").alias("value"))


def extract_fundamentals(lines: DataFrame, labels: DataFrame, needed: list[str] | None = None) -> DataFrame:
    """One row a document: the labelled values, dividends added up, report date, and `missing` fields."""
    needed = needed or list(METRIC_LABELS.values())
    wide = label_values(lines, labels).groupBy("doc_id").pivot("field", needed).agg(F.first("value"))
    dates = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("_text")).select("doc_id", last_long_date(F.col("_text")).alias("report_date"))
    out = dates.join(wide, "doc_id", "left")
    for i, phrase in enumerate(DIVIDENDS):
        out = out.join(next_line_value(lines, phrase).withColumnRenamed("value", f"_d{i}"), "doc_id", "left")
    total = F.coalesce("_d0", F.lit(0.0)) + F.coalesce("_d1", F.lit(0.0))
    absent = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in [*needed, "report_date"]]), lambda x: x.isNotNull())
    return out.withColumns({"dividend_per_share": total, "missing": absent}).drop("_d0", "_d1")


def history(df: DataFrame, ticker: str, limit: int = 5) -> DataFrame:
    """A company's newest reports first, 1 to 20 of them."""
    if not 1 <= limit <= 20:
        raise ValueError("limit lies in 1..20")
    return df.where(F.col("ticker") == ticker).orderBy(F.desc("report_date"), F.desc("id")).limit(limit)


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def ratios(df: DataFrame, price: str = "price") -> DataFrame:
    """pe_ratio, dividend_yield, debt_ratio, net_profit_margin; a price must be positive."""
    p = F.when(F.col(price) > 0, F.col(price).cast("double"))
    debt = F.col("current_liabilities") + F.col("non_current_liabilities")
    return df.withColumns({
        "pe_ratio": F.when(p.isNotNull(), ratio(p, F.col("eps"))), "dividend_yield": F.when(p.isNotNull(), ratio(F.col("dividend_per_share"), p)),
        "debt_ratio": ratio(debt, F.col("shareholders_equity")), "net_profit_margin": ratio(F.col("profit_after_tax"), F.col("revenue")),
    })


def latest_price(ticks: DataFrame, key: str, ts: str, price: str) -> DataFrame:
    """Each key's latest price: a partial aggregate, ties to the higher price."""
    return ticks.groupBy(key).agg(F.max(F.struct(ts, price)).alias("_fs")).select(key, F.col(f"_fs.{price}").alias(price))


def live_pe(fundamentals: DataFrame, ticks: DataFrame, key: str, ts: str, price: str, eps: str) -> DataFrame:
    """Latest price over stored eps; null if eps is zero or null, or there is no price."""
    joined = fundamentals.join(latest_price(ticks, key, ts, price), key, "left")
    return joined.withColumn("live_pe", F.when(F.col(eps) != 0, F.try_divide(F.col(price), F.col(eps))))
