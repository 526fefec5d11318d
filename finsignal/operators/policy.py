"""Central-bank pages: links, articles, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip_html
from ..functions.values import parse_date_dayfirst, publication_date
from .paging import first_per_key, mentions_any, recent

# Terms that mark a release.
TERMS = ["mpc", "monetary policy", "committee", "cbr"]
# An anchor with its address in double quotes, single quotes or none, and its text.
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link_no, url, title) of a page's anchors, in order."""
    anchors = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(ANCHOR), F.lit(0))).alias("link_no", "_a"))
    part = [F.regexp_extract("_a", ANCHOR, i) for i in (1, 2, 3, 4)]  # groups that take no part are empty
    return anchors.select("page_id", "link_no", F.concat(*part[:3]).alias("url"), clean_text(strip_html(part[3])).alias("title"))


def release_links(links: DataFrame, as_of, newest: int, terms: list[str] = TERMS, days: int = 150) -> DataFrame:
    """Recent releases among links: terms in title or url, a date in the title, first of each url, newest first."""
    hits = links.where(mentions_any(F.concat_ws(" ", "title", "url"), terms)).withColumn("published", publication_date(F.col("title")))
    return first_per_key(hits, ["url"], [F.col("page_id"), F.col("link_no")]).where(recent(F.col("published"), as_of, days)).orderBy(F.desc("published"), "url").limit(newest)


def article_text(html: Column) -> Column:
    """Text of article, else main, else body, without scripts and styles."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ")
    parts = [F.nullif(F.regexp_extract(bare, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1), F.lit("")) for tag in ("article", "main", "body")]
    return clean_text(strip_html(F.coalesce(*parts, bare)))


def release_summary(text: Column) -> Column:
    """Struct: first 450 characters, first percentage, fixed stance and signal."""
    rate = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(?:percent|per cent|%)", 1), F.lit("")).try_cast("double")
    return F.struct(F.substring(text, 1, 450).alias("summary"), rate.alias("rate"), F.lit("neutral").alias("stance"), F.lit("unknown").alias("signal"))


def rate_history(pages: DataFrame, text: str) -> DataFrame:
    """(page_id, rate_no, rate, published) of all 'Central Bank Rate r% d/m/y' in page order."""
    # Fixed value: how a page states a rate and its date.
    pattern = r"(?i)Central Bank Rate\s+(\d+(?:\.\d+)?)\s*%\s+(\d{1,2}/\d{1,2}/\d{4})"
    rates, dates = (F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(i)) for i in (1, 2))
    each = pages.select("page_id", F.posexplode(F.arrays_zip(rates.alias("rate"), dates.alias("published"))).alias("rate_no", "_r"))
    return each.select("page_id", "rate_no", F.col("_r.rate").cast("double").alias("rate"), parse_date_dayfirst(F.col("_r.published")).alias("published"))


def rate_change(df: DataFrame, keys: list[str], order: list[Column], rate: str) -> DataFrame:
    """Each rate with the next one in the given order (newest first), the change and its direction."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.col(rate) - F.col("previous_rate")
    direction = F.when(change.isNull(), "unknown").when(change > 0, "increase").when(change < 0, "decrease").otherwise("unchanged")
    return df.withColumn("previous_rate", F.lead(rate).over(w)).withColumns({"rate_delta": change, "direction": direction})
