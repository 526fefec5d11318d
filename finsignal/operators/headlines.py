"""Headline ingestion: normalise, enrich, gate, map, dedupe, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import compute_once
from ..functions.text import bare, clean_or_null, combined_text, truncate
from ..functions.values import parse_feed_date
from ..sources.dims import Dictionary
from ..storage import write_table
from .keywords import enrich
from .upsert import new_row_counts, new_rows

MIN_IMPACT = 2


def normalize_entry(entries: DataFrame) -> DataFrame:
    """Feed entries to articles: title or summary, link or id, description unless it repeats the title, first content
    value, source and date. `malformed` marks rows without title or url. Every field is cleaned once."""
    raw = {c: F.col(c) for c in ("title", "summary", "description", "link", "id", "label", "feed_title", "feed_url")} | {"content": F.try_element_at("content", F.lit(1))["value"]}
    dates = {"published_at": parse_feed_date(F.col("published"), F.col("updated"))}
    held = compute_once(entries.select("feed_ord", "entry_ord", *raw.keys(), "published", "updated"), {n: bare(c) for n, c in raw.items()} | dates)
    some = {n: F.nullif(F.col(n), F.lit("")) for n in raw}
    title, url = F.coalesce(some["title"], some["summary"]), F.coalesce(some["link"], some["id"])
    description = F.coalesce(some["summary"], some["description"])
    source = F.coalesce(some["label"], some["feed_title"], some["feed_url"], F.lit("Unknown"))
    return held.select(
        "feed_ord", "entry_ord", source.alias("source"), title.alias("headline"), F.nullif(description, title).alias("description"), some["content"].alias("content"),
        url.alias("url"), "published_at", (title.isNull() | url.isNull()).alias("malformed"),
    )


def resolve_source(label: Column, title: Column, url: Column) -> Column:
    return F.coalesce(clean_or_null(label), clean_or_null(title), clean_or_null(url), F.lit("Unknown"))


def enrich_articles(articles: DataFrame, d: Dictionary = Dictionary()) -> DataFrame:
    return enrich(articles, combined_text(F.col("headline"), F.col("description"), F.col("content")), d)


def min_impact_gate(df: DataFrame, least: int = MIN_IMPACT) -> DataFrame:
    return df.where(F.col("impact_score") >= least)


def build_headline(df: DataFrame) -> DataFrame:
    """Stored form: widths cut, arrays as ', '-joined text, null when empty."""
    joined = {c: F.nullif(F.array_join(a, ", "), F.lit("")) for c, a in (("keywords_detected", "keywords"), ("categories", "categories"))}
    return df.select(
        "feed_ord", "entry_ord", truncate(F.col("source"), 255).alias("source"), truncate(F.col("headline"), 1000).alias("headline"), "description", "content",
        joined["keywords_detected"].alias("keywords_detected"), joined["categories"].alias("categories"), "matched_keywords_count", "impact_score",
        truncate(F.col("url"), 1000).alias("url"), "published_at",
    )


def fresh_headlines(entries: DataFrame, existing: DataFrame, d: Dictionary = Dictionary()) -> DataFrame:
    """Rows to append. Feed order, then entry order, decides which copy of a url wins."""
    articles = enrich_articles(normalize_entry(entries), d).where(~F.col("malformed"))
    return new_rows(build_headline(min_impact_gate(articles)), existing, ["url"], [F.col("feed_ord"), F.col("entry_ord")])


def headline_counters(entries: DataFrame, existing: DataFrame, d: Dictionary = Dictionary()) -> DataFrame:
    """Counters by feed of what fresh_headlines does. Texts are cleaned and matched once: what the counters need of each
    entry, without its texts, is written to the shared folder and read for each of them."""
    articles = enrich_articles(normalize_entry(entries), d)
    slim = write_table(articles.select("feed_ord", "entry_ord", "source", truncate(F.col("url"), 1000).alias("url"), "malformed", "impact_score"), "articles")
    rows = min_impact_gate(slim.where(~F.col("malformed"))).withColumn("source", truncate(F.col("source"), 255))
    seen = slim.groupBy("source").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("malformed") | (F.col("impact_score") < MIN_IMPACT)).alias("invalid"))
    kept = new_row_counts(rows, existing, ["url"], ["source"], [F.col("feed_ord"), F.col("entry_ord")]).select("source", "saved", "duplicates")
    return seen.join(kept, "source", "left").select("source", "fetched", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), "invalid")


def ingest_headlines(entries: DataFrame, existing: DataFrame, d: Dictionary = Dictionary()) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counters by feed)."""
    return fresh_headlines(entries, existing, d), headline_counters(entries, existing, d)


def ingest_rollup(counters: DataFrame, feeds: DataFrame) -> DataFrame:
    """Sums by (region, feed), by region and over all, from counters by source; unknown feeds are region 'other'."""
    regions = feeds.select(F.col("label").alias("source"), "region")
    named = counters.join(F.broadcast(regions), "source", "left").withColumn("region", F.coalesce("region", F.lit("other")))
    return named.rollup("region", "source").agg(*[F.sum(c).alias(c) for c in ("fetched", "saved", "duplicates", "invalid")], F.count_if(F.col("saved") > 0).alias("feeds_with_news"))
