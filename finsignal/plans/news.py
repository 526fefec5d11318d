"""Headline queries; `documents` stands in for headlines, with a dictionary of its own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import quarantine_counts
from ..operators import headlines as H
from ..operators import keywords as K
from ..operators import paging as P
from ..operators import upsert as U
from ..session import table
from ..sources.dims import FEEDS, REGIONAL_FEEDS, Dictionary, dim_feeds, dim_keywords

#: Documents whose keys count as stored already.
STORED = "lang = 'de'"
WORDS = Dictionary(
    {"articles": ["the", "of the", "que"], "endings": ["tion", "thon", "ing"], "stems": ["ther", "que", "and"]},
    {"the": 1, "of the": 5, "tion": 4, "thon": 3, "que": 2, "ther": 3},
)


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return K.enrich(table(spark, sf, "documents"), F.col("text"), WORDS)


def kw_extract(spark, sf):
    return _enriched(spark, sf).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


def kw_categories(spark, sf):
    return _enriched(spark, sf).select("doc_id", F.array_join("categories", ",").alias("categories"))


def kw_impact(spark, sf):
    return _enriched(spark, sf).select("doc_id", "impact_score")


def kw_enrich(spark, sf):
    return _enriched(spark, sf).select("doc_id", F.array_join("keywords", ", ").alias("keywords_detected"), F.array_join("categories", ", ").alias("categories"), "matched_keywords_count", "impact_score")


def kw_gate_topk(spark, sf):
    """Flagship: enrich, gate, best 50 by impact."""
    return H.min_impact_gate(_enriched(spark, sf)).select("doc_id", "source", "impact_score", "matched_keywords_count").orderBy(F.desc("impact_score"), "doc_id").limit(50)


def kw_frequency(spark, sf):
    return K.token_frequency(_enriched(spark, sf), "keywords")


def kw_distinct_tokens(spark, sf):
    return K.distinct_tokens(_enriched(spark, sf), "categories")


def sources(spark, sf):
    return K.distinct_values(table(spark, sf, "documents"), "source")


def kw_batch_totals(spark, sf):
    return K.batch_totals(_enriched(spark, sf))


def kw_dict_join(spark, sf):
    words = dim_keywords(spark, WORDS).where(~F.col("keyword").contains(" "))
    return K.match_large_dictionary(table(spark, sf, "documents"), "doc_id", "text", words)


def benchmark_terms(spark, sf):
    """(category, keyword): the words of all benchmark passages, and the phrases of two and three words next to one another."""
    low = F.lower("text")
    runs = lambda n: F.regexp_extract_all(low, F.lit(rf"(?U)(?<!\w)(?=(\w+(?: \w+){{{n - 1}}})(?!\w))"), F.lit(1))
    each = table(spark, sf, "benchmark").select(F.explode(F.concat(runs(1), runs(2), runs(3))).alias("keyword")).distinct()
    return each.select(F.concat(F.lit("c"), F.char_length("keyword") % 5).alias("category"), "keyword")


def kw_terms(spark, sf):
    """Thousands of words and phrases against all documents: how many terms of each category a document holds, and their digest."""
    found = K.match_terms(table(spark, sf, "documents"), "doc_id", "text", benchmark_terms(spark, sf))
    digest = F.md5(F.array_join(F.array_sort(F.collect_list("keyword")), ",").cast("binary"))
    return found.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"), digest.alias("digest"))


def news_search(spark, sf):
    """Two containment filters and a least score."""
    d = _enriched(spark, sf)
    wanted = T.all_of([P.contains_ci(F.col("text"), " Of The "), P.contains_ci(F.col("source"), "SRC1"), P.contains_ci(F.col("lang"), "  "), P.at_least(F.col("impact_score"), 5)])
    return d.where(wanted).select("doc_id", "source", "impact_score")


def news_relevant(spark, sf):
    d = _enriched(spark, sf)
    return d.where(P.any_relevant(F.col("impact_score"), F.col("categories"), ["stems"], 8)).select("doc_id", "impact_score")


def news_page(spark, sf):
    d = _enriched(spark, sf).select("doc_id", "source", "impact_score")
    return P.page(d, [F.desc("impact_score"), F.asc("doc_id")], 3, 20)


def news_page_info(spark, sf):
    return P.page_info(H.min_impact_gate(_enriched(spark, sf)), 20, 40)


def keyset_scan(spark, sf):
    return P.keyset_scan(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id", 17, 25)


def _keyed(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.md5(F.lower("text").cast("binary")).alias("url"), "doc_id", "source", "lang")


def dedupe_first(spark, sf):
    """New keys only, first document of each; the German documents are stored already."""
    d = _keyed(spark, sf)
    return U.new_rows(d, d.where(STORED), ["url"], [F.col("doc_id")]).select("url", "doc_id", "source")


def ingest_counters(spark, sf):
    d = _keyed(spark, sf)
    return U.new_row_counts(d, d.where(STORED), ["url"], ["source"], [F.col("doc_id")])


def ingest_rollup(spark, sf):
    d = _keyed(spark, sf)
    counts = U.new_row_counts(d, d.where(STORED), ["url"], ["source"], [F.col("doc_id")]).withColumn("invalid", F.lit(0).cast("long"))
    return H.ingest_rollup(counts, dim_feeds(spark).select(F.concat(F.lit("src"), "ord").alias("label"), "region"))


def feed_regions(spark, sf):
    """Documents by feed and region: sources src0..src8 take the nine feeds in order, others are 'other'."""
    feeds = dim_feeds(spark).select(F.concat(F.lit("src"), "ord").alias("source"), "region", "label")
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return d.join(F.broadcast(feeds), "source", "left").select("source", F.coalesce("region", F.lit("other")).alias("region"), F.coalesce("label", F.lit("Unknown")).alias("label"), "n")


def entries_of(d):
    """Documents as feed entries: the source as title, the text as summary, a digest of it as link."""
    return d.select(
        F.lit(0).alias("feed_ord"), F.col("doc_id").alias("entry_ord"), F.lit("u").alias("feed_url"), F.col("source").alias("label"), F.lit(None).cast("string").alias("feed_title"), F.col("source").alias("title"),
        F.col("text").alias("summary"), F.lit(None).cast("string").alias("description"), F.md5(F.lower("text").cast("binary")).alias("link"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("array<struct<value:string>>").alias("content"),
        F.lit("Mon, 02 Mar 2026 10:00:00 GMT").alias("published"), F.lit(None).cast("string").alias("updated"),
    )


def _ingested(spark, sf):
    """Entries, stored keys and dictionary of an ingestion."""
    d = table(spark, sf, "documents")
    return entries_of(d), d.where(STORED).select(F.md5(F.lower("text").cast("binary")).alias("url")), WORDS


def ingest_headlines(spark, sf):
    """The whole ingestion, stored keys as existing; counters by source."""
    return H.headline_counters(*_ingested(spark, sf))


def ingest_rows(spark, sf):
    """The rows that the ingestion appends."""
    rows = H.fresh_headlines(*_ingested(spark, sf))
    return rows.select("url", "entry_ord", "source", "headline", F.md5(F.col("description").cast("binary")).alias("description_digest"), "keywords_detected", "categories", "matched_keywords_count", "impact_score")


def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean_text(F.col("text")).cast("binary")).alias("digest"), F.char_length(T.truncate(T.clean_text(F.col("text")), 255)).alias("cut_chars"))


def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.clean_text(T.strip_html(F.col("html"))).cast("binary")).alias("digest"))


def meaningful(spark, sf):
    """Usability of fields: texts, urls and placeholders by id; and of every whole text."""
    d = table(spark, sf, "documents")
    field = F.when(F.col("doc_id") % 7 == 0, "Read more...").when(F.col("doc_id") % 7 == 1, F.lit("https://www.google.com/url?q=x")).when(F.col("doc_id") % 7 == 2, "n/a").when(F.col("doc_id") % 7 == 3, " 42 ").otherwise(F.col("text"))
    return d.select("doc_id", T.is_meaningful(field).alias("meaningful"), T.is_meaningful(F.col("text")).alias("text_meaningful"))


def assemble(spark, sf):
    d = table(spark, sf, "documents")
    described = F.when(F.col("doc_id") % 3 == 0, "[Removed]").otherwise(F.col("source"))
    return d.select("doc_id", T.assemble_text(F.col("text"), described, F.col("lang")).alias("assembled"))


def entities(spark, sf):
    """Pages with entities decoded and normalised for scoring (Arrow)."""
    return table(spark, sf, "pages").select("page_id", F.char_length(T.clean_for_scoring(F.col("html"))).alias("n_chars"))


def quarantine_documents(spark, sf):
    from ..functions.rules import quarantine

    d = table(spark, sf, "documents")
    rules = {"short": F.char_length("text") < 100, "long": F.char_length("text") > 10000, "hot_source": F.col("source") == "src0"}
    return quarantine_counts(quarantine(d, rules))


_B = r"[^\p{L}\p{N}_]"


def _sql_has(word: str) -> str:
    return f"contains(t, '{word}')" if " " in word else f"regexp_matches(t, '(^|{_B}){word}($|{_B})')"


_KW = "[" + ", ".join(f"CASE WHEN {_sql_has(w)} THEN '{w}' END" for w in WORDS.distinct()) + "]"
_CAT = "[" + ", ".join(f"CASE WHEN list_has_any(kw, {words}) THEN '{c}' END" for c, words in sorted(WORDS.keywords.items())) + "]"
_W = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WORDS.weights.items())
ENRICHED = f"""e AS (SELECT *, list_filter({_CAT}, lambda x: x IS NOT NULL) AS cats, len(kw)::INTEGER AS n_kw,
  coalesce(list_sum(list_transform(kw, lambda k: CASE k {_W} ELSE 1 END)), 0)::INTEGER AS impact
  FROM (SELECT *, list_filter({_KW}, lambda x: x IS NOT NULL) AS kw FROM (SELECT *, lower(coalesce(text, '')) AS t FROM documents)))"""
_KEYED = f"k AS (SELECT md5(lower(text)) AS url, doc_id, source, lang FROM documents), old AS (SELECT DISTINCT url FROM k WHERE {STORED})"
_COUNTED = f"{_KEYED}, r AS (SELECT k.*, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS rn, old.url IS NULL AS fresh FROM k LEFT JOIN old USING (url))"
_COUNTS = "count(*) AS fetched, count(*) FILTER (rn = 1 AND fresh) AS saved, count(*) - count(*) FILTER (rn = 1 AND fresh) AS duplicates"
_SPACE = "regexp_replace({}, '\\s+', ' ', 'g')"
_CLEAN = "trim(" + _SPACE.format("text") + ")"
_MEANINGFUL = """(f <> '' AND NOT (regexp_matches(f, '(?i)https?://(?:www\\.)?google\\.[a-z.]+/url\\?') AND length(trim(regexp_replace(f, 'https?://\\S+', '', 'g'))) < 3)
  AND NOT regexp_full_match(lower(f), '\\[removed\\]|\\[no description\\]|no description available|read more\\.*|click here\\.*|n/?a|untitled|continue reading\\.*')
  AND length(trim(f)) >= 3 AND regexp_matches(f, '[A-Za-z]'))"""
_STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"

_INGEST = f"""WITH {ENRICHED.replace("lower(coalesce(text, ''))", "lower(concat_ws(' ', nullif(" + _STRIP.format("source") + ", ''), CASE WHEN " + _STRIP.format("text") + " IS DISTINCT FROM " + _STRIP.format("source") + " THEN nullif(" + _STRIP.format("text") + ", '') END))")},
  k AS (SELECT *, md5(lower(text)) AS url FROM e), old AS (SELECT DISTINCT url FROM k WHERE {STORED})"""

QUERIES = {f.__name__: f for f in (
    kw_extract, kw_categories, kw_impact, kw_enrich, kw_gate_topk, kw_frequency, kw_distinct_tokens, sources, kw_batch_totals, kw_dict_join, kw_terms, news_search, news_relevant, news_page, news_page_info,
    keyset_scan, dedupe_first, ingest_counters, ingest_rollup, feed_regions, ingest_headlines, ingest_rows, clean_text, strip_html, meaningful, assemble, entities, quarantine_documents,
)}
ORACLE = {
    "ingest_rows": f"""{_INGEST}, r AS (SELECT k.*, row_number() OVER (PARTITION BY k.url ORDER BY doc_id) AS rn FROM k LEFT JOIN old USING (url) WHERE impact >= 2 AND old.url IS NULL AND k.url IS NOT NULL)
  SELECT url, doc_id AS entry_ord, {_STRIP.format("source")} AS source, {_STRIP.format("source")} AS headline, md5({_STRIP.format("text")}) AS description_digest, nullif(array_to_string(kw, ', '), '') AS keywords_detected,
    nullif(array_to_string(cats, ', '), '') AS categories, n_kw AS matched_keywords_count, impact AS impact_score FROM r WHERE rn = 1""",
    "kw_extract": f"WITH {ENRICHED} SELECT doc_id, array_to_string(kw, ',') AS keywords FROM e",
    "kw_categories": f"WITH {ENRICHED} SELECT doc_id, array_to_string(cats, ',') AS categories FROM e",
    "kw_impact": f"WITH {ENRICHED} SELECT doc_id, impact AS impact_score FROM e",
    "kw_enrich": f"WITH {ENRICHED} SELECT doc_id, array_to_string(kw, ', ') AS keywords_detected, array_to_string(cats, ', ') AS categories, n_kw AS matched_keywords_count, impact AS impact_score FROM e",
    "kw_gate_topk": f"WITH {ENRICHED} SELECT doc_id, source, impact AS impact_score, n_kw AS matched_keywords_count FROM e WHERE impact >= 2 ORDER BY impact DESC, doc_id LIMIT 50",
    "kw_frequency": f"WITH {ENRICHED} SELECT token, count(*) AS n FROM (SELECT unnest(kw) AS token FROM e) GROUP BY token",
    "kw_distinct_tokens": f"WITH {ENRICHED} SELECT DISTINCT unnest(cats) AS token FROM e",
    "sources": "SELECT DISTINCT trim(source) AS source FROM documents WHERE trim(source) <> ''",
    "kw_batch_totals": f"WITH {ENRICHED} SELECT sum(n_kw)::BIGINT AS keyword_total, sum(impact)::BIGINT AS impact_total FROM e",
    "kw_dict_join": "SELECT doc_id, category, keyword FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS keyword FROM documents) JOIN (VALUES "
    + ", ".join(f"('{c}', '{w}')" for c, words in WORDS.keywords.items() for w in words if " " not in w) + ") d(category, keyword) USING (keyword)",
    "kw_terms": r"""WITH b AS (SELECT string_split(unnest(string_split_regex(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc} ]')), ' ') AS p FROM benchmark), i AS (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM b),
  raw AS (SELECT DISTINCT p[k] AS keyword FROM i WHERE p[k] <> ''),
  s AS (SELECT DISTINCT p[k] || ' ' || p[k + 1] AS keyword FROM i WHERE p[k] <> '' AND p[k + 1] <> '' UNION SELECT DISTINCT p[k] || ' ' || p[k + 1] || ' ' || p[k + 2] FROM i WHERE p[k] <> '' AND p[k + 1] <> '' AND p[k + 2] <> ''),
  d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS words FROM documents),
  m AS (SELECT doc_id, keyword FROM (SELECT doc_id, unnest(words) AS keyword FROM d) SEMI JOIN raw USING (keyword) UNION ALL SELECT doc_id, keyword FROM d, s WHERE contains(low, keyword))
  SELECT doc_id, 'c' || (length(keyword) % 5) AS category, count(*) AS n, md5(string_agg(keyword, ',' ORDER BY keyword)) AS digest FROM m GROUP BY ALL""",
    "news_search": f"WITH {ENRICHED} SELECT doc_id, source, impact AS impact_score FROM e WHERE contains(t, 'of the') AND contains(lower(source), 'src1') AND impact >= 5",
    "news_relevant": f"WITH {ENRICHED} SELECT doc_id, impact AS impact_score FROM e WHERE impact >= 8 OR list_contains(cats, 'stems')",
    "news_page": f"WITH {ENRICHED} SELECT doc_id, source, impact AS impact_score FROM e ORDER BY impact DESC, doc_id LIMIT 20 OFFSET 40",
    "news_page_info": f"WITH {ENRICHED} SELECT 'success' AS status, greatest(least(count(*) - 40, 20), 0)::BIGINT AS count, count(*) AS total, 20 AS limit, 40 AS offset FROM e WHERE impact >= 2",
    "keyset_scan": "SELECT doc_id, lang, source FROM documents WHERE doc_id > 17 ORDER BY doc_id LIMIT 25",
    "dedupe_first": f"WITH {_COUNTED} SELECT url, doc_id, source FROM r WHERE rn = 1 AND fresh",
    "ingest_counters": f"WITH {_COUNTED} SELECT source, {_COUNTS} FROM r GROUP BY source",
    "ingest_rollup": f"""WITH {_COUNTED}, c AS (SELECT source, {_COUNTS} FROM r GROUP BY source), n AS (SELECT *, try_cast(substr(source, 4) AS INTEGER) AS o FROM c),
  g AS (SELECT *, CASE WHEN o < {REGIONAL_FEEDS} THEN 'kenya' WHEN o < {len(FEEDS)} THEN 'global' ELSE 'other' END AS region FROM n)
  SELECT region, source, sum(fetched)::BIGINT AS fetched, sum(saved)::BIGINT AS saved, sum(duplicates)::BIGINT AS duplicates, 0::BIGINT AS invalid, count(*) FILTER (saved > 0) AS feeds_with_news FROM g GROUP BY ROLLUP (region, source)""",
    "feed_regions": "SELECT source, CASE WHEN o < 4 THEN 'kenya' WHEN o < 9 THEN 'global' ELSE 'other' END AS region, coalesce(label, 'Unknown') AS label, n FROM (SELECT source, count(*) AS n, substr(source, 4)::INTEGER AS o FROM documents GROUP BY source) LEFT JOIN (VALUES "
    + ", ".join(f"({i}, '{label}')" for i, label in enumerate(name for name, _ in FEEDS)) + ") f(ord, label) ON o = ord",
    "ingest_headlines": f"""{_INGEST},
  r AS (SELECT k.*, row_number() OVER (PARTITION BY k.url ORDER BY doc_id) AS rn, old.url IS NULL AS fresh FROM k LEFT JOIN old USING (url) WHERE impact >= 2),
  a AS (SELECT source, count(*) AS fetched, count(*) FILTER (impact < 2) AS invalid FROM k GROUP BY source), b AS (SELECT source, count(*) FILTER (rn = 1 AND fresh) AS saved, count(*) - count(*) FILTER (rn = 1 AND fresh) AS duplicates FROM r GROUP BY source)
  SELECT source, fetched, coalesce(saved, 0) AS saved, coalesce(duplicates, 0) AS duplicates, invalid FROM a LEFT JOIN b USING (source)""",
    "clean_text": f"SELECT doc_id, md5({_CLEAN}) AS digest, length(CASE WHEN length({_CLEAN}) > 255 THEN rtrim(substr({_CLEAN}, 1, 255)) ELSE {_CLEAN} END)::INTEGER AS cut_chars FROM documents",
    "strip_html": f"SELECT page_id, md5(trim({_SPACE.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")})) AS digest FROM pages",
    "meaningful": f"""SELECT doc_id, {_MEANINGFUL} AS meaningful, coalesce({_MEANINGFUL.replace('(f ', '(g ').replace('(f,', '(g,').replace('lower(f)', 'lower(g)').replace('trim(f)', 'trim(g)')}, false) AS text_meaningful FROM (SELECT doc_id, {_STRIP.format("text")} AS g, trim(CASE doc_id % 7 WHEN 0 THEN 'Read more...' WHEN 1 THEN 'https://www.google.com/url?q=x' WHEN 2 THEN 'n/a' WHEN 3 THEN ' 42 ' ELSE {_STRIP.format("text")} END) AS f FROM documents)""",
    "assemble": f"""WITH s AS (SELECT doc_id, {_STRIP.format("text")} AS h, CASE WHEN doc_id % 3 = 0 THEN '[Removed]' ELSE source END AS d, lang AS c FROM documents)
  SELECT doc_id, CASE WHEN {_MEANINGFUL.replace('(f ', '(h ').replace('(f,', '(h,').replace('lower(f)', 'lower(h)').replace('trim(f)', 'trim(h)')} THEN concat_ws(' ', h, CASE WHEN d <> '[Removed]' AND length(d) >= 3 THEN d END, CASE WHEN length(c) >= 3 THEN c END) END AS assembled FROM s""",
    "quarantine_documents": "SELECT count(*) AS total, count(*) FILTER (NOT bad) AS saved, count(*) FILTER (bad) AS skipped FROM (SELECT length(text) < 100 OR length(text) > 10000 OR source = 'src0' AS bad FROM documents)",
}
