"""Grid, report-line, page and sentiment queries over stand-ins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import fundamentals as FN
from ..operators import grid as G
from ..operators import paging as P
from ..operators import policy as PO
from ..operators import sentiment as S
from ..session import table
from ..sources.dims import dim_currencies, dim_labels
from ..sources.readers import report_lines
from .news import _MEANINGFUL as MEANINGFUL
from .news import _STRIP as STRIP
from .macro_queries import months

LABELS = {"The": "revenue", "And": "eps", "Of": "shareholders_equity"}
SCORES = {"tion": 3, "of the": 2, "zu": -4}
TITLES = ["red widgets", "small brass ring", "blue bolts", "green gear", "large rod"]
POSITIVE, NEGATIVE = ["the", "and", "of"], ["que", "tion", "der"]


def _grid(spark, sf):
    """Rows of monthly tables, one table a year: a header row with the year (moved by nine, into 20xx), the months with notes and marks, a footer."""
    m = months(spark, sf).select("period", "year", "month", F.col("fuel_price"), F.coalesce("inflation", F.lit(0.0)).alias("inflation"))
    no = F.month("period")
    body = m.select("year", no.alias("row_idx"), F.array(
        F.when(no % 4 == 0, F.concat(F.lower("month"), F.lit("*"))).when(no % 4 == 1, F.concat("month", F.lit(":"))).otherwise(F.col("month")), F.lit("None"), F.col("inflation").cast("int").cast("string"),
        F.when(no == 7, "n.a.").otherwise(F.concat(F.lit("1,"), F.lpad(F.col("inflation").cast("int").cast("string"), 3, "0"), F.lit(".5"))), F.lit(" "), F.lit("7"), F.lit("8.5"), F.lit("9"),
    ).alias("cells"))
    label = (F.col("year").cast("int") + 9).cast("string")
    head = m.select("year").distinct().select("year", F.lit(0).alias("row_idx"), F.array(F.lit(" "), F.concat(label, F.lit(" "))).alias("cells"))
    foot = m.select("year").distinct().select("year", F.lit(99).alias("row_idx"), F.array(F.lit("Source: bureau"), F.lit("2026")).alias("cells"))
    return body.unionByName(head).unionByName(foot).withColumn("table_idx", F.col("year").cast("int")).drop("year")


def grid_year_fill(spark, sf):
    g = _grid(spark, sf).withColumn("token", F.element_at(G.tokens(F.col("cells")), 1))
    return G.carry_year(g, ["table_idx"], "row_idx", F.col("token")).select("table_idx", "row_idx", "token", "year")


def grid_parse(spark, sf):
    return G.parse_grid(_grid(spark, sf), ["table_idx"], G.GRIDS["fuel"])


def grid_parse_all(spark, sf):
    """Every indicator's configuration over the same tables: rows kept and value sums."""
    out = None
    for name, config in G.GRIDS.items():
        parsed = G.parse_grid(_grid(spark, sf), ["table_idx"], config)
        total = sum((F.sum(F.col(c).cast("decimal(18,3)")) for c in config.positions), F.lit(0).cast("decimal(18,3)"))
        part = parsed.agg(F.lit(name).alias("indicator"), F.count(F.lit(1)).alias("n"), total.cast("decimal(28,3)").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def _tables(spark, sf):
    """Documents as tables of line cells; a source is a report."""
    return table(spark, sf, "documents").select("source", "doc_id", F.split("text", "\n").alias("cells"))


def table_score(spark, sf):
    return G.table_score(_tables(spark, sf), ["source", "doc_id"], SCORES)


def table_select(spark, sf):
    return G.best_candidate(table_score(spark, sf), ["source"], "score", ["doc_id"])


def _contents(spark, sf):
    """Part names as contents lines with dot leaders, and a page for each line of a document."""
    lines = table(spark, sf, "part").select(F.concat(F.lit("d"), F.col("p_partkey") % 50).alias("doc_id"), F.col("p_partkey").cast("int").alias("line_no"), F.concat(F.lit("Table "), F.col("p_size"), F.lit(": "), "p_name", F.lit(" ........ "), F.col("p_size")).alias("line"))
    return lines, lines.select("doc_id", (F.floor((F.col("line_no") - 1) / F.lit(50)) + 1).cast("int").alias("page"))


def toc_pages(spark, sf):
    """The pages searched for each contents line."""
    lines, pages = _contents(spark, sf)
    return G.candidate_pages(G.parse_toc(lines), pages, 1).groupBy("doc_id", "title").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def fuzzy_title(spark, sf):
    return G.fuzzy_match(table(spark, sf, "part"), "p_name", "p_partkey", TITLES)


def fuzzy_names(spark, sf):
    """Part names for misspelt ones: of every fiftieth part, the name without its third letter and with its words turned."""
    part = table(spark, sf, "part")
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    asked = part.where("p_partkey % 50 = 0").select(F.concat(F.substring(turned, 1, 2), F.substring(turned, 4, 200)).alias("t")).distinct().orderBy("t")
    return G.fuzzy_match(part, "p_name", "p_partkey", [r["t"] for r in asked.collect()], 60.0)  # the requested names


def forex(spark, sf):
    """Exchange grids from nations: names by key, the rate from the last cell; unknown names and bad numbers go."""
    n = table(spark, sf, "customer")
    name = F.element_at(F.array(*[F.lit(x) for x in ("US DOLLAR", "STG POUND ", "the euro", "YEN", "usd", "Pound Sterling")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    rate = F.when(F.col("c_custkey") % 10 == 3, "n/a").otherwise((F.col("c_custkey") % 977).cast("string"))
    g = n.select(F.concat(F.lit("s"), F.col("c_nationkey")).alias("source_url"), F.lit(0).alias("table_idx"), F.col("c_custkey").cast("int").alias("row_idx"), F.array(name, F.lit("None"), rate).alias("cells"))
    return G.parse_forex(g, dim_currencies(spark)).select("source_url", "row_idx", "code", "pair", "rate")


def _lines(spark, sf):
    return report_lines(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def lines_label_value(spark, sf):
    """Lines that start with a label, with their first number; a number is added to each line by its place."""
    numbered = _lines(spark, sf).withColumn("line", F.concat_ws(" ", "line", F.when(F.col("line_no") % 2 == 1, F.concat(F.lit("1,0"), F.format_string("%02d", F.col("line_no") % 100)))))
    return FN.label_values(numbered, dim_labels(spark, LABELS))


def lines_next_value(spark, sf):
    numbered = _lines(spark, sf).select("doc_id", "line_no", F.when(F.col("line_no") % 2 == 1, F.concat(F.lit("7"), "line_no")).otherwise(F.regexp_replace("line", "[0-9]", "")).alias("line"))
    return FN.next_line_value(numbered, "of the")


def _funds(spark, sf):
    s = table(spark, sf, "supplier")
    c = F.col("s_suppkey")
    eps = F.when(c % 9 == 0, 0.0).when(c % 10 == 0, F.lit(None)).otherwise((c % 7).cast("double") / 4)
    return s.select(c.alias("user_id"), eps.alias("eps"), ((c % 50) * 10).cast("double").alias("revenue"), (c % 13).cast("double").alias("profit_after_tax"), (c % 8).cast("double").alias("shareholders_equity"), (c % 5).cast("double").alias("current_liabilities"), (c % 3).cast("double").alias("non_current_liabilities"), ((c % 4).cast("double") / 8).alias("dividend_per_share"), (c % 6).cast("double").alias("price"))


def ratios(spark, sf):
    r = FN.ratios(_funds(spark, sf))
    return r.select("user_id", *[F.round(F.col(c) * 720720).cast("long").alias(c) for c in ("pe_ratio", "dividend_yield", "debt_ratio", "net_profit_margin")])


def live_pe(spark, sf):
    ticks = table(spark, sf, "events").select("user_id", "ts", F.round(F.col("value") * 100).cast("double").alias("price"))
    return FN.live_pe(_funds(spark, sf).drop("price"), ticks, "user_id", "ts", "price", "eps").select("user_id", F.round(F.col("live_pe") * 15).cast("long").alias("live_pe_x15"))


def extract_fundamentals(spark, sf):
    """Documents as reports: labelled values, dividends, dates and what is missing."""
    numbered = _lines(spark, sf).withColumn("line", F.concat_ws(" ", "line", F.concat(F.lit("2,"), F.format_string("%03d", F.col("line_no") % 1000)), F.when(F.col("line_no") == 0, F.lit("30 June 2025"))))
    out = FN.extract_fundamentals(numbered, dim_labels(spark, LABELS), list(LABELS.values()))
    return out.select("doc_id", "report_date", "revenue", "eps", "shareholders_equity", F.array_join("missing", ",").alias("missing"))


def _labelled(spark, sf):
    l = table(spark, sf, "labels")
    label = F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return l.select("doc_id", S.signed_score(label, (F.col("doc_id") % 101).cast("double") / 100).alias("score"))


def score_signed(spark, sf):
    return _labelled(spark, sf)


def score_band(spark, sf):
    return _labelled(spark, sf).groupBy(S.score_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def headlines_of(d):
    """Documents as stored headlines; every eleventh has none, every fifth has a score already."""
    return d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("headline"), F.lit("[removed]").alias("description"), F.lit(None).cast("string").alias("content"), F.when(F.col("doc_id") % 5 == 0, 0.25).alias("sentiment_score"))


def lexicon():
    return S.lexicon_scorer(POSITIVE, NEGATIVE)


def lexicon_score(spark, sf):
    """Scores of documents by the lexicon, as ten-thousandths."""
    d = table(spark, sf, "documents")
    scored = S.score_text(d, F.col("text"), lexicon(), deep_clean=False)
    return scored.select("doc_id", F.round(F.col("score") * 10000).cast("long").alias("score_x10000"))


def score_stats(spark, sf):
    """Backfill of unscored rows: statistics of the run."""
    return S.run_statistics(S.backfill(headlines_of(table(spark, sf, "documents")), lexicon())).withColumn("average_score", F.round(F.col("average_score") * 10000).cast("long"))


def score_preview(spark, sf):
    wanted = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return S.preview(headlines_of(table(spark, sf, "documents")), wanted, lexicon()).groupBy("band", "valid").agg(F.count(F.lit(1)).alias("n"))


def page_links(spark, sf):
    return PO.page_links(table(spark, sf, "pages"))


def release_links(spark, sf):
    """Links that mention a term, dated by their place, newest first."""
    links = PO.page_links(table(spark, sf, "pages")).withColumn("title", F.concat(F.col("title"), F.lit(" Posted On: "), (F.col("page_id") % 28 + 1).cast("string"), F.lit("/"), (F.col("link_no") % 12 + 1).cast("string"), F.lit("/2025")))
    return PO.release_links(links, dt.date(2025, 6, 1), 20, ["the", "tion"], 150).select("page_id", "link_no", "url", "published")


def page_article(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(PO.article_text(F.col("html")).cast("binary")).alias("digest"))


def page_percent(spark, sf):
    text = PO.article_text(F.concat(F.coalesce("html", F.lit("")), F.lit("<p>"), F.col("page_id"), F.lit(".5 percent</p>")))
    return table(spark, sf, "pages").select("page_id", PO.release_summary(F.concat_ws(" ", text, F.concat("page_id", F.lit(".25 %")))).alias("s")).select("page_id", F.md5(F.col("s.summary").cast("binary")).alias("digest"), "s.rate", "s.stance", "s.signal")


def rate_history(spark, sf):
    """Rates in the articles of pages: each sentence end becomes a rate of the page's."""
    rate = F.concat(F.lit(" Central Bank Rate "), F.col("page_id") % 9, F.lit(".75% 10/0"), F.col("page_id") % 9 + 1, F.lit("/2025 "))
    text = F.concat(F.replace(PO.article_text(F.col("html")), F.lit("."), rate), F.lit(" then central bank rate 8% 2/1/2024"))
    return PO.rate_history(table(spark, sf, "pages").withColumn("t", text), "t")


def fundamentals_history(spark, sf):
    """The newest reports of a company; orders stand in for reports, customers for companies."""
    reports = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 100).alias("ticker"), F.col("o_orderdate").cast("date").alias("report_date"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("revenue"))
    return FN.history(reports, "c7", 20)


def pairs_in_order(spark, sf):
    """Exchange rows by a fixed order of their pairs: the place of each pair among the rows."""
    pairs = ["USD/KES", "EUR/KES", "GBP/KES"]
    found = forex(spark, sf).groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("top"))
    order = Window.orderBy(F.array_position(F.array(*map(F.lit, pairs)), F.col("pair")))  # a row a pair
    return found.select((F.row_number().over(order) - 1).alias("place"), "pair", "n", "top").orderBy("place")


def serialized(spark, sf):
    """Orders as JSON documents with ISO dates."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return o.select("o_orderkey", V.to_json_row(["o_orderkey", "day", "status"]).alias("json"))


def table_choice(spark, sf):
    """Tables of reports chosen by title: parts as contents lines, two tables a page."""
    lines, pages = _contents(spark, sf)
    tables = pages.withColumn("table_idx", F.explode(F.sequence(F.lit(0), F.lit(1)))).select("doc_id", "page", "table_idx", F.lit(0).alias("row_idx"), F.array(F.repeat(F.lit("rate "), (F.col("page") * 7 + F.col("table_idx") * 3) % 5), F.lit("total")).alias("cells"))
    return G.select_table(lines, tables, TITLES, {"rate": 2, "total": 1}, 1)


def rate_change(spark, sf):
    """Months as published rates, newest first within a year."""
    m = months(spark, sf).select("year", "period", "fuel_price")
    return PO.rate_change(m, ["year"], [F.desc("period")], "fuel_price")


def value_parsing(spark, sf):
    """Numbers, dates and months out of strings built from orders."""
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate")
    price = F.col("o_totalprice").cast("decimal(12,2)")
    url = F.concat(F.lit("https://x.org/r/leading-"), F.date_format(day, "MMMM-yyyy"), F.lit(".pdf"))
    return o.select(
        "o_orderkey", V.parse_date_dayfirst(F.date_format(day, "d/M/yyyy")).alias("day"), V.parse_report_month(F.date_format(day, "MMMM yyyy")).alias("report_month"), V.report_month_from_url(url)["label"].alias("label"),
        V.first_number(F.concat(F.lit("about "), F.format_number(price, 2), F.lit(" in total"))).cast("decimal(12,2)").alias("amount"), V.normalize_month(F.upper(F.date_format(day, "MMMM"))).alias("month"),
        V.last_long_date(F.concat(F.lit("1 May 1990 and "), F.date_format(day, "d MMMM yyyy"))).alias("last_date"), V.period(F.date_format(day, "MMMM"), F.date_format(day, "yyyy")).alias("period"),
        F.size(V.split_list(F.concat("o_orderpriority", F.lit(", ,x,"), "o_orderstatus"))).alias("n_parts"),
    )




def _sql_months() -> str:
    from .macro_queries import _M as months_sql

    return months_sql


_GRID = f"""WITH {_sql_months()}, b AS (SELECT year::INTEGER AS table_idx, month(period) AS row_idx, month, coalesce(inflation, 0)::INTEGER AS v FROM m)"""
_TABLES = "SELECT source, doc_id, lower(text) AS t FROM documents"
_LINES = "l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS o, trim(raw) AS line FROM documents) WHERE line <> '')"
_TOKENS = r"regexp_extract_all(lower(f), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')"
_POS, _NEG = (f"len(list_filter({_TOKENS}, lambda x: x IN ({', '.join(repr(x) for x in w)})))" for w in (POSITIVE, NEGATIVE))
_USABLE = MEANINGFUL.replace("length(trim(f)) >= 3 AND regexp_matches(f,", "length(trim(regexp_replace(f, '<[^>]+>', ' ', 'g'))) >= 3 AND regexp_matches(regexp_replace(f, '<[^>]+>', ' ', 'g'),")
_X10000 = "CASE WHEN pos > neg THEN round_even((pos - neg)::DOUBLE / (pos + neg) * 10000, 0) WHEN neg > pos THEN -round_even((neg - pos)::DOUBLE / (pos + neg) * 10000, 0) ELSE 0 END::BIGINT"
SCORED_SQL = f"""SELECT doc_id AS id, doc_id % 5 = 0 AS doc5, CASE WHEN ok THEN {_X10000} END AS score_x10000 FROM (SELECT doc_id, coalesce({_USABLE}, false) AS ok, {_POS} AS pos, {_NEG} AS neg
  FROM (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN {STRIP.format("text")} END AS f FROM documents))"""
_BARE = r"regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>', ' ', 'g')"
_PART = r"nullif(regexp_extract(bare, '(?is)<{0}\b[^>]*>(.*)</{0}>', 1), '')"
_PARTS = ", ".join(_PART.format(tag) for tag in ("article", "main", "body"))
_ARTICLE = rf"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce({_PARTS}, bare), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS article FROM (SELECT page_id, {_BARE} AS bare FROM ({{}}))"
_SCORE = """CASE WHEN toxic = 1 THEN -(doc_id % 101)::DOUBLE / 100 WHEN quality = 1 THEN (doc_id % 101)::DOUBLE / 100 ELSE 0.0 END"""
_LINKS = """p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS t,
  generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) - 1 AS link_no FROM pages),
 links AS (SELECT page_id, link_no::INTEGER AS link_no, url, trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM p)"""

QUERIES = {f.__name__: f for f in (
    grid_year_fill, grid_parse, grid_parse_all, table_score, table_select, toc_pages, fuzzy_title, fuzzy_names, forex, lines_label_value, lines_next_value, ratios, live_pe, extract_fundamentals, score_signed, score_band, lexicon_score, score_stats,
    score_preview, page_links, release_links, page_article, page_percent, rate_history, rate_change, value_parsing, fundamentals_history, pairs_in_order, serialized, table_choice,
)}
_CELL = "CASE WHEN row_idx = 7 THEN NULL ELSE ('1' || lpad(v::VARCHAR, 3, '0') || '.5')::DOUBLE END"
ORACLE = {
    "grid_year_fill": f"{_GRID}, y AS (SELECT DISTINCT table_idx FROM b) SELECT table_idx, row_idx::INTEGER AS row_idx, CASE row_idx % 4 WHEN 0 THEN lower(month) WHEN 1 THEN month || ':' ELSE month END AS token, (table_idx + 9)::VARCHAR AS year FROM b UNION ALL SELECT table_idx, 0, (table_idx + 9)::VARCHAR, (table_idx + 9)::VARCHAR FROM y UNION ALL SELECT table_idx, 99, 'Source: bureau', (table_idx + 9)::VARCHAR FROM y",
    "grid_parse": f"{_GRID} SELECT table_idx, row_idx::INTEGER AS row_idx, month, (table_idx + 9)::VARCHAR AS year, {_CELL} AS diesel_price FROM b WHERE row_idx <> 7",
    "table_score": "SELECT source, doc_id, (" + " + ".join(f"{w} * ((length(t) - length(replace(t, '{k}', ''))) // {len(k)})" for k, w in SCORES.items()) + f")::BIGINT AS score FROM (SELECT source, doc_id, replace(t, chr(10), ' ') AS t FROM ({_TABLES}))",
    "forex": """WITH g AS (SELECT 's' || c_nationkey AS source_url, c_custkey::INTEGER AS row_idx, (['US DOLLAR', 'STG POUND', 'THE EURO', 'YEN', 'USD', 'POUND STERLING'])[c_custkey % 6 + 1] AS n, c_custkey % 977 AS rate FROM customer WHERE c_custkey % 10 <> 3),
  r AS (SELECT source_url, row_idx, rate::DOUBLE AS rate, CASE WHEN n IN ('US DOLLAR', 'USD') THEN 'USD' WHEN n = 'THE EURO' THEN 'EUR' WHEN n <> 'YEN' THEN 'GBP' END AS code FROM g)
  SELECT source_url, row_idx, code, code || '/KES' AS pair, rate FROM r WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_url, code ORDER BY row_idx) = 1""",
    "lines_label_value": f"WITH {_LINES}, n AS (SELECT doc_id, line_no, line || CASE WHEN line_no % 2 = 1 THEN ' 1,0' || lpad((line_no % 100)::VARCHAR, 2, '0') ELSE '' END AS line FROM l), h AS (SELECT doc_id, line_no, field, try_cast(replace(nullif(regexp_extract(line, '-?[0-9][0-9,]*(\\.[0-9]+)?'), ''), ',', '') AS DOUBLE) AS value FROM n JOIN (VALUES "
    + ", ".join(f"('{k.lower()}', '{v}')" for k, v in LABELS.items()) + ") x(label, field) ON starts_with(lower(line), label)) SELECT doc_id, field, arg_min(value, line_no) AS value FROM h WHERE value IS NOT NULL GROUP BY ALL",
    "lines_next_value": f"WITH {_LINES}, n AS (SELECT doc_id, line_no, CASE WHEN line_no % 2 = 1 THEN '7' || line_no ELSE regexp_replace(line, '[0-9]', '', 'g') END AS line FROM l), w AS (SELECT doc_id, line_no, line, lead(CASE WHEN line_no % 2 = 1 THEN ('7' || line_no)::DOUBLE END) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM n) SELECT doc_id, arg_min(nxt, line_no) AS value FROM w WHERE line_no % 2 = 0 AND contains(lower(line), 'of the') AND nxt IS NOT NULL GROUP BY doc_id",
    "ratios": """SELECT c AS user_id, CASE WHEN price > 0 THEN round(coalesce(price / nullif(eps, 0), 0) * 720720)::BIGINT END AS pe_ratio, CASE WHEN price > 0 THEN round((c % 4) / 8 / price * 720720)::BIGINT END AS dividend_yield,
  round(coalesce((c % 5 + c % 3) / nullif(c % 8, 0)::DOUBLE, 0) * 720720)::BIGINT AS debt_ratio, round(coalesce((c % 13) / nullif((c % 50) * 10, 0)::DOUBLE, 0) * 720720)::BIGINT AS net_profit_margin
  FROM (SELECT s_suppkey AS c, (s_suppkey % 6)::DOUBLE AS price, CASE WHEN s_suppkey % 9 = 0 THEN 0.0 WHEN s_suppkey % 10 = 0 THEN NULL ELSE (s_suppkey % 7)::DOUBLE / 4 END AS eps FROM supplier)""",
    "live_pe": """SELECT c AS user_id, CASE WHEN eps <> 0 THEN round(price / eps * 15)::BIGINT END AS live_pe_x15 FROM (SELECT s_suppkey AS c, CASE WHEN s_suppkey % 9 = 0 THEN 0.0 WHEN s_suppkey % 10 = 0 THEN NULL ELSE (s_suppkey % 7)::DOUBLE / 4 END AS eps FROM supplier)
  LEFT JOIN (SELECT user_id, arg_max(p, struct_pack(a := ts, b := p)) AS price FROM (SELECT user_id, ts, round(value * 100)::DOUBLE AS p FROM events) GROUP BY user_id) e ON e.user_id = c""",
    "score_signed": f"SELECT doc_id, ({_SCORE})::DOUBLE + 0.0 AS score FROM labels",
    "score_band": f"SELECT CASE WHEN s >= 0.5 THEN 'Strong Positive' WHEN s >= 0.2 THEN 'Moderate Positive' WHEN s <= -0.5 THEN 'Strong Negative' WHEN s <= -0.2 THEN 'Moderate Negative' ELSE 'Strict Neutral' END AS band, count(*) AS n FROM (SELECT {_SCORE} AS s FROM labels) GROUP BY ALL",
    "page_links": f"WITH {_LINKS} SELECT page_id, link_no, url, title FROM links",
    "release_links": f"WITH {_LINKS}, d AS (SELECT *, make_date(2025, (link_no % 12 + 1)::INTEGER, (page_id % 28 + 1)::INTEGER) AS published FROM links WHERE contains(lower(title || ' ' || url), 'the') OR contains(lower(title || ' ' || url), 'tion')), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, link_no) = 1) SELECT page_id, link_no, url, published FROM f WHERE published >= DATE '2025-06-01' - INTERVAL 150 DAY ORDER BY published DESC, url LIMIT 20",
    "rate_history": f"""WITH a AS ({_ARTICLE.format("pages")}), r AS (SELECT page_id, length(article) - length(replace(article, '.', '')) AS n, unnest(range(length(article) - length(replace(article, '.', '')) + 1)) AS i FROM a)
  SELECT page_id, i::INTEGER AS rate_no, CASE WHEN i < n THEN (page_id % 9) + 0.75::DOUBLE ELSE 8.0::DOUBLE END AS rate, CASE WHEN i < n THEN make_date(2025, (page_id % 9 + 1)::INTEGER, 10) ELSE DATE '2024-01-02' END AS published FROM r""",
    "page_article": f"SELECT page_id, md5(article) AS digest FROM ({_ARTICLE.format('pages')})",
    "page_percent": rf"""SELECT page_id, md5(substr(t, 1, 450)) AS digest, nullif(regexp_extract(t, '(\d+(?:\.\d+)?)\s*(?:percent|per cent|%)', 1), '')::DOUBLE AS rate, 'neutral' AS stance, 'unknown' AS signal
  FROM (SELECT page_id, article || ' ' || page_id || '.25 %' AS t FROM ({_ARTICLE.format("SELECT page_id, coalesce(html, '') || '<p>' || page_id || '.5 percent</p>' AS html FROM pages")}))""",
    "toc_pages": """WITH l AS (SELECT 'd' || (p_partkey % 50) AS doc_id, p_name AS title, p_size + 1 AS target, (p_partkey - 1) // 50 + 1 AS page FROM part), m AS (SELECT doc_id, max(page) AS last FROM l GROUP BY doc_id),
  s AS (SELECT doc_id, title, greatest(target - 1, 0) AS a, least(target + 3, last) AS b FROM l JOIN m USING (doc_id))
  SELECT doc_id, title, sum(b - a + 1)::BIGINT AS n, min(a)::INTEGER AS first_page, max(b)::INTEGER AS last_page FROM s WHERE a <= b GROUP BY doc_id, title""",
    "extract_fundamentals": rf"""WITH {_LINES}, n AS (SELECT doc_id, line_no, line || ' 2,' || lpad((line_no % 1000)::VARCHAR, 3, '0') || CASE WHEN line_no = 0 THEN ' 30 June 2025' ELSE '' END AS line FROM l),
  h AS (SELECT doc_id, line_no, field, try_cast(replace(nullif(regexp_extract(line, '-?[0-9][0-9,]*(\.[0-9]+)?'), ''), ',', '') AS DOUBLE) AS value FROM n JOIN (VALUES {", ".join(f"('{k.lower()}', '{v}')" for k, v in LABELS.items())}) x(label, field) ON starts_with(lower(line), label)),
  v AS (SELECT doc_id, field, arg_min(value, line_no) AS value FROM h WHERE value IS NOT NULL GROUP BY ALL),
  d AS (SELECT doc_id, try_strptime(regexp_replace(regexp_extract_all(string_agg(line, chr(10) ORDER BY line_no), '[0-9]{{1,2}}\s+[A-Za-z]+\s+[0-9]{{4}}')[-1], '\s+', ' ', 'g'), '%d %B %Y')::DATE AS report_date FROM n GROUP BY doc_id),
  w AS (SELECT doc_id, any_value(report_date) AS report_date, {", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in LABELS.values())} FROM d LEFT JOIN v USING (doc_id) GROUP BY doc_id)
  SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in [*LABELS.values(), "report_date"])}) AS missing FROM w""",
    "lexicon_score": f"SELECT doc_id, CASE WHEN ok THEN {_X10000} END AS score_x10000 FROM (SELECT doc_id, coalesce({_USABLE}, false) AS ok, {_POS} AS pos, {_NEG} AS neg FROM (SELECT doc_id, {STRIP.format('text')} AS f FROM documents))",
    "score_stats": f"""SELECT count(*) FILTER (NOT doc5) AS processed, count(*) FILTER (NOT doc5 AND score_x10000 IS NOT NULL) AS updated, count(*) FILTER (NOT doc5 AND score_x10000 IS NULL) AS skipped, 0::BIGINT AS failed,
  round(coalesce(avg(score_x10000) FILTER (NOT doc5), 0))::BIGINT AS average_score, CASE WHEN count(*) FILTER (NOT doc5) = 0 THEN 'no_data' ELSE 'success' END AS status FROM ({SCORED_SQL})""",
    "score_preview": f"""SELECT CASE WHEN s IS NULL THEN NULL WHEN s >= 5000 THEN 'Strong Positive' WHEN s >= 2000 THEN 'Moderate Positive' WHEN s <= -5000 THEN 'Strong Negative' WHEN s <= -2000 THEN 'Moderate Negative' ELSE 'Strict Neutral' END AS band,
  s IS NOT NULL AS valid, count(*) AS n FROM (SELECT id, score_x10000 AS s FROM ({SCORED_SQL}) WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY ALL""",
    "fundamentals_history": "SELECT 'c7' AS ticker, o_orderdate::DATE AS report_date, o_orderkey AS id, o_totalprice AS revenue FROM orders WHERE o_custkey % 100 = 7 ORDER BY report_date DESC, id DESC LIMIT 20",
    "serialized": """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","status":' || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS json FROM orders""",
    "rate_change": f"WITH {_sql_months()}, r AS (SELECT year, period, fuel_price, lead(fuel_price) OVER (PARTITION BY year ORDER BY period DESC) AS previous_rate FROM m) SELECT *, fuel_price - previous_rate AS rate_delta, CASE WHEN fuel_price - previous_rate IS NULL THEN 'unknown' WHEN fuel_price > previous_rate THEN 'increase' WHEN fuel_price < previous_rate THEN 'decrease' ELSE 'unchanged' END AS direction FROM r",
    "value_parsing": "SELECT o_orderkey, o_orderdate::DATE AS day, date_trunc('month', o_orderdate)::DATE AS report_month, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%B %Y') END AS label, o_totalprice::DECIMAL(12,2) AS amount, strftime(o_orderdate, '%B') AS month, o_orderdate::DATE AS last_date, date_trunc('month', o_orderdate)::DATE AS period, 3::INTEGER AS n_parts FROM orders",
}
ORACLE["table_select"] = f"SELECT source, doc_id, score FROM ({ORACLE['table_score']}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1"
ORACLE["grid_parse_all"] = f"""{_GRID}, f AS (SELECT count(*) AS n, sum(({_CELL})::DECIMAL(18,3)) AS d FROM b WHERE row_idx <> 7), e AS (SELECT sum(v::DECIMAL(18,3)) AS d FROM b WHERE row_idx <> 7)
  SELECT 'fuel' AS indicator, n, d::DECIMAL(28,3) AS total FROM f UNION ALL SELECT 'cbr', count(*), (8.5 * count(*))::DECIMAL(28,3) FROM b UNION ALL SELECT 'inflation', count(*), (9 * count(*))::DECIMAL(28,3) FROM b
  UNION ALL SELECT 'exchange', (SELECT n FROM f), ((SELECT d FROM f) + (SELECT d FROM e) + 7 * (SELECT n FROM f))::DECIMAL(28,3)"""
ORACLE["pairs_in_order"] = f"SELECT (list_position(['USD/KES', 'EUR/KES', 'GBP/KES'], pair) - 1)::INTEGER AS place, pair, count(*) AS n, max(rate) AS top FROM ({ORACLE['forex']}) GROUP BY pair"
