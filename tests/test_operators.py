"""Worked examples, properties and argument errors of single operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from finsignal.functions import rules, text, values
from finsignal.operators import fundamentals, grid, headlines, keywords, macro, paging, policy, quotes, sentiment, upsert
from finsignal.sources import dims, readers


def one(spark, column, **cells):
    return spark.createDataFrame([Row(**cells)]).select(column.alias("x")).first()["x"]


def test_keyword_examples(spark):
    line = "Fuel prices rise as oil markets react to Middle East war fears."
    r = keywords.enrich(spark.createDataFrame([(line,), ("warfare soil",), (None,)], "t string"), F.col("t")).collect()
    assert (r[0]["keywords"], r[0]["categories"], r[0]["impact_score"]) == (["fuel", "middle east", "oil", "war"], ["energy_sector", "geopolitics"], 13)
    assert r[1]["keywords"] == [] and r[2]["impact_score"] == 0
    assert one(spark, keywords.impact_score(F.array(F.lit("fuel"), F.lit("oil"), F.lit("war"))), a=1) == 12


def test_texts_are_matched_once(spark, sf_dir):
    """One lower-casing and one list of words a text in the plans, no matching in a filter; entries are cleaned once."""
    import re

    from finsignal.plans import news

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    articles = headlines.enrich_articles(headlines.normalize_entry(news.entries_of(docs)), news.WORDS)  # links are digests of lower-case texts here
    for df, lowers in ((keywords.enrich(docs, F.col("text")), 1), (headlines.min_impact_gate(keywords.enrich(docs, F.col("text"), news.WORDS)), 1), (articles, 2)):
        text = plan(df)
        assert len(re.findall(r"regexp_extract_all\(", text)) == 1 and len(re.findall(r"\blower\(", text)) == lowers and "RLIKE" not in text
        assert not any("regexp_extract_all" in line for line in text.splitlines() if "Filter" in line)
        assert text.count("translate(") <= 2 * 9  # nine fields, two replacements each


def test_terms_with_marks(spark):
    d = dims.Dictionary({"x": ["at&t", "u.s", "oil", "oil price", "größe"]}, {})
    rows = [("AT&T and U.S oil-price; GRÖSSE größe",), ("at&ts u.sx oil prices soil price",), ("größer boat&t",), ("",)]
    got = [r["keywords"] for r in keywords.enrich(spark.createDataFrame(rows, "t string"), F.col("t"), d).collect()]
    assert got == [["at&t", "größe", "oil", "u.s"], ["oil", "oil price"], [], []]


def test_large_dictionary(spark, sf_dir):
    """10,000 words, phrases and terms with marks, joined to texts: what a plain search of every term in every text gives,
    and what the expression form gives for a part of them."""
    import re

    texts = {r["doc_id"]: (r["text"] or "").lower() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    own = [re.findall(r"\w+", t) for t in texts.values()]
    terms = sorted({w for ws in own for w in ws[:40]})
    terms += sorted({" ".join(ws[i : i + n]) for ws in own for n in (2, 3) for i in range(0, len(ws) - n, 5)} | {ws[0][-2:] + " " + ws[1][:4] for ws in own if len(ws) > 1})[: 9900 - len(terms)]
    terms += [f"{w}-x{i}" for i, w in enumerate(terms[:50])] + sorted({m for t in texts.values() for m in re.findall(r"\w+[-'.]\w+", t)})[:50]
    terms += [f"none{i}" for i in range(10_000 - len(terms))]
    words = spark.createDataFrame([("c", k) for k in terms], "category string, keyword string")
    got = {}
    for r in keywords.match_terms(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", words).collect():
        got.setdefault(r["doc_id"], []).append(r["keyword"])
    for i, t in texts.items():
        runs = set(re.findall(r"\w+", t))
        want = [k for k in terms if (k in t if " " in k else k in runs if re.fullmatch(r"\w+", k) else k in t and re.search(rf"\b{re.escape(k)}\b", t))]
        assert sorted(got.get(i, [])) == sorted(set(want))
    part = dims.Dictionary({"c": terms[::97]}, {})
    for r in keywords.enrich(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("text"), part).collect():
        assert r["keywords"] == sorted(set(got.get(r["doc_id"], [])) & set(terms[::97]))
    with pytest.raises(ValueError):
        keywords.match_terms(words, "keyword", "keyword", spark.createDataFrame([("c", "&&")], words.schema))


def test_terms_are_matched_in_one_pass(spark):
    """The words and spaces of a text are taken once, for words, phrases and terms with marks; a dictionary may lack any kind."""
    df = spark.createDataFrame([(1, "The war of the at&t, warship"), (2, None), (None, "war"), (1, "oil war")], "id long, text string")
    found = lambda terms: keywords.match_terms(df, "id", "text", spark.createDataFrame([("c", t) for t in terms], "category string, keyword string"))
    every = found(["war", "of th", "at&t", "oil war", "ar of"])
    assert every._jdf.queryExecution().optimizedPlan().toString().count("(?s)(?=") == 1
    assert {tuple(r) for r in every.collect()} == {(1, "c", t) for t in ("war", "of th", "at&t", "oil war", "ar of")}
    assert {tuple(r) for r in found(["war", "wars"]).collect()} == {(1, "c", "war")}
    assert {tuple(r) for r in found(["he w"]).collect()} == {(1, "c", "he w")}


def test_terms_are_compared_where_they_were_met(spark):
    """For words and phrases a text is read once, dealt out once and never searched for what met it; only terms with marks and
    phrases of many spaces go back to the texts."""
    df = spark.createDataFrame([(1, "The war of the oil price")], "id long, text string")
    plan = lambda terms: keywords.match_terms(df, "id", "text", spark.createDataFrame([("c", t) for t in terms], "category string, keyword string"))._jdf.queryExecution().optimizedPlan().toString()
    plain = plan(["war", "of th", "oil price"])
    assert plain.count("lower(") == 1 and plain.count("RepartitionByExpression") == 1 and "Contains(_fs_low" not in plain
    assert plan(["war", "of th", "at&t"]).count("lower(") == 2


def test_terms_are_broadcast_whatever_their_files(spark, monkeypatch):
    """The pieces of texts are not shuffled for a dictionary that fits, though Spark's own limit is lower; a larger one gives the same."""
    df = spark.createDataFrame([(1, "The war of the oil price")], "id long, text string")
    words = spark.createDataFrame([("c", t) for t in ("war", "of th", "oil price", "none")], "category string, keyword string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = keywords.match_terms(df, "id", "text", words)
        assert "SortMergeJoin" not in small._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(keywords, "BROADCAST", 0)
        large = keywords.match_terms(df, "id", "text", words)
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(large.collect()) == sorted(small.collect()) and small.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_terms_in_odd_places(spark):
    """Every term in every text as a plain search finds it: spaces at ends and in rows, one-letter words, line ends, characters
    beyond 16 bits, words that end a text, phrases of more spaces than are held, keys that come twice."""
    import re

    texts = ["a b", " a b ", "a  b", "x a b\nc d", "the end of", "of the\tend of  the end", "o f", "\U0001f600 a\U0001f600 b", "ba bc", "  ", "", "one two three four five six seven eight nine", "one two three four five six seven eight", "größe über alles ü", "at&t a b", "z\x00 b", "of", "theend of"]
    terms = ["a b", "a", "b", " b", "a ", "a  b", "  ", " ", "b c", "end of", "d of", "f t", "the end of", "of the", "o f", "\U0001f600 b", "\U0001f600 a", "e über", "ü", "n a", "z", "\x00 b", "at&t", "two three four five six seven eight nine", "two three four five six seven", "e two three four five six seven eight n", "seven eight", "b\nc d", "d of  the e"]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, "a b")], "id long, text string")
    for some in (terms, [t for t in terms if t != "at&t" and t.count(" ") < 7], [t for t in terms if re.fullmatch(r"\w+", t)]):
        words = spark.createDataFrame([("c", t) for t in some] + [("d", some[0]), ("c", None)], "category string, keyword string")
        got = sorted(tuple(r) for r in keywords.match_terms(df, "id", "text", words).collect())
        held = lambda k, t: k in t if " " in k else re.search(rf"(?<!\w){re.escape(k)}(?!\w)", t)
        assert got == sorted({(i, c, k) for i, t in rows for c, k in [("c", k) for k in some] + [("d", some[0])] if held(k, t)})


@pytest.mark.parametrize(("raw", "want"), [("+0.33%", 0.33), ("-2.26%", -2.26), ("abc", None), ("", None)])
def test_change_pct(spark, raw, want):
    assert one(spark, values.parse_change_pct(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("1,234.50", "1234.500"), ("15.40", "15.400"), ("N/A", None), ("12.5f", None), ("0.0005", "0.000")])
def test_price(spark, raw, want):
    got = one(spark, values.parse_price(F.col("c")), c=raw)
    assert (None if got is None else str(got)) == want


def test_daily_change(spark):
    price, pct = F.lit("15.40").cast("decimal(10,3)"), F.lit(0.33)
    assert str(one(spark, quotes.daily_change(price, pct), a=1)) == "0.051"


@pytest.mark.parametrize(("score", "band"), [(0.195, "Strict Neutral"), (-0.195, "Strict Neutral"), (0.5, "Strong Positive"), (0.2, "Moderate Positive"), (-0.2, "Moderate Negative"), (-0.5, "Strong Negative"), (None, None)])
def test_bands(spark, score, band):
    assert one(spark, sentiment.score_band(F.lit(score).cast("double")), a=1) == band


def test_text_rules(spark):
    assert one(spark, text.clean_text(F.col("c")), c=" a b​\r\n c\t") == "a b c"
    assert one(spark, text.clean_text(F.lit(None).cast("string")), a=1) == ""
    for bad in ("[Removed]", "read more..", "N/A", "  ", "12", "https://www.google.com/url?q=1", "<b>x</b>"):
        assert one(spark, text.is_meaningful(F.col("c")), c=bad) is False
    assert one(spark, text.is_meaningful(F.col("c")), c="Rates rise") is True
    assert one(spark, text.assemble_text(F.col("h"), F.col("d")), h="Rates rise", d="untitled") == "Rates rise"
    assert one(spark, text.clean_for_scoring(F.col("c")), c="<p>A &amp; ﬁne</p>") == "A & fine"
    assert one(spark, text.truncate(F.col("c"), 4), c="abc def") == "abc"


def test_dates(spark):
    got = one(spark, values.report_month_from_url(F.col("c")), c="https://x.org/leading-March-2026.pdf")
    assert (got["month"], got["year"], got["label"]) == ("March", "2026", "March 2026")
    assert one(spark, values.last_long_date(F.col("c")), c="at 1 May 2024 and 30 June 2025.") == dt.date(2025, 6, 30)
    assert one(spark, values.last_long_date(F.col("c")), c="none") is None
    assert one(spark, values.publication_date(F.col("c")), c="9/9/2020 Posted On: 10/06/2025") == dt.date(2025, 6, 10)
    assert one(spark, values.period(F.lit("Foo"), F.lit("2024")), a=1) is None
    want = dt.datetime(2026, 3, 2, 7)
    assert one(spark, values.parse_timestamp_iso(F.col("c")), c="2026-03-02T10:00:00") == one(spark, values.parse_timestamp_iso(F.col("c")), c="2026-03-02T07:00:00Z")
    assert one(spark, values.parse_feed_date(F.col("c"), F.lit(None).cast("string")).cast("string"), c="Mon, 02 Mar 2026 07:00:00 GMT") == want.strftime("%Y-%m-%d %H:%M:%S")


def test_lists_and_tokens(spark):
    df = spark.createDataFrame([("fuel, oil",), ("tariff",), ("fuel",)], "k string").select(values.split_list(F.col("k")).alias("k"))
    assert sorted(r[0] for r in keywords.distinct_tokens(df, "k").collect()) == ["fuel", "oil", "tariff"]


def test_entries(spark):
    schema = dims.SCHEMAS["feed_entries"]
    rows = [(0, 0, "u", "L", "T", "Oil war", "Oil war", None, "x", None, None, None, None), (0, 1, "u", None, "T", None, "budget", None, None, "y", None, None, None), (0, 2, "u", None, None, None, None, None, None, None, None, None, None), (1, 0, "u", "L", None, "Oil war again", None, None, "x", None, None, None, None), (1, 1, "u", "L", None, "nothing", None, None, "z", None, None, None, None)]
    entries = spark.createDataFrame(rows, schema)
    existing = spark.createDataFrame([("y",)], "url string")
    fresh, counters = headlines.ingest_headlines(entries, existing)
    assert [r["url"] for r in fresh.collect()] == ["x"] and fresh.first()["description"] is None
    for r in counters.collect():
        assert r["fetched"] == r["saved"] + r["duplicates"] + r["invalid"]
    again, _ = headlines.ingest_headlines(entries, existing.unionByName(fresh.select("url")))
    assert again.count() == 0


def test_fill_null_upsert_properties(spark):
    old = spark.createDataFrame([("May", "2025", 1.0, None), ("June", "2025", None, 2.0), ("July", None, 9.0, 9.0)], "month string, year string, a double, b double")
    new = spark.createDataFrame([("May", "2025", 5.0, 6.0), ("June", "2025", None, 7.0), ("July", None, 1.0, 1.0), ("May", "2026", 3.0, None)], old.schema)
    out = upsert.fill_null_upsert(old, new, ["month", "year"], ["a", "b"])
    got = {(r["month"], r["year"], r["action"]): (r["a"], r["b"]) for r in out.collect()}
    assert got[("May", "2025", "updated")] == (1.0, 6.0) and got[("June", "2025", "unchanged")] == (None, 2.0)
    assert ("July", None, "inserted") in got and ("July", None, "kept") in got and ("May", "2026", "inserted") in got
    keyed, fresh = (d.where("year is not null") for d in (out.drop("action"), new))
    assert {r["action"] for r in upsert.fill_null_upsert(keyed, fresh, ["month", "year"], ["a", "b"]).collect()} == {"unchanged"}


def test_refresh_is_independent_of_source_order(spark):
    base = spark.createDataFrame([("May", "2025", 1.0, None)], "month string, year string, a double, b double")
    fa = spark.createDataFrame([("May", "2025", 7.0), ("June", "2025", 8.0)], "month string, year string, a double")
    fb = spark.createDataFrame([("May", "2025", 3.0)], "month string, year string, b double")
    columns = {"x": ["a"], "y": ["b"]}
    runs = [sorted(map(str, macro.refresh_all(base, fr, ["month", "year"], columns).collect())) for fr in ({"x": fa, "y": fb}, {"y": fb, "x": fa})]
    assert runs[0] == runs[1]


def test_other_updates(spark):
    d = spark.createDataFrame([(1, 1), (2, None)], "id int, v int")
    u = spark.createDataFrame([(2, 5), (3, 6), (1, None)], "id int, v int")
    assert sorted(map(tuple, upsert.update_by_key(d, u, "id", "v").collect())) == [(1, 1), (2, 5)]
    fresh, conflict = upsert.insert_strict(u, d, ["id"])
    assert [r["id"] for r in fresh.collect()] == [3] and sorted(r["id"] for r in conflict.collect()) == [1, 2]
    ids = upsert.assign_ids(spark.range(100).withColumnRenamed("id", "k"), [F.desc("k")], 10, 4).orderBy("id").collect()
    assert [r["id"] for r in ids] == list(range(11, 111)) and ids[0]["k"] == 99


def test_pages_make_the_whole_order(spark):
    df = spark.range(23).withColumn("s", F.col("id") % 5)
    order = [F.desc("s"), F.asc("id")]
    parts = [r["id"] for n in range(1, 6) for r in paging.page(df, order, n, 5).collect()]
    assert parts == [r["id"] for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("call", [lambda: rules.check_page(0, 5), lambda: rules.check_page(1, 101), lambda: rules.check_window(0), lambda: rules.check_window(1, -1), lambda: rules.check_range(2, 1), lambda: rules.check_month("Foo"), lambda: rules.check_term("  "), lambda: rules.envelope_ok(["data"])])
def test_argument_errors(call):
    with pytest.raises(ValueError):
        call()


def test_grid_and_toc(spark):
    rows = [("t", 0, ["2026"]), ("t", 1, ["January", "177.25", "167.84", "152.18", "3122.16", "86.22"]), ("t", 2, ["March*", "1", "x", "3", "4", "5"]), ("t", 3, ["Source: ..."]), ("t", 4, ["april:", "1", "1,234.5", "3", "4", None, "5"])]
    df = spark.createDataFrame(rows, "doc string, row_idx int, cells array<string>")
    got = grid.parse_grid(df, ["doc"], grid.GRIDS["fuel"]).orderBy("row_idx").collect()
    assert [(r["month"], r["year"], r["diesel_price"]) for r in got] == [("January", "2026", 167.84), ("April", "2026", 1234.5)]
    lines = spark.createDataFrame([("d", 0, "Table 1: CBR and Interest Rates ........... 6"), ("d", 1, "Table 1(a) Exchange Rates   12"), ("d", 2, "no table")], "doc_id string, line_no int, line string")
    assert [(r["title"], r["page"]) for r in grid.parse_toc(lines).orderBy("line_no").collect()] == [("CBR and Interest Rates", 6), ("Exchange Rates", 12)]
    best = grid.fuzzy_match(spark.createDataFrame([(1, "Interest Rates and CBR"), (2, "Fuel Prices")], "k int, title string"), "title", "k", ["fuel price", "zzzz"]).collect()
    assert [(r["target"], r["title"]) for r in best] == [("fuel price", "Fuel Prices")]


def test_fuzzy_titles_of_any_kind(spark):
    """Best titles by brute force: ties, nulls, case, other scripts, targets without a likely title, and few scorings."""
    import random

    from test_queries import best_titles

    draw = random.Random(8)
    words = ["Exchange", "Rates", "of", "Fuel", "prices", "Zinssätze", "überall", "金利", "CBR", "inflation", "a", "monthly", "12"]
    names = [" ".join(draw.choices(words, k=draw.randrange(1, 6))) for _ in range(400)] + ["", "x", "Fuel prices", "fuel Prices"]
    targets = ["fuel price", "RATES EXCHANGE", "金利 überall", "qqqq", "", "a", "inflation monthl", "Fuel prices"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [(None, 5), ("Fuel prices", 3)], "title string, k int").repartition(3)
    first = {}
    for i, n in enumerate(names):
        first[n] = min(first.get(n, 1 << 30), 3 if n == "Fuel prices" else i)
    for cutoff in (50.0, 85.0):
        got = {r["target"]: (r["title"], r["similarity"]) for r in grid.fuzzy_match(df, "title", "k", targets, cutoff).collect()}
        assert got == best_titles({n: k for n, k in first.items() if n}, [t for t in targets if t], cutoff)  # an empty text is like none
    assert grid.fuzzy_match(df, "title", "k", []).count() == 0 and grid.fuzzy_match(df.limit(0), "title", "k", targets).count() == 0


def test_report_lines(spark):
    doc = "Revenue from contracts with customers 219,285 231,124\nShareholders’ equity 109,335 87,314\nInterim dividend\n0.20\nRevenue from contracts with customers 1\n30 June 2025"
    lines = readers.report_lines(spark.createDataFrame([("d", doc)], "doc_id string, text string"), "doc_id", "text")
    out = fundamentals.extract_fundamentals(lines, dims.dim_labels(spark)).first()
    assert (out["revenue"], out["shareholders_equity"], out["dividend_per_share"], out["report_date"]) == (219285.0, 109335.0, 0.2, dt.date(2025, 6, 30))
    assert "eps" in out["missing"]


def test_zero_denominators(spark):
    row = spark.createDataFrame([(15.4, 0.0, 0.0, 1.0, 1.0, 0.0, 5.0, 0.0)], "price double, eps double, dividend_per_share double, current_liabilities double, non_current_liabilities double, shareholders_equity double, profit_after_tax double, revenue double")
    r = fundamentals.ratios(row).first()
    assert (r["pe_ratio"], r["debt_ratio"], r["net_profit_margin"]) == (0.0, 0.0, 0.0)


def test_policy(spark):
    pages = spark.createDataFrame([(1, '<body><script>x</script><article>Central Bank Rate 9.75% 10/06/2025 text Central Bank Rate 10% 08/04/2025</article><a href="/a">MPC <b>note</b></a></body>')], "page_id long, html string")
    assert [(r["url"], r["title"]) for r in policy.page_links(pages).collect()] == [("/a", "MPC note")]
    rates = policy.rate_history(pages.withColumn("t", policy.article_text(F.col("html"))), "t")
    first = policy.rate_change(rates, ["page_id"], [F.col("rate_no")], "rate").orderBy("rate_no").first()
    assert (first["rate"], first["previous_rate"], first["direction"]) == (9.75, 10.0, "decrease")


def test_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"success": True, "data": [{"ticker": " eqty", "name": "E", "volume": "4200000", "price": "42.00", "change": "-1.18%"}, {"ticker": "x", "name": "X", "volume": "", "price": "N/A", "change": "1"}], "meta": "m"}))
    raw = readers.read_quotes_json(spark, str(tmp_path / "q.json"))
    got = {r["ticker"]: r for r in quotes.ingest_quotes(raw).collect()}
    assert got["EQTY"]["reason"] is None and got["EQTY"]["volume"] == 4200000 and got["X"]["reason"] == "missing_price"
    (tmp_path / "f.json").write_text(json.dumps({"success": False, "data": [], "meta": ""}))
    assert readers.read_quotes_json(spark, str(tmp_path / "f.json")).count() == 0
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>u</link></item><item><title>B</title></item></channel></rss>")
    assert sorted(r["title"] for r in readers.read_feed_entries(spark, str(tmp_path / "feed.xml"), "xml").collect()) == ["A", "B"]
    (tmp_path / "r.txt").write_text(" a \n\n b")
    assert [r["line"] for r in readers.read_report_lines(spark, str(tmp_path / "r.txt")).orderBy("line_no").collect()] == ["a", "b"]
    empty, full = spark.range(0).toDF("v"), spark.range(2).toDF("v")
    assert readers.fallback_source(empty, full).where("fallback_used").count() == 2 and readers.fallback_source(full, full).where("fallback_used").count() == 0
    feeds = dims.dim_feeds(spark)
    assert feeds.count() == 9 and dims.dim_feeds(spark, "kenya").count() == 4
    assert dims.dim_keywords(spark).count() == 33 and len(dims.Dictionary().distinct()) == 31


def test_sentiment_backfill(spark):
    rows = [(1, "war and crisis", None, None, None), (2, "12", None, None, None), (3, "growth", None, None, 0.4)]
    df = spark.createDataFrame(rows, "id int, headline string, description string, content string, sentiment_score double")
    scorer = sentiment.lexicon_scorer(["growth"], ["war", "crisis"])
    out = {r["id"]: r for r in sentiment.backfill(df, scorer).collect()}
    assert out[1]["sentiment_score"] == -1.0 and out[2]["outcome"] == "skipped" and out[3]["outcome"] == "kept"
    stats = sentiment.run_statistics(sentiment.backfill(df, scorer)).first()
    assert (stats["processed"], stats["updated"], stats["status"]) == (2, 1, "success")
    assert {r["id"]: r["valid"] for r in sentiment.preview(df, spark.createDataFrame([(1,), (2,), (9,)], "id int"), scorer).collect()} == {1: True, 2: False}
    model = sentiment.model_scorer(lambda: lambda texts: [("positive", 0.5)] * len(texts))
    assert sentiment.backfill(df, model, "all").where("id = 1").first()["sentiment_score"] == 0.5


def test_select_table(spark):
    lines = spark.createDataFrame([("d", 0, "Table 1: Consumer fuel prices ...... 3"), ("d", 1, "Table 2: Exchange rates ...... 9")], "doc_id string, line_no int, line string")
    rows = [("d", 3, 0, 0, ["aviation fuel"]), ("d", 4, 0, 0, ["retail fuel fuel"]), ("d", 4, 1, 0, ["retail fuel fuel"]), ("d", 9, 0, 0, ["usd euro fuel fuel fuel"])]
    tables = spark.createDataFrame(rows, "doc_id string, page int, table_idx int, row_idx int, cells array<string>")
    best = grid.select_table(lines, tables, ["fuel prices"], {"fuel": 2, "aviation": -15}).collect()
    assert [(r["target"], r["page"], r["table_idx"], r["score"]) for r in best] == [("fuel prices", 4, 0, 4)]
    assert grid.select_table(lines, tables, ["fuel prices"], {"fuel": 2}, least={"retail": 1, "kerosene": 1}).count() == 0


def test_envelopes(spark):
    schema = "table_name string, report_date string, status string, source_url string, data array<struct<month string, year string, cbr string>>"
    envelopes = spark.createDataFrame([("t", "d", "success", "u", [("MARCH", "2026", "9.75"), ("Foo", "2026", "1")]), ("t", "d", "failed", "u", [("May", "2026", "1")]), ("t", "d", "success", "u", [])], schema)
    old = spark.createDataFrame([("February", "2026", 10.0)], "month string, year string, cbk_rate double")
    out = macro.refresh_indicator(old, macro.records_of(envelopes), dims.FIELD_MAPS["cbr"], {"cbk_rate": "cbr_trend"}, "changed")
    assert sorted((r["month"], r["action"], r["cbr_trend"]) for r in out.collect()) == [("February", "kept", None), ("March", "inserted", -0.25)]
    again = macro.refresh_indicator(out.select("month", "year", "cbk_rate"), macro.records_of(envelopes), dims.FIELD_MAPS["cbr"], {})
    assert again.where("action = 'inserted'").count() == 0


def test_ids_with_payload(spark):
    """Gapless ids in order over many rows that carry other columns."""
    n = 300_000
    df = spark.range(n).select(((F.col("id") * 7919) % 104729).alias("k"), F.col("id").alias("tie"), F.md5(F.col("id").cast("string")).alias("a"), F.rand(3).alias("b"), F.lit("x").alias("c"))
    got = upsert.assign_ids(df, [F.col("k"), F.col("tie")], 10)
    assert tuple(got.agg(F.countDistinct("id"), F.min("id"), F.max("id")).first()) == (n, 11, n + 10)
    rows = got.orderBy("id").select("k", "tie").limit(2000).collect()
    assert [tuple(r) for r in rows] == sorted((i * 7919 % 104729, i) for i in range(n))[:2000]


def test_update_never_multiplies(spark):
    have, new = spark.createDataFrame([(1, 0.1), (2, None)], "id long, s double"), spark.createDataFrame([(1, 0.5), (1, 0.7), (1, None), (3, 1.0)], "id long, s double")
    assert sorted(map(tuple, upsert.update_by_key(have, new, "id", "s").collect()), key=str) == [(1, 0.7), (2, None)]


def test_append(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, d string")
    upsert.append(df, str(tmp_path / "t"), ["d"])
    upsert.append(df, str(tmp_path / "t"), ["d"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_missing_fields(spark):
    df = spark.createDataFrame([("1", "x"), (None, "2"), ("", "3")], "a string, b string")
    assert values.missing_fields(df, {"a": "x", "b": "y", "none": "z"}).first().asDict() == {"missing_x": 2, "missing_y": 1, "missing_z": 3}


def test_history_bounds(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, i), i) for i in range(1, 9)] + [("B", dt.date(2025, 1, 1), 99)], "ticker string, report_date date, id int")
    assert [r["id"] for r in fundamentals.history(df, "A", 3).collect()] == [8, 7, 6]
    for bad in (0, 21):
        with pytest.raises(ValueError):
            fundamentals.history(df, "A", bad)


def test_feeds_to_articles(spark, tmp_path):
    """RSS files through to normalised articles."""
    item = "<item><title>{0} oil</title><description>{0} text</description><link>https://x.org/{0}</link><guid>g{0}</guid><pubDate>Mon, 02 Mar 2026 07:00:00 GMT</pubDate></item>"
    for name, n in (("b-feed", 2), ("a-feed", 1)):
        (tmp_path / f"{name}.xml").write_text(f"<rss><channel><title>T {name}</title><link>l</link>" + "".join(item.format(f"{name}{i}") for i in range(n)) + "</channel></rss>")
    entries = readers.read_feed_entries(spark, str(tmp_path), "xml")
    assert set(spark.read.schema(dims.SCHEMAS["feed_entries"]).json(spark.sparkContext.emptyRDD()).columns) == set(entries.columns)
    rows = headlines.normalize_entry(entries).orderBy("feed_ord", "entry_ord").collect()
    assert [(r["source"], r["headline"], r["url"], r["malformed"]) for r in rows] == [("a-feed", "a-feed0 oil", "https://x.org/a-feed0", False), *[("b-feed", f"b-feed{i} oil", f"https://x.org/b-feed{i}", False) for i in range(2)]]
    assert rows[0]["published_at"] is not None and rows[0]["description"] == "a-feed0 text"


def test_grid_and_page_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"source_url": "u", "page": 1, "table_idx": 0, "row_idx": 2, "cells": ["January", "1.5"]}))
    row = readers.read_table_grid(spark, str(tmp_path / "g.json")).first()
    assert row["cells"] == ["January", "1.5"] and row["row_idx"] == 2 and row["indicator"] is None
    spark.createDataFrame([(1, "u", "<p>x</p>")], dims.SCHEMAS["pages"]).write.parquet(str(tmp_path / "p"))
    assert readers.read_pages(spark, str(tmp_path / "p")).first()["html"] == "<p>x</p>"


def test_json_rows_and_fixed_order(spark):
    df = spark.createDataFrame([(1, dt.date(2026, 3, 2), None)], "id long, d date, v double")
    assert json.loads(df.select(values.to_json_row(["id", "d", "v"]).alias("j")).first()["j"]) == {"id": 1, "d": "2026-03-02", "v": None}
    pairs = spark.createDataFrame([("EUR",), ("GBP",), ("USD",)], "p string")
    assert [r["p"] for r in paging.ordered_by_list(pairs, "p", ["USD", "EUR", "GBP"]).collect()] == ["USD", "EUR", "GBP"]


def test_keyed_state_of_headlines(spark, tmp_path):
    """Urls are known from state after restarts and from an earlier table; the order of feeds decides among rows that come
    together; no batch reads what is stored; keys are forgotten once the watermark has passed their timer."""
    from finsignal.plans import streams
    from finsignal.streaming import streams as ST

    schema = dims.SCHEMAS["feed_entries"]
    entry = lambda feed, n, url, text: (feed, n, "u", f"L{feed}", None, text, None, None, url, None, None, "Mon, 02 Mar 2026 07:00:00 GMT", None)
    source, folder = str(tmp_path / "in"), str(tmp_path / "work")
    stored = spark.createDataFrame([("old",)], "url string")
    land = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(source)
    run = lambda: sorted((r["url"], r["source"]) for r in streams.ingest_stream(spark.readStream.schema(schema).parquet(source), folder, stored).collect())
    land(entry(1, 0, "a", "of the que"), entry(0, 3, "a", "of the tion"), entry(0, 1, "old", "of the que"), entry(0, 2, "z", "nothing"))
    assert run() == [("a", "L0")]
    (tmp_path / "work" / "out" / "part-broken.parquet").write_text("no Parquet")  # whoever read the store would fail
    land(entry(0, 0, "a", "of the que"), entry(2, 0, "b", "of the que"), entry(0, 9, "old", "of the que"))
    assert run() == [("a", "L0"), ("b", "L2")]
    assert run() == [("a", "L0"), ("b", "L2")]

    times = str(tmp_path / "times")
    add = lambda *rows: spark.createDataFrame([(k, dt.datetime(2026, 3, d), n) for k, d, n in rows], "k string, t timestamp, n int").coalesce(1).write.mode("append").parquet(times)
    out = []
    for batch in ([("a", 1, 1), ("b", 1, 2)], [("a", 2, 3), ("c", 20, 4)], [("d", 21, 5), ("b", 19, 8)], [("a", 21, 6), ("c", 20, 7)]):
        add(*batch)
        rows = ST.first_of_key_stream(spark.readStream.schema("k string, t timestamp, n int").parquet(times), ["k"], ["n"], "t", 3 * 86_400_000)
        with ST.disk_state(spark):
            query = ST.append_stream(rows, str(tmp_path / "t-out"), str(tmp_path / "t-check")).trigger(availableNow=True).start()
        query.awaitTermination()
        out.append(sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "t-out")).collect()))
    assert out == [[1, 2], [1, 2, 4], [1, 2, 4, 5, 8], [1, 2, 4, 5, 6, 8]]  # c is still known, a and b are not


def test_quotes_are_kept_apart(spark, tmp_path):
    from finsignal.streaming import streams as ST

    schema = "ticker string, name string, volume string, price string, change string, timestamp string"
    spark.createDataFrame([("a", "A", "1", "2.5", "1%", None), ("b", "B", "", "2.5", "1%", None)], schema).write.parquet(str(tmp_path / "in"))
    for query in ST.quotes_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")):
        query.awaitTermination()
    good, bad = spark.read.parquet(str(tmp_path / "out")), spark.read.parquet(str(tmp_path / "out-quarantine"))
    assert [r["ticker"] for r in good.collect()] == ["A"] and "reason" not in good.columns
    assert [(r["ticker"], r["reason"]) for r in bad.collect()] == [("B", "missing_volume")]


def test_streams_start_again(spark, tmp_path):
    """A stream that is started again appends only what is new, and score updates go on from the last version."""
    from finsignal.plans import streams

    source, folder = str(tmp_path / "in"), str(tmp_path / "work")
    schema = "k string, n long"
    read = lambda: spark.readStream.schema(schema).parquet(source)
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], schema).write.parquet(source)
    assert sorted(map(tuple, streams.append_new(read(), folder, ["k"], [F.col("n")]).collect())) == [("a", 1), ("b", 2)]
    spark.createDataFrame([("b", 9), ("c", 4)], schema).write.mode("append").parquet(source)
    assert sorted(map(tuple, streams.append_new(read(), folder, ["k"], [F.col("n")]).collect())) == [("a", 1), ("b", 2), ("c", 4)]

    heads, work = str(tmp_path / "heads"), str(tmp_path / "scores")
    schema = "id long, headline string, description string, content string, sentiment_score double"
    rows = lambda *ids: spark.createDataFrame([(i, "the cat and the dog", None, None, None) for i in ids], schema)
    rows(1, 2, 3).select("id", "sentiment_score").write.parquet(f"{work}/out/version=0")
    read = lambda: spark.readStream.schema(schema).parquet(heads)
    for ids, want in (((1,), {1: 1.0, 2: None, 3: None}), ((3,), {1: 1.0, 2: None, 3: 1.0})):
        rows(*ids).write.mode("append").parquet(heads)
        assert {r["id"]: r["sentiment_score"] for r in streams.update_versions(read(), work).collect()} == want


def test_null_keys_are_inserted(spark):
    """Rows without a key match nothing: all are inserted, and counters agree; one key may hold most rows."""
    rows = [("a", 1, "x"), ("a", 0, "y"), (None, 2, "x"), (None, 3, None), ("old", 4, "x"), ("b", 5, None)] + [("hot", 10 + i, "x" if i % 2 else "y") for i in range(500)]
    batch, existing = spark.createDataFrame(rows, "k string, o int, s string"), spark.createDataFrame([("old",), (None,)], "k string")
    assert sorted(r["o"] for r in upsert.new_rows(batch, existing, ["k"], [F.col("o")]).collect()) == [0, 2, 3, 5, 10]
    counts = {r["s"]: (r["fetched"], r["saved"], r["duplicates"]) for r in upsert.new_row_counts(batch, existing, ["k"], ["s"], [F.col("o")]).collect()}
    assert counts == {"x": (253, 1, 252), "y": (251, 2, 249), None: (2, 2, 0)}


def test_anchors_of_any_quoting(spark):
    html = """<a class="x" href='/one'>One</a><A HREF=/two title="t">Two <b>b</b></A><a href="/three">3</a><a data-href="/no">none</a><abbr href="/no2">x</abbr><a href = "/it's">4</a>"""
    got = policy.page_links(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("link_no").collect()
    assert [(r["link_no"], r["url"], r["title"]) for r in got] == [(0, "/one", "One"), (1, "/two", "Two b"), (2, "/three", "3"), (3, "/it's", "4")]


def test_repeated_months_do_not_multiply(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), 1.0), (dt.date(2026, 1, 1), 3.0), (dt.date(2026, 2, 1), 5.0), (dt.date(2026, 2, 1), None), (None, 1.0)], "period date, v double")
    got = sorted(str((r["period"], r["v"], r["t"])) for r in macro.previous_period(df, "period", "v", "t").collect())
    assert got == sorted(map(str, [(dt.date(2026, 1, 1), 1.0, None), (dt.date(2026, 1, 1), 3.0, None), (dt.date(2026, 2, 1), 5.0, 2.0), (dt.date(2026, 2, 1), None, None), (None, 1.0, None)]))


def test_lexicon_words_are_literal(spark):
    scorer = sentiment.lexicon_scorer(["c.t", "up"], ["a|b"])
    out = scorer(spark.createDataFrame([("cat cut c.t a|b a b up",)], "t string"), "t").first()
    assert (out["label"], round(out["confidence"], 6)) == ("positive", round(1 / 3, 6))


def test_scores_are_made_once_a_row(spark):
    """A filter on what a backfill gave repeats no part of it: one Arrow step, and one search for each word list."""
    df = spark.createDataFrame([(1, "growth &amp; war", None, None, None)], "id int, headline string, description string, content string, sentiment_score double")
    done = sentiment.backfill(df, sentiment.lexicon_scorer(["growth"], ["war"])).where("outcome = 'updated'").select("id", "sentiment_score")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("regexp_extract_all") == 2


def test_texts_reach_python_by_need_and_slice(spark):
    """Only texts with an ampersand are decoded and only others than ASCII composed; a slice of a batch is held at a time."""
    import pyarrow as pa

    from finsignal.functions import text as T

    held = []
    out = T._by_slices(pa.array(["a", None] * 1000), lambda t: held.append(t) or t + "!")
    assert out.to_pylist() == ["a!", None] * 1000 and len(held) == 1000
    rows = spark.createDataFrame([("a &amp; b",), ("plain",), ("ﬁn é",), (None,), ("",)], "t string")
    got = rows.select(T.decode_entities(F.col("t")).alias("d"), T.nfkc(F.col("t")).alias("n"))
    assert [tuple(r) for r in got.collect()] == [("a & b", "a &amp; b"), ("plain", "plain"), ("ﬁn é", "fin é"), (None, None), ("", "")]
    assert "WHEN Contains(t" in got._jdf.queryExecution().optimizedPlan().toString()


def test_texts_that_normalisation_leaves_stay_in_the_jvm(spark, monkeypatch):
    """Accents, signs and an ampersand without an entity send no text to Python; what may change goes there, and all come out
    as the standard library has them."""
    import html
    import re
    import unicodedata

    from finsignal.functions import text as T

    plain = lambda t: re.sub(r"\s+", " ", re.sub("[\u200b\u200c\u200d\ufeff]", "", unicodedata.normalize("NFKC", re.sub("<[^>]+>", " ", html.unescape(t))).replace("\xa0", " "))).strip()
    cleaned = lambda texts: [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.clean_for_scoring(F.col("t")).alias("c")).collect()]
    left = ["Größe & señor, forêt", "«Œuvre» – “Ça”", "Ελλάδα, Москва, €5", "R & D & 5&6 &; &", "<p>für\n alle</p>", "東京と서울", "&é; &#; &#-1;"]
    changed = ["e\u0301", "e&#769;", "&lt;b&gt;x", "AT&T &ampx &notit; &#x41 &#65", "Å ﬁ ½ …", "가\u11a8", "か\u3099", "a\xa0b", "😀 é", "q\u0307\u0323", "&#0; &#xD800;", "ｗｉｄｅ"]
    assert cleaned(left + changed) == [plain(t) for t in left + changed]

    @F.arrow_udf("string")
    def refused(texts):
        if texts.null_count < len(texts):
            raise ValueError("a text came to Python")
        return texts

    monkeypatch.setattr(T, "_decoded_bare", refused)
    assert cleaned(left) == [plain(t) for t in left]


def test_composed_characters():
    """By Unicode's quick check: NFKC changes none of these, none has a combining class, none may join the one before it."""
    import re
    import sys
    import unicodedata

    from finsignal.functions import text as T

    parts = [unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1)]
    joins = {int(p[1], 16) for p in parts if len(p) == 2 and not p[0].startswith("<")} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    held = [c for c in range(sys.maxunicode + 1) if re.match(f"[{T.COMPOSED}]", chr(c))]
    assert len(held) > 30_000 and set(range(128)) <= set(held)
    assert not [c for c in held if c in joins or unicodedata.combining(chr(c)) or unicodedata.category(chr(c)) in ("Cn", "Cs") or not unicodedata.is_normalized("NFKC", chr(c))]


def test_counters_match_texts_once(spark, sf_dir):
    """The counters read what was written of each entry; no text is cleaned or matched again for them."""
    from finsignal.plans import news

    plan = news.ingest_headlines(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 0 and plan.count("impact_score") > 0
    few, many = (keywords._one_of([f"w{i}" for i in range(n)]) for n in (3, 100))
    assert few != keywords.WORD and many == keywords.WORD
