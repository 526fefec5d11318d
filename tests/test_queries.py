"""Every query with SQL gives DuckDB's rows on the same tables; every other query gives what plain Python gives."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from finsignal.plans import catalog

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_against_python(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0 and name in PLAIN
    PLAIN[name](spark, sf_dir, df.collect())


def plain_entities(spark, sf_dir, got):
    """Entities, tags and compatibility forms by the standard library."""
    import html
    import re
    import unicodedata

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        bare = unicodedata.normalize("NFKC", re.sub("<[^>]+>", " ", html.unescape(r["html"])))
        want = re.sub(r"\s+", " ", re.sub("[\u200b\u200c\u200d\ufeff]", "", bare)).strip()
        assert {"page_id": r["page_id"], "n_chars": len(want)} in [x.asDict() for x in got if x["page_id"] == r["page_id"]]


def best_titles(names, targets, cutoff=50.0):
    """(target, title, similarity) by every window of every name, without any pruning."""
    from difflib import SequenceMatcher

    def similar(a, b):
        x, y = sorted((a.lower(), b.lower()), key=len)
        blocks = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
        return max((100.0 * SequenceMatcher(None, x, y[max(0, m.b - m.a) : max(0, m.b - m.a) + len(x)], autojunk=False).ratio() for m in blocks), default=0.0)

    out = {}
    for t in targets:
        found = max(((similar(t, n), -place, n) for n, place in names.items()), default=(0.0, 0, ""))
        if found[0] >= cutoff:
            out[t] = (found[2], found[0])
    return out


def plain_fuzzy_title(spark, sf_dir, got):
    names = {}
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect():
        names[r["p_name"]] = min(names.get(r["p_name"], 1 << 60), r["p_partkey"])
    from finsignal.plans.reports import TITLES

    assert {r["target"]: (r["title"], r["similarity"]) for r in got} == best_titles(names, TITLES)


def plain_fuzzy_names(spark, sf_dir, got):
    names, asked = {}, set()
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect():
        names[r["p_name"]] = min(names.get(r["p_name"], 1 << 60), r["p_partkey"])
        if r["p_partkey"] % 50 == 0:
            turned = " ".join(reversed(r["p_name"].split(" ")))
            asked.add(turned[:2] + turned[3:])
    assert {r["target"]: (r["title"], r["similarity"]) for r in got} == best_titles(names, sorted(asked), 60.0)


def plain_table_choice(spark, sf_dir, got):
    """Title, pages around it, and the best of two tables a page, by hand."""
    from finsignal.plans.reports import TITLES

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    names, last = {}, {}
    for r in parts:
        names[r["p_name"]] = min(names.get(r["p_name"], 1 << 60), r["p_partkey"])
        doc = f"d{r['p_partkey'] % 50}"
        last[doc] = max(last.get(doc, 0), (r["p_partkey"] - 1) // 50 + 1)
    want = {}
    for target, (title, _) in best_titles(names, TITLES).items():
        for r in parts:
            if r["p_name"] == title:
                doc, at = f"d{r['p_partkey'] % 50}", r["p_size"] + 1
                for page in range(max(at - 1, 1), min(at + 3, last[doc]) + 1):
                    for t in (0, 1):
                        option = (-(2 * ((page * 7 + t * 3) % 5) + 1), page, t)
                        want[doc, target] = min(want.get((doc, target), option), option)
    assert {(r["doc_id"], r["target"]): (-r["score"], r["page"], r["table_idx"]) for r in got} == want


#: Queries that SQL cannot express, against plain Python.
PLAIN = {"entities": plain_entities, "fuzzy_title": plain_fuzzy_title, "fuzzy_names": plain_fuzzy_names, "table_choice": plain_table_choice}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_toc_pages_reach_the_last_page(spark, sf_dir):
    """Every contents entry against the pages of its whole document, counted by hand."""
    from finsignal.plans import reports

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    last, want = {}, {}
    for r in parts:
        doc = f"d{r['p_partkey'] % 50}"
        last[doc] = last.get(doc, 0) + 1
    for r in parts:
        doc, at = f"d{r['p_partkey'] % 50}", r["p_size"] + 1
        pages = range(max(at - 1, 0), min(at + 3, last[doc]) + 1)
        if len(pages):
            want.setdefault((doc, r["p_name"]), []).extend(pages)
    got = {(r["doc_id"], r["title"]): (r["n"], r["first_page"], r["last_page"]) for r in reports.toc_pages(spark, sf_dir).collect()}
    assert got == {k: (len(v), min(v), max(v)) for k, v in want.items()}
