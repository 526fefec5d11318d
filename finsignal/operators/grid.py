"""Tables found in reports: rows to months and values, table choice, currencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import count_of, strip
from ..functions.values import MONTHS, NUMBER
from .paging import first_per_key
from .pieces import carry_last


@dataclass(frozen=True)
class GridConfig:
    """How one indicator's table is read: least tokens of a month row, the value's place (0-based, -1: last)."""

    least: int
    positions: dict[str, int]
    drop_commas: bool = False
    skip: tuple[str, ...] = ("source", "note", "provisional", "revised")


GRIDS = {
    "cbr": GridConfig(5, {"cbr": 4}),
    "inflation": GridConfig(2, {"kenya_inflation": -1}),
    "fuel": GridConfig(6, {"diesel_price": 2}, True),
    "exchange": GridConfig(4, {"usd": 1, "pound_sterling": 2, "euro": 3}, True),
}


def tokens(cells: Column, drop_commas: bool = False) -> Column:
    """Cells without blanks and 'None'; asterisks (and commas) out."""
    marks = "[*,]" if drop_commas else "[*]"
    some = F.filter(cells, lambda c: c.isNotNull() & ~strip(c).isin("", "None"))
    return F.filter(F.transform(some, lambda c: strip(F.regexp_replace(c, marks, ""))), lambda c: c != "")


def carry_year(df: DataFrame, table_keys: list[str], row: str, token: Column, pieces: int | None = None) -> DataFrame:
    """The year of the last header row ('20xx') above each row of a table; null before the first. With `pieces`, tables are
    cut into that many ranges of rows, so one table may hold any share of the rows."""
    year = F.when(token.rlike(r"^20\d{2}$"), token)
    if pieces:
        return carry_last(df.withColumn("_fs_year", year), table_keys, [row], "_fs_year", "year", pieces).drop("_fs_year")
    w = Window.partitionBy(*table_keys).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("year", F.last(year, ignorenulls=True).over(w))


def parse_grid(df: DataFrame, table_keys: list[str], config: GridConfig) -> DataFrame:
    """(table keys, row_idx, month, year, values): month rows with enough tokens and numbers where values belong."""
    with_tokens = df.withColumn("_t", tokens(F.col("cells"), config.drop_commas)).where(F.size("_t") > 0)
    flat = F.lower(F.array_join("_t", " "))
    kept = with_tokens
    for phrase in config.skip:
        kept = kept.where(~flat.contains(phrase))
    dated = carry_year(kept, table_keys, "row_idx", F.col("_t")[0])
    name = F.regexp_replace(F.col("_t")[0], "^:+|:+$", "")
    month = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 100)))
    months = dated.withColumn("month", month).where(F.col("month").isin(*MONTHS) & (F.size("_t") >= config.least))
    values = {}
    for field, at in config.positions.items():
        raw = F.try_element_at("_t", F.lit(at + 1 if at >= 0 else at))
        values[field] = F.when(raw.rlike(NUMBER), raw.try_cast("double"))
    out = months.withColumns(values).dropna(subset=list(values))
    return out.select(*table_keys, "row_idx", "month", "year", *values)


def table_score(df: DataFrame, table_keys: list[str], weights: dict[str, int]) -> DataFrame:
    """Weighted keyword count of each table over the text of all its cells, row by row."""
    text = F.lower(F.concat_ws(" ", "cells"))
    score = sum((count_of(text, k) * w for k, w in weights.items()), F.lit(0))
    return df.groupBy(*table_keys).agg(F.sum(score).cast("long").alias("score"))


def best_candidate(df: DataFrame, keys: list[str], score: str, tie: list[str]) -> DataFrame:
    """Highest score of each key; ties keep the first."""
    return first_per_key(df, keys, [F.desc(score), *map(F.col, tie)])


def parse_toc(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, title, page) of 'Table n: title .... page' lines."""
    # Fixed value: the form of a contents line.
    pattern = r"(?i)^\s*Table\s+\d+[a-zA-Z]?(?:\([a-zA-Z]\))?\s*[:.\-]?\s*(.+?)\s*[.\s]{2,}\s*(\d+)\s*$"
    found = lines.where(F.lower("line").startswith("table") & F.col("line").rlike(pattern))
    return found.select("doc_id", "line_no", F.regexp_replace(F.regexp_extract("line", pattern, 1), r"^[ .]+|[ .]+$", "").alias("title"), F.regexp_extract("line", pattern, 2).cast("int").alias("page"))


def candidate_pages(entries: DataFrame, pages: DataFrame, offset: int = 0, back: int = 1, ahead: int = 3) -> DataFrame:
    """Pages around each entry's page plus the offset, clamped to the document: (doc_id, title, page)."""
    last = pages.groupBy("doc_id").agg(F.max("page").alias("_last"))
    at = F.col("page") + offset
    span = F.sequence(F.greatest(at - back, F.lit(0)), F.least(at + ahead, F.col("_last")))
    return entries.join(last, "doc_id").where(F.greatest(at - back, F.lit(0)) <= F.least(at + ahead, F.col("_last"))).select("doc_id", "title", F.explode(span).alias("page"))


def could_reach(x: str, y: str, cutoff: float) -> bool:
    """Can the shorter text x reach the cutoff inside y? A match of m characters scores at most 2m / (len(x) + m), and m is
    at most the number of characters they share."""
    shared = (Counter(x) & Counter(y)).total()
    return 200.0 * shared >= cutoff * (len(x) + shared)


def ratio_within(a: str, b: str, cutoff: float) -> float:
    """0..100: best match of the shorter text inside the longer; 0 where the cutoff is out of reach."""
    x, y = sorted((a, b), key=len)
    if not x or not could_reach(x, y, cutoff):
        return 0.0
    blocks = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
    return max(100.0 * SequenceMatcher(None, x, y[max(0, m.b - m.a) : max(0, m.b - m.a) + len(x)], autojunk=False).ratio() for m in blocks)


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series, cutoff: pd.Series) -> pd.Series:
    """The same for columns, without case; null: 0."""
    return pd.Series([0.0 if x is None or y is None else ratio_within(x.lower(), y.lower(), least) for x, y, least in zip(a, b, cutoff)])


#: Grams of targets and titles; how many of a target's rarest grams are looked up; how many titles each gives to score.
GRAM, RARE_GRAMS, FIRST_TITLES = 3, 3, 4
BUCKETS, PAIR_BUCKETS = 64, 256  # of characters and of pairs of them, in the bounds that tell which titles need no scoring
BLOCK_CELLS = 1 << 23


def _grams(text: Column) -> Column:
    """Distinct runs of GRAM characters of a lower-case text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def likely_titles(distinct: DataFrame, title: str, wanted: DataFrame, cutoff: float) -> DataFrame:
    """(target, similarity): the best of a few titles that share most of a target's rarest grams. An inverted index of the
    titles, of the targets' grams only; what it gives is a lower bound, from which the full search starts."""
    asked = wanted.select("target", F.explode(_grams(F.lower("target"))).alias("gram"))
    index = distinct.select(title, F.explode(_grams(F.lower(title))).alias("gram")).join(F.broadcast(asked.select("gram").distinct()), "gram", "left_semi")  # grams of the given list
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "gram").withColumn("_rn", F.row_number().over(Window.partitionBy("target").orderBy("n", "gram"))).where(F.col("_rn") <= RARE_GRAMS)
    shared = index.join(F.broadcast(rarest.select("target", "gram")), "gram").groupBy("target", title).agg(F.count(F.lit(1)).alias("n"))  # RARE_GRAMS a target
    first = shared.withColumn("_rn", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("n"), title))).where(F.col("_rn") <= FIRST_TITLES)
    return first.withColumn("similarity", partial_ratio("target", title, F.lit(float(cutoff)))).groupBy("target").agg(F.max("similarity").alias("similarity"))


def _histograms(texts: list[str], run: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket of characters (run = 1) or pairs of neighbours (run = 2) occurs in each text."""
    out = np.zeros((len(texts), buckets), dtype=np.int16)
    for row, t in zip(out, texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = codes if run == 1 else codes[:-1] * np.uint32(31) + codes[1:]
        row[:] = np.minimum(np.bincount(codes & (buckets - 1), minlength=buckets), 32767)
    return out


def pairs_needed(score: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fewest pairs of neighbouring characters that a text of `size` shares with its best window at a similarity of `score`.

    With m of t characters matched twice (score = 200 m / t), blocks of matches are parted by unmatched characters, so there
    are at most t - 2 m + 1 blocks, and m characters in so many blocks hold m minus their number of pairs. t is least where
    the window is matched whole: t = 200 size / (200 - score)."""
    least = 200.0 * size / (200.0 - score)
    return np.where(score * 1.5 > 100.0, least * (score * 0.015 - 1.0) - 1.0, 0.0)


def _best_titles(targets: list[str], bounds: list[float]):
    """Best title of each target in a task. A title is scored only if the characters it shares with a target allow the best
    similarity so far; that is tested for whole blocks of titles and targets at once."""
    low = [t.lower() for t in targets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.array(bounds, dtype=float)
        found: list[tuple[float, int, str] | None] = [None] * len(targets)
        own, own_size = _histograms(low), np.fromiter(map(len, low), dtype=np.int64, count=len(low))
        own_pairs = _histograms(low, 2, PAIR_BUCKETS)
        step = max(1, BLOCK_CELLS // (BUCKETS * max(1, len(low))))
        for batch in batches:
            titles, ties = batch.column("title").to_pylist(), batch.column("tie").to_pylist()
            for at in range(0, len(titles), step):
                part = [t.lower() for t in titles[at : at + step]]
                size = np.minimum(np.fromiter(map(len, part), dtype=np.int64, count=len(part))[:, None], own_size)
                shared = np.minimum(_histograms(part)[:, None, :], own).sum(axis=2, dtype=np.int64)
                reach = 200.0 * shared / np.maximum(size + shared, 1)
                rows, columns = np.nonzero((reach >= best - 1e-9) & (size > 0))
                pairs, kept = _histograms(part, 2, PAIR_BUCKETS), []
                for first in range(0, len(rows), BLOCK_CELLS // PAIR_BUCKETS):
                    r, c = rows[first : first + BLOCK_CELLS // PAIR_BUCKETS], columns[first : first + BLOCK_CELLS // PAIR_BUCKETS]
                    kept.append(np.minimum(pairs[r], own_pairs[c]).sum(axis=1, dtype=np.int64) >= pairs_needed(best[c], size[r, c]) - 1e-9)
                enough = np.concatenate(kept) if kept else np.zeros(0, dtype=bool)
                rows, columns = rows[enough], columns[enough]
                order = np.argsort(-reach[rows, columns], kind="stable")
                for i, k in zip(rows[order].tolist(), columns[order].tolist()):
                    if reach[i, k] < best[k] - 1e-9:
                        continue
                    score = ratio_within(low[k], part[i], best[k])
                    mine = (score, -ties[at + i], titles[at + i])
                    if score >= best[k] and (found[k] is None or mine[:2] > found[k][:2]):
                        found[k], best[k] = mine, score
        kept = [(t, f[2], f[0], -f[1]) for t, f in zip(targets, found) if f]
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in kept], kind) for n, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.int64()))], ["target", "title", "similarity", "tie"])

    return run


def fuzzy_match(titles: DataFrame, title: str, tie: str, targets: list[str], cutoff: float = 50.0) -> DataFrame:
    """(target, title, similarity): the best title for each target of a given list, if it reaches the cutoff; ties keep the
    first by `tie` (a whole number). Null titles are none; repeated targets count once.

    First an index of grams finds a few likely titles a target, whose scores bound what is worth a look. Then each task goes
    through its distinct titles once and scores those that could reach the bound; it gives a row a target. No frame holds
    titles x targets rows, and none is left out: a skipped title cannot reach the best one.
    """
    spark, targets = titles.sparkSession, list(dict.fromkeys(t for t in targets if t is not None))
    if not targets:
        return spark.createDataFrame([], "target string, title string, similarity double")
    wanted = spark.createDataFrame([(t,) for t in targets], "target string")
    distinct = titles.where(F.col(title).isNotNull()).groupBy(title).agg(F.min(tie).cast("long").alias("_tie"))
    known = {r["target"]: r["similarity"] for r in likely_titles(distinct, title, wanted, cutoff).collect()}  # a row a target
    bounds = [max(float(cutoff), known.get(t, 0.0)) for t in targets]
    found = distinct.select(F.col(title).alias("title"), F.col("_tie").alias("tie")).mapInArrow(_best_titles(targets, bounds), "target string, title string, similarity double, tie long")
    best = found.groupBy("target").agg(F.max_by(F.struct("title", "similarity"), F.struct("similarity", -F.col("tie"))).alias("_b"))
    return best.select("target", "_b.*")


def select_table(lines: DataFrame, tables: DataFrame, targets: list[str], weights: dict[str, int], offset: int = 0, least: dict[str, int] | None = None) -> DataFrame:
    """The table each target is read from, by document: the contents entry most like the target, the pages around it,
    the weighted keyword score of their tables, the best one (the first on ties).

    lines: doc_id, line_no, line. tables: doc_id, page, table_idx, row_idx, cells. least: terms of which that many must
    occur in a table, as {term: 1, ...} with the number under ''.
    """
    entries = parse_toc(lines)
    matched = fuzzy_match(entries.withColumnRenamed("line_no", "_tie"), "title", "_tie", targets)
    wanted = entries.join(F.broadcast(matched.select("target", "title")), "title").select("doc_id", "target", "title", "page")  # a row a target
    around = candidate_pages(wanted.withColumn("title", F.col("target")), tables.select("doc_id", "page"), offset)
    keys = ["doc_id", "page", "table_idx"]
    scored = table_score(tables, keys, weights)
    if least:
        terms = [t for t in least if t]
        found = tables.groupBy(*keys).agg(*[F.max(F.lower(F.concat_ws(" ", "cells")).contains(t).cast("int")).alias(f"_h{i}") for i, t in enumerate(terms)])
        enough = sum((F.col(f"_h{i}") for i in range(len(terms))), F.lit(0)) >= least.get("", len(terms))
        scored = scored.join(found.where(enough).select(*keys), keys, "left_semi")
    return best_candidate(scored.join(around, ["doc_id", "page"]), ["doc_id", "title"], "score", ["page", "table_idx"]).withColumnRenamed("title", "target")


def alias_match(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Currency code of a name: an exact alias first, else the first alias contained in it. aliases: a fixed short list."""
    key = F.upper(strip(F.col(name)))
    names = df.select(key.alias("_name")).where("_name <> ''").distinct()
    hits = names.join(F.broadcast(aliases), F.col("_name").contains(F.col("alias")))
    best = hits.groupBy("_name").agg(F.min(F.struct((F.col("_name") != F.col("alias")).alias("inexact"), "ord", "code", "pair")).alias("_b")).select("_name", "_b.code", "_b.pair")
    return df.withColumn("_name", key).join(best, "_name").drop("_name")


def parse_forex(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exchange rows of grids: first cell is a currency, last a rate; the first row of a pair counts."""
    t = tokens(F.col("cells"), True)
    rows = df.select("source_url", "table_idx", "row_idx", F.try_element_at(t, F.lit(1)).alias("currency"), F.try_element_at(t, F.lit(-1)).alias("_rate"))
    rows = rows.where(F.col("_rate").rlike(NUMBER)).withColumn("rate", F.col("_rate").cast("double")).drop("_rate")
    return first_per_key(alias_match(rows, "currency", aliases), ["source_url", "pair"], [F.col("table_idx"), F.col("row_idx")])
