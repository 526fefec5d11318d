"""Keyword, category and impact enrichment."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import compute_once
from ..functions.text import clean_or_null, count_of
from ..sources.dims import Dictionary
from ..storage import write_table


WORD = r"(?U)\w+"  # a run of letters, digits and underscores of any script


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in word)


#: Up to so many words are looked for by one pattern; of more, all words of a text are taken.
FEW_WORDS = 64


def _one_of(words: list[str]) -> str:
    """A pattern of the words that stand alone in a text, or of any word where they are many. First characters are tried before
    boundaries, which cost more."""
    if len(words) > FEW_WORDS:
        return WORD
    first = "".join(sorted({w[0] for w in words}))
    return rf"(?U)(?=[{first}])(?<!\w)(?:{'|'.join(words)})(?!\w)"


def _found(low: Column, d: Dictionary) -> Column:
    """Keywords of a lower-case text: one list of its words against all single words, phrases as substrings."""
    words = [k for k in d.distinct() if re.fullmatch(r"\w+", k)]
    phrases = [k for k in d.distinct() if " " in k]
    marked = [k for k in d.distinct() if k not in words and k not in phrases]  # such as at&t: words by boundaries, but more than one
    literal = lambda terms: F.array(*map(F.lit, terms)).cast("array<string>")
    parts = [F.array_intersect(literal(words), F.regexp_extract_all(low, F.lit(_one_of(words)), F.lit(0)))] if words else []
    parts += [F.filter(literal(phrases), lambda p: low.contains(p))] if phrases else []
    parts += [F.array_compact(F.array(*[F.when(low.contains(k) & low.rlike(rf"(?U)\b{_quoted(k)}\b"), F.lit(k)) for k in marked]))] if marked else []
    return F.array_sort(F.concat(*parts)) if parts else literal([])


def extract_keywords(text: Column, d: Dictionary = Dictionary()) -> Column:
    """Sorted distinct keywords of a text: single words on word boundaries, phrases as substrings, without case. The text
    is lower-cased once if it comes through compute_once (as in enrich), else once for each kind of keyword."""
    return _found(F.lower(F.coalesce(text, F.lit(""))), d)


def extract_categories(keywords: Column, d: Dictionary = Dictionary()) -> Column:
    """Sorted categories with at least one of the keywords."""
    hits = [F.when(F.arrays_overlap(keywords, F.array(*map(F.lit, words))), F.lit(c)) for c, words in sorted(d.keywords.items())]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def impact_score(keywords: Column, d: Dictionary = Dictionary()) -> Column:
    """Sum of weights; keywords without a weight count the default."""
    if not d.weights:
        return (F.size(keywords) * d.default_weight).cast("int")
    table = F.create_map(*[F.lit(x) for pair in d.weights.items() for x in pair])
    return F.aggregate(keywords, F.lit(0), lambda total, k: total + F.coalesce(F.try_element_at(table, k), F.lit(d.default_weight)))


def enrich(df: DataFrame, text: Column, d: Dictionary = Dictionary()) -> DataFrame:
    """Adds keywords, categories, matched_keywords_count and impact_score; other columns stay. A text is lower-cased once,
    split into words once, and matched once, whatever the size of the dictionary and however often keywords are used."""
    low = compute_once(df, {"_fs_low": F.lower(F.coalesce(text, F.lit("")))})
    found = compute_once(low, {"keywords": _found(F.col("_fs_low"), d)}).drop("_fs_low")
    return found.withColumns({"categories": extract_categories(F.col("keywords"), d), "matched_keywords_count": F.size("keywords"), "impact_score": impact_score(F.col("keywords"), d)})


def match_large_dictionary(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(key, category, keyword) for a dictionary of single ASCII words: distinct words of each text joined to it by
    equality. match_terms is the general form."""
    tokens = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1)))).alias("keyword"))
    return tokens.join(words, "keyword").select(key, "category", "keyword")


#: Of a phrase, so many characters before and after its first space are looked up in texts: the first pair that it has.
SEAMS = ((2, 5), (2, 2), (1, 1), (0, 0))
#: With each space of a text, what follows is held up to so many spaces at most, more than a seam has characters after it. A
#: phrase of more spaces is looked for in the whole text, once its seam was met.
SPACES = 6
#: Dictionaries of up to so many bytes are broadcast; the pieces of texts meet larger ones as Spark decides.
BROADCAST = 32 << 20
WHOLE_WORD, PHRASE, LONG, MARKED, NONE = range(5)


def _seam_key(before: Column, since: Column, seam: tuple[int, int]) -> Column:
    """A number for so many last characters of what stands before a space and first ones of what follows; since begins with it."""
    a, b = seam
    return F.xxhash64(F.substring(before, -a, a), F.substring(since, 2, b))


def _terms(words: DataFrame) -> DataFrame:
    """(term, category, keyword, kind, key, seam, spaces), written once. The key stands for what a text must hold for a term to
    be possible: a word itself; of a term with marks its longest run of letters, which stands as a word in the text; of a
    phrase the characters around its first space."""
    k, runs, at, seam = F.col("keyword"), F.col("_fs_runs"), F.col("_fs_at"), F.col("seam")
    found = compute_once(words.select("category", "keyword").where(k.isNotNull()).distinct(), {"_fs_runs": F.regexp_extract_all(k, F.lit(WORD), F.lit(0)), "_fs_at": F.instr(k, " ")})
    longest = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-F.char_length(r)).alias("n"), r.alias("r")))), 0)["r"]
    spaces = count_of(k, " ")
    kind = F.when(spaces > SPACES, LONG).when(at > 0, PHRASE).when(F.size(runs) == 0, NONE).when(runs[0] == k, WHOLE_WORD).otherwise(MARKED)
    has = [(at > a) & (F.char_length(k) - at >= b) for a, b in SEAMS]
    held = compute_once(found, {"kind": kind, "seam": F.when(at > 0, F.coalesce(*[F.when(c, i) for i, c in enumerate(has)])), "spaces": spaces})
    before, since = F.substring_index(k, " ", 1), F.substring(k, at, F.char_length(k))
    key = F.coalesce(*[F.when(seam == i, _seam_key(before, since, s)) for i, s in enumerate(SEAMS)], F.xxhash64(longest))
    return write_table(held.select(F.monotonically_increasing_id().alias("term"), "category", "keyword", "kind", key.alias("key"), "seam", "spaces"), "terms")


def match_terms(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(key, category, keyword), each once, for dictionaries of any size (words: category, keyword): what extract_keywords
    finds, by equality joins.

    A text is dealt out by its key, and what is found in it stays in that task. It becomes its words and its spaces, each with
    what stands around it; these meet the terms by a join, broadcast or shuffled by the dictionary's size. Words and phrases
    are compared with what met them, so no text is searched for them; terms with marks and phrases of many spaces are then
    looked for in the texts that hold their key. A null key is none; a term without a letter or digit is a ValueError.
    """
    terms = _terms(words)
    kinds = terms.groupBy("kind", "seam").agg(F.max("spaces").alias("spaces"), F.sum(64 + F.octet_length("keyword") + F.coalesce(F.octet_length("category"), F.lit(0))).alias("size")).collect()  # 2 * len(SEAMS) + 3 rows at most
    if any(r["kind"] == NONE for r in kinds):
        raise ValueError("a term has no letter or digit")
    near = F.broadcast if sum(r["size"] for r in kinds) <= BROADCAST else lambda d: d
    seams = [SEAMS[i] for i in sorted({r["seam"] for r in kinds} - {None})]
    follow = min(SPACES, max((r["spaces"] for r in kinds), default=0))
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_fs_key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_fs_low")).repartition("_fs_key")
    low, part, since, keyword, kind = F.col("_fs_low"), F.col("_fs_part"), F.col("_fs_since"), F.col("keyword"), F.col("kind")
    parts = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    if not seams:
        held = compute_once(texts, {"_fs_parts": parts})
        keys = held.select("_fs_key", F.explode("_fs_parts").alias("_fs_part")).withColumn("key", F.xxhash64("_fs_part"))
    else:
        # Cut before each space: pieces that begin with one, then as many empty ones as may follow a piece, then words.
        held = compute_once(texts, {"_fs_parts": F.concat(F.split(low, "(?s)(?= )", -1), F.array_repeat(F.lit(""), follow), parts)})
        cut = F.col("_fs_parts")
        later = [F.slice(cut, 1 + i, F.size(cut)).alias(f"_{i}") for i in range(follow)]
        each = held.select("_fs_key", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), cut).alias("before"), *later)).alias("p")).where("p._0 is not null")
        here, spaced = F.col("p._0"), F.col("p._0").startswith(" ")
        around = each.select("_fs_key", F.col("p.before").alias("_fs_before"), F.when(spaced, F.concat_ws("", *[f"p._{i}" for i in range(follow)])).alias("_fs_since"), here.alias("_fs_part"))
        found = F.when(since.isNull(), F.array(F.xxhash64(part))).otherwise(F.array(*[_seam_key(F.col("_fs_before"), since, s) for s in seams]))
        keys = around.select("_fs_key", F.when(since.isNull(), part).otherwise(F.concat("_fs_before", since)).alias("_fs_part"), F.explode(found).alias("key"))
    sure = F.when(kind == WHOLE_WORD, part == keyword).when(kind == PHRASE, part.contains(keyword)).otherwise(F.lit(True))
    met = keys.join(near(terms.select("key", "term", "kind", "keyword")), "key").where(sure).select("_fs_key", "term").distinct().join(near(terms.select("term", "category", "keyword", "kind")), "term")
    if any(r["kind"] in (LONG, MARKED) for r in kinds):
        bounded = lambda t: F.rlike(low, F.concat(F.lit(r"(?U)\b\Q"), t["keyword"], F.lit(r"\E\b")))
        real = F.filter("terms", lambda t: F.when(t["kind"] == LONG, low.contains(t["keyword"])).when(t["kind"] == MARKED, bounded(t)).otherwise(F.lit(True)))
        by_text = met.groupBy("_fs_key").agg(F.collect_list(F.struct("category", "keyword", "kind")).alias("terms"))
        met = texts.join(by_text, "_fs_key").select("_fs_key", F.explode(real).alias("t")).select("_fs_key", "t.category", "t.keyword").distinct()
    return met.select(F.col("_fs_key").alias(key), "category", "keyword")


def batch_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("matched_keywords_count").cast("long").alias("keyword_total"), F.sum("impact_score").cast("long").alias("impact_total"))


def token_frequency(df: DataFrame, column: str) -> DataFrame:
    """(token, n) over an array column: rows that hold the token."""
    return df.select(F.explode(column).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def distinct_tokens(df: DataFrame, column: str) -> DataFrame:
    """Distinct lower-case tokens of an array column."""
    return df.select(F.explode(column).alias("token")).select(F.lower("token").alias("token")).where("token <> ''").distinct()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed non-empty values."""
    return df.select(clean_or_null(F.col(column)).alias(column)).where(F.col(column).isNotNull()).distinct()
