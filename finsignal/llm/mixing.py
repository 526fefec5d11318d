"""Mixing sources to target weights: rake token weights to source, language and topic marginals, then sample documents.

1. Token counts are added up by cell (source, lang, topic): one pass, partial sums before the shuffle.
2. Iterative proportional fitting scales the cells until each marginal meets its target.
3. A cell's rate is raked tokens / tokens, scaled to the token budget, or so that the highest rate is 1. A document's
   expected number of copies is its cell's rate, so the expected token shares of the sample are the targets, exactly.
4. A document has as many copies as its rate has wholes, and one more if a uniform number drawn from md5(seed, doc_id) is
   below the rest: no state, same answer on every run and any partitioning.

The topic is a column of the caller's, or fitted: anchor words are the TOPICS words with the highest document frequency
among those that stand in at most one document of TOPIC_MOST and at least one of TOPIC_LEAST; a document's topic is the
rarest anchor it holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import write_table

DIMS = ("source", "lang", "topic")
#: Cells that may meet in one task and be broadcast; beyond that cells stay partitioned and joins are shuffled.
SMALL_CELLS = 100_000
TOPICS, TOPIC_MOST, TOPIC_LEAST = 12, 8, 200
ANCHOR = "[a-z]{4,}"
BLOCK, RESIDUAL = 3, 1e-9  # sweeps between two looks at the largest relative distance from a target


@dataclass(frozen=True)
class Targets:
    """For each of source, lang and topic: a tempering exponent (target share ~ share ** exponent) or explicit weights.

    Explicit weights are normalised over the values that occur; a value without weight keeps its own share of tokens as
    its weight, so that no value is dropped. `budget`: tokens the sample is to have; documents are repeated where that
    takes rates above 1. Without it the highest rate is 1.
    """

    exponents: dict[str, float] = field(default_factory=lambda: {"source": 0.5, "topic": 0.7})
    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}})
    sweeps: int = 12
    seed: str = "mix-1"
    budget: float | None = None


def token_count(text: Column) -> Column:
    """Words of a text: maximal runs without space, tab, line feed, vertical tab, form feed, carriage return."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^ \t\n\x0B\f\r]+", "\u0001"), r"[^\u0001]", "")).cast("long")


def anchor_words(text: Column) -> Column:
    """The distinct words of a text that may be anchors: four ASCII letters or more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({ANCHOR})"), F.lit(1)))


def fit_topics(documents: DataFrame) -> list[str]:
    """The anchors, the rarest first (ties by alphabet): at most TOPICS words, counted over all whole texts. Empty and null
    texts hold no words; without documents there are no anchors."""
    n = documents.count()
    counts = documents.select(F.explode(anchor_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    middle = counts.where((F.col("n") * TOPIC_LEAST >= n) & (F.col("n") * TOPIC_MOST <= n))
    return [r["word"] for r in sorted(middle.orderBy(F.desc("n"), "word").limit(TOPICS).collect(), key=lambda r: (r["n"], r["word"]))]


def topic_of(text: Column, anchors: list[str]) -> Column:
    """The first of the anchors that a text holds as a word, or '(other)'."""
    if not anchors:
        return F.lit("(other)")
    return F.coalesce(F.try_element_at(F.array_intersect(F.array(*map(F.lit, anchors)), anchor_words(text)), F.lit(1)), F.lit("(other)"))


def _cell(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("(none)"))


def features(documents: DataFrame, topic: Column) -> DataFrame:
    """doc_id, source, lang, topic, tokens. A null source, language or topic is the value '(none)'; null text: no tokens."""
    named = F.coalesce(topic.cast("string"), F.lit("(none)"))
    return documents.select("doc_id", _cell("source").alias("source"), _cell("lang").alias("lang"), named.alias("topic"), token_count(F.col("text")).alias("tokens"))


def _marginal_target(cells: DataFrame, dim: str, targets: Targets, total: float) -> DataFrame:
    """(dim, _t_<dim>): the token sum that each value of `dim` is to have. Only one number comes to the driver."""
    own = F.sum("tokens").cast("double") / F.lit(total)
    values = cells.groupBy(dim).agg(own.alias("_share"))
    if dim in targets.weights:
        given = F.create_map(*[F.lit(x) for pair in targets.weights[dim].items() for x in pair])
        raw = F.coalesce(F.try_element_at(given, F.col(dim)).cast("double"), F.col("_share"))
    else:
        raw = F.pow(F.col("_share"), F.lit(float(targets.exponents.get(dim, 1.0))))
    values = values.select(dim, F.when(F.col("_share") > 0, raw).otherwise(0.0).alias("_raw"))
    whole = values.agg(F.sum("_raw")).first()[0] or 1.0
    return values.select(dim, (F.col("_raw") / F.lit(whole) * F.lit(total)).alias(f"_t_{dim}"))


def rake(cells: DataFrame, targets: Targets = Targets(), small: bool = True) -> DataFrame:
    """Fit cells (source, lang, topic, tokens) to the target marginals; adds weight and rate.

    At most `targets.sweeps` sweeps over the three marginals, in this order; no more once all are met to RESIDUAL. Cells
    without tokens stay at weight 0 and rate 0. `small`: the cells may meet in one task (their number was checked), where
    the sums need no shuffle. Otherwise a marginal's sums are partial aggregates joined back, so a value that holds most
    cells costs no task more than others.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    for dim in DIMS:
        goal = _marginal_target(cells, dim, targets, total)
        cells = cells.join(F.broadcast(goal) if small else goal, dim)
    cells = write_table(cells.withColumn("weight", F.col("tokens").cast("double")), "goals")

    def sums(now: DataFrame, dim: str) -> DataFrame:
        if small:
            return now.withColumn("_now", F.sum("weight").over(Window.partitionBy(dim).orderBy(*DIMS).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        return now.join(now.groupBy(dim).agg(F.sum("weight").alias("_now")), dim)

    for at in range(targets.sweeps):
        if small and at % BLOCK == 0:
            cells = cells.coalesce(1)
        for dim in DIMS:
            cells = sums(cells, dim).withColumn("weight", F.when(F.col("_now") > 0, F.col("weight") * F.col(f"_t_{dim}") / F.col("_now")).otherwise(F.lit(0.0))).drop("_now")
            if not small:
                cells = write_table(cells, "raked")
        if at % BLOCK == BLOCK - 1:
            cells = write_table(cells, "raked") if small else cells
            off = [cells.groupBy(dim).agg(F.sum("weight").alias("w"), F.max(f"_t_{dim}").alias("t")).agg(F.max(F.when(F.col("t") > 0, F.abs(F.col("w") / F.col("t") - 1))).alias("off")) for dim in DIMS]
            if max((r[0] or 0.0) for r in off[0].unionByName(off[1]).unionByName(off[2]).collect()) <= RESIDUAL:
                break
    cells = cells.withColumn("_ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0)))
    top = total / targets.budget if targets.budget else cells.agg(F.max("_ratio")).first()[0] or 1.0
    return cells.select(*DIMS, "tokens", "weight", F.round(F.col("_ratio") / F.lit(top), 12).alias("rate"))


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from md5(seed:key), with 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def calibrate(facts: DataFrame, targets: Targets = Targets()) -> tuple[DataFrame, bool]:
    """Rates by cell from documents' facts, and whether the cells are few enough to broadcast."""
    cells = write_table(facts.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "cells")
    small = cells.count() <= SMALL_CELLS
    return write_table(rake(cells, targets, small), "rates"), small


def with_probability(facts: DataFrame, rates: DataFrame, small: bool) -> DataFrame:
    """Join facts to rates; beyond SMALL_CELLS by a shuffle, whose hot cells adaptive execution splits."""
    table = rates.select(*DIMS, F.col("rate").alias("probability"))
    return facts.join(F.broadcast(table) if small else table, list(DIMS))


def copies(seed: str, key: Column, rate: Column) -> Column:
    """How often a document stands in the sample: the wholes of its rate, and one more with the chance of the rest."""
    return (F.floor(rate) + (uniform(seed, key) < rate - F.floor(rate)).cast("long")).cast("int")


def _topic(documents: DataFrame, topic: Column | None) -> Column:
    return topic_of(F.col("text"), fit_topics(documents)) if topic is None else topic


def mix(documents: DataFrame, targets: Targets = Targets(), topic: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, probability, selected, copies. `topic`: a column of the
    documents; fitted where none is given. `probability` is the expected number of copies.

    A document without words has probability 1 (it weighs nothing, so dropping it serves no target). Repeated rows with
    one doc_id share one draw. An empty table gives no rows; other columns are ignored.
    """
    facts = write_table(features(documents, _topic(documents, topic)), "facts")
    rates, small = calibrate(facts, targets)
    p = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.col("probability"))
    scored = with_probability(facts, rates, small).withColumn("probability", p).withColumn("copies", copies(targets.seed, F.col("doc_id"), F.col("probability")))
    return scored.select("doc_id", *DIMS, "tokens", "probability", (F.col("copies") > 0).alias("selected"), "copies")


def keep_mixed(documents: DataFrame, targets: Targets = Targets(), topic: Column | None = None) -> DataFrame:
    """The sampled documents themselves, all their columns unchanged, each as often as it was drawn. Texts are never
    shuffled. Nulls, documents without words, repeated rows and empty tables count as in mix; columns of any names stay."""
    topic = _topic(documents, topic)
    rates, small = calibrate(write_table(features(documents, topic), "facts"), targets)
    keys = {f"_fs_{c}": e for c, e in (("source", _cell("source")), ("lang", _cell("lang")), ("topic", F.coalesce(topic.cast("string"), F.lit("(none)"))), ("tokens", token_count(F.col("text"))))}
    marked = documents.withColumns(keys)
    table = rates.select(*[F.col(d).alias(f"_fs_{d}") for d in DIMS], F.col("rate").alias("_fs_rate"))
    joined = marked.join(F.broadcast(table) if small else table, [f"_fs_{d}" for d in DIMS])
    times = F.when(F.col("_fs_tokens") == 0, 1).otherwise(copies(targets.seed, F.col("doc_id"), F.col("_fs_rate")))
    kept = joined.withColumn("_fs_times", times).where("_fs_times > 0")
    if targets.budget:
        kept = kept.withColumn("_fs_no", F.explode(F.sequence(F.lit(1), F.col("_fs_times"))))
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])
