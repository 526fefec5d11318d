"""Sentiment scores: pluggable scorer, signed score, bands, run statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import compute_once
from ..functions.text import assemble_text, clean_for_scoring, is_meaningful

#: A scorer adds `label` (positive, negative, neutral) and `confidence` (0..1) to a frame with a text column.
Scorer = Callable[[DataFrame, str], DataFrame]
# Lower bounds of the bands, and the label in between.
BANDS = (("Strong Positive", 0.5), ("Moderate Positive", 0.2))
NEGATIVE_BANDS = (("Strong Negative", -0.5), ("Moderate Negative", -0.2))
NEUTRAL = "Strict Neutral"


def signed_score(label: Column, confidence: Column) -> Column:
    """+confidence, -confidence or 0, clamped to [-1, 1], 4 places."""
    low = F.lower(label)
    raw = F.when(low == "positive", confidence).when(low == "negative", -confidence).otherwise(F.lit(0.0))
    return F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)).cast("decimal(12,8)"), 4).cast("double")


def score_band(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for name, least in BANDS:
        out = out.when(score >= least, name)
    for name, most in NEGATIVE_BANDS:
        out = out.when(score <= most, name)
    return out.otherwise(NEUTRAL)


def lexicon_scorer(positive: list[str], negative: list[str]) -> Scorer:
    """Default scorer in built-ins: share of positive and negative words among their hits."""

    def hits(low: Column, words: list[str]) -> Column:
        first = "".join(sorted({rf"\x{{{ord(w[0]):x}}}" for w in words}))  # tried before the boundary, which costs more
        return F.size(F.regexp_extract_all(low, F.lit(rf"(?U)(?=[{first}])\b(" + "|".join(rf"\Q{w}\E" for w in words) + r")\b"), F.lit(1)))

    def score(df: DataFrame, text: str) -> DataFrame:
        low = compute_once(df, {"_fs_low": F.lower(F.col(text))})
        counted = compute_once(low, {"_p": hits(F.col("_fs_low"), positive), "_n": hits(F.col("_fs_low"), negative)}).drop("_fs_low")
        label = F.when(F.col("_p") > F.col("_n"), "positive").when(F.col("_n") > F.col("_p"), "negative").otherwise("neutral")
        confidence = F.coalesce(F.try_divide(F.abs(F.col("_p") - F.col("_n")).cast("double"), (F.col("_p") + F.col("_n")).cast("double")), F.lit(0.0))
        return counted.withColumns({"label": label, "confidence": confidence}).drop("_p", "_n")

    return score


def model_scorer(load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]) -> Scorer:
    """Adapter for a model: loaded once a task, called on Arrow batches."""

    def score(df: DataFrame, text: str) -> DataFrame:
        import pandas as pd

        def run(batches):
            model = load()
            for pdf in batches:
                found = model(pdf[text].fillna("").tolist())
                yield pdf.assign(label=pd.Series([f[0] for f in found], index=pdf.index, dtype="object"), confidence=pd.Series([float(f[1]) for f in found], index=pdf.index))

        return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", label string, confidence double")

    return score


def score_text(df: DataFrame, text: Column, scorer: Scorer, deep_clean: bool = True) -> DataFrame:
    """Adds score: null where a text is unusable before or after cleaning. A text is assembled, judged, cleaned and scored
    once a row, whatever is made of the score; an unusable one is not cleaned."""
    raw = compute_once(df, {"_fs_text": text})
    usable = compute_once(raw, {"_fs_text": F.when(is_meaningful(F.col("_fs_text")), F.col("_fs_text"))})
    cleaned = F.when(F.col("_fs_text").isNotNull(), clean_for_scoring(F.col("_fs_text")))
    prepared = compute_once(usable.withColumn("_fs_text", cleaned), {"_fs_text": F.col("_fs_text")}) if deep_clean else usable
    scored = scorer(prepared, "_fs_text")
    signed = F.when(is_meaningful(F.col("_fs_text")), signed_score(F.col("label"), F.col("confidence")))
    return compute_once(scored, {"score": signed}).drop("_fs_text", "label", "confidence")


def backfill(headlines: DataFrame, scorer: Scorer, mode: str = "unscored") -> DataFrame:
    """Score stored headlines in one job: mode 'unscored' or 'all'. Adds outcome: updated, skipped or kept. A row whose
    text is unusable is skipped, never retried in a loop."""
    if mode not in ("unscored", "all"):
        raise ValueError("mode is unscored or all")
    todo = F.lit(True) if mode == "all" else F.col("sentiment_score").isNull()
    scored = score_text(headlines.withColumn("_fs_todo", todo), assemble_text(F.col("headline"), F.col("description"), F.col("content")), scorer)
    outcome = F.when(~F.col("_fs_todo"), "kept").when(F.col("score").isNull(), "skipped").otherwise("updated")
    return scored.withColumn("outcome", outcome).withColumn("sentiment_score", F.when(F.col("outcome") == "updated", F.col("score")).otherwise(F.col("sentiment_score"))).drop("score", "_fs_todo")


def preview(headlines: DataFrame, ids: DataFrame, scorer: Scorer) -> DataFrame:
    """Scores and bands of requested rows without writing."""
    wanted = headlines.join(ids.select("id").distinct(), "id", "left_semi")
    scored = score_text(wanted, assemble_text(F.col("headline"), F.col("description"), F.col("content")), scorer)
    return scored.select("id", "score", score_band(F.col("score")).alias("band"), F.col("score").isNotNull().alias("valid"))


def run_statistics(df: DataFrame, score: str = "sentiment_score", outcome: str = "outcome") -> DataFrame:
    """processed, updated, skipped, failed, average_score over updated rows, status."""
    n = {k: F.count_if(F.col(outcome) == k) for k in ("updated", "skipped", "failed")}
    processed = n["updated"] + n["skipped"] + n["failed"]
    mean = F.sum(F.when(F.col(outcome) == "updated", F.col(score)).cast("decimal(28,6)")).cast("double") / F.nullif(n["updated"], F.lit(0))
    status = F.when(processed == 0, "no_data").when(n["failed"] > 0, "completed_with_errors").otherwise("success")
    return df.agg(processed.alias("processed"), *[c.alias(k) for k, c in n.items()], F.coalesce(mean, F.lit(0.0)).alias("average_score"), status.alias("status"))
