"""Corpus pipeline: toxicity, near-duplicates, personal data, mixture, token ids. Each stage works on all rows that the
one before it kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finsignal.llm import mixing, pii, simhash, spiece, toxicity
from finsignal.llm.scratch import write_table

#: The mixture of the pipeline: sources and topics tempered, languages as they come.
TARGETS = mixing.Targets(exponents={"source": 0.7, "topic": 1.0, "lang": 1.0}, weights={})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span model, trained on the labels, does not reject; all columns as they come.

    Null and empty texts are judged as texts without toxic words and stay; repeated rows are judged each; a very long text
    by its largest marginals, like any other; an empty table, or labels without both classes, drop nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; all columns as they come.

    Texts without words (null, empty) are near nothing and stay; of rows that repeat a doc_id one stays; rows without
    doc_id stay; an empty table gives no rows."""
    return simhash.keep_first(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; other columns as they come.

    A null text stays null, an empty one empty; repeated rows are masked each; texts of any length are masked whole; an
    empty table gives no rows."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected token shares meet the targets; all columns as they come.

    Null sources and languages are a value of their own; texts without tokens are always kept; rows that repeat a doc_id
    are drawn alike; an empty table gives no rows."""
    return mixing.keep_mixed(docs, TARGETS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact: a row for each row. Null and empty texts have no ids; repeated rows are encoded each; an
    empty table gives no rows."""
    return spiece.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", mask_private),
    ("mixture", mix_sources),
    ("token_ids", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's output is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models, connected components and Viterbi paths: no SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL}
