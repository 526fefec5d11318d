"""Validation: required fields, quarantine with reasons, envelopes, argument checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip
from .values import MONTHS, NUMBER

ENVELOPE_KEYS = ("table_name", "report_date", "status", "source_url", "data")


def missing(c: Column) -> Column:
    """Null, blank or 'N/A'."""
    return c.isNull() | strip(c.cast("string")).isin("", "N/A")


def required(fields: list[str], numeric: list[str] = ()) -> dict[str, Column]:
    """reason -> failing condition, in order of precedence."""
    rules = {f"missing_{f}": missing(F.col(f)) for f in fields}
    return rules | {f"not_numeric_{f}": ~F.coalesce(F.regexp_replace(F.col(f).cast("string"), r"[,\s%+]", "").rlike(NUMBER), F.lit(False)) for f in numeric}


def quarantine(df: DataFrame, rules: dict[str, Column], reason: str = "reason") -> DataFrame:
    """Adds the first failing rule's name, null for valid rows: one pass, and two views of it by `valid`/`invalid`."""
    chain = reduce(lambda c, item: F.when(F.coalesce(item[1], F.lit(True)), F.lit(item[0])).otherwise(c), reversed(rules.items()), F.lit(None).cast("string"))
    return df.withColumn(reason, chain)


def valid(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNull()).drop(reason)


def invalid(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull())


def quarantine_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """total, saved, skipped."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(reason).isNull()).alias("saved"), F.count_if(F.col(reason).isNotNull()).alias("skipped"))


def envelope_ok(columns: list[str]) -> Column:
    """All envelope keys are there and data is a list; an empty list is fine."""
    if missing_keys := [k for k in ENVELOPE_KEYS if k not in columns]:
        raise ValueError(f"envelope lacks {missing_keys}")
    return F.col("data").isNotNull() & (F.col("status") == "success")


def blank_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and blank values by column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(missing(F.col(c))).alias(f"blank_{c}") for c in columns])


def check_page(page: int, size: int) -> tuple[int, int]:
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and page size lies in 1..100")
    return page, size


def check_window(limit: int, offset: int = 0) -> tuple[int, int]:
    if limit < 1 or offset < 0:
        raise ValueError("limit is at least 1 and offset at least 0")
    return limit, offset


def check_range(start, end) -> None:
    if start is not None and end is not None and start > end:
        raise ValueError("start lies after end")


def check_month(name: str) -> str:
    name = (name or "").strip().capitalize()
    if name not in MONTHS:
        raise ValueError(f"no month: {name!r}")
    return name


def check_term(term: str) -> str:
    if not (term or "").strip():
        raise ValueError("empty search term")
    return term.strip()
