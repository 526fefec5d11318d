"""Expressions that are evaluated once a row, however often they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns added or replaced. They pass through a generator of one row: projections are not merged
    through it, and of an outer generator no filter is inferred, so later uses read a value instead of repeating the
    expression. Use it where an expensive expression is used more than once."""
    others = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[f"`{c}`" for c in others], F.explode_outer(F.array(row)).alias("_fs_once")).select(*[f"`{c}`" for c in others], *[F.col("_fs_once")[n].alias(n) for n in columns])
