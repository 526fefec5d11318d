"""Ordered windows whose keys may be hot: rows are cut into ranges of (key, order), and what a range needs from its
neighbours is carried over, so no task holds a key.

A boundary between two ranges splits one key at most, so what is carried is bounded by the number of ranges and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import write_table

PART = "_fs_part"


def cut(df: DataFrame, keys: list[str], order: list[str], pieces: int) -> DataFrame:
    """df with _fs_part, the number of its range by (keys, order). Written once: range bounds come from a sample, and a
    second pass could draw others. Give `order` a unique last column, or equal rows of a key stay together."""
    if pieces < 1:
        raise ValueError("at least one piece")
    return write_table(df.repartitionByRange(pieces, *keys, *order).withColumn(PART, F.spark_partition_id()), "pieces")


def _same_keys(a: str, b: str, keys: list[str]) -> Column:
    """Null-safe equality of keys, as windows treat them."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return same


def carry_last(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, pieces: int) -> DataFrame:
    """Adds `out`: the last non-null `value` of the key at or before each row, in ascending order. Each range runs on its
    own; then the last values of earlier ranges, one for each range at most, are handed on."""
    spread = cut(df, keys, order, pieces)
    inside = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = spread.withColumn("_fs_local", F.last(value, ignorenulls=True).over(inside))
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_fs_value"))))
    ends = spread.groupBy(*keys, PART).agg(last.alias("_fs_last"))  # a row for each key and range; many only for split keys
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_fs_carried", F.last(F.col("_fs_last._fs_value"), ignorenulls=True).over(before)).where("_fs_carried is not null").select(*keys, PART, "_fs_carried")
    joined = local.alias("l").join(F.broadcast(carried).alias("c"), (F.col(f"l.{PART}") == F.col(f"c.{PART}")) & _same_keys("l", "c", keys), "left")  # fewer rows than ranges
    return joined.select(*[f"l.{c}" for c in df.columns if c != out], F.coalesce("_fs_local", "_fs_carried").alias(out))


def with_halo(df: DataFrame, keys: list[str], order: list[str], columns: list[str], before: int, after: int, pieces: int) -> DataFrame:
    """The rows of each range and, marked _fs_halo, the `before` rows of a split key that come before its range and the
    `after` rows that follow: enough for every window over (_fs_part, keys) that looks no further. columns: what windows
    read of halo rows besides keys and order."""
    spread = cut(df, keys, order, pieces)
    kept = F.struct(*order, *columns)
    up, down = Window.partitionBy(PART, *keys).orderBy(*order), Window.partitionBy(PART, *keys).orderBy(*[F.desc(c) for c in order])
    parts = spread.groupBy(*keys).agg(F.min(PART).alias("_fs_lo"), F.max(PART).alias("_fs_hi")).where("_fs_lo < _fs_hi")  # split keys: fewer than ranges
    split = spread.alias("l").join(F.broadcast(parts).alias("r"), _same_keys("l", "r", keys), "left_semi")
    ranked = split.withColumns({"_fs_first": F.row_number().over(up), "_fs_last": F.row_number().over(down)}).where((F.col("_fs_first") <= after) | (F.col("_fs_last") <= before))
    edges = ranked.groupBy(*keys, PART).agg(
        F.sort_array(F.collect_list(F.when(F.col("_fs_last") <= before, kept))).alias("_fs_tail"), F.sort_array(F.collect_list(F.when(F.col("_fs_first") <= after, kept))).alias("_fs_head"),
    )
    # every range of a split key but its first and last is all its own, and each holds a row of it at least
    w = Window.partitionBy(*keys).orderBy(PART)
    earlier = F.flatten(F.collect_list("_fs_tail").over(w.rowsBetween(-max(before, 1), -1)))
    later = F.flatten(F.collect_list("_fs_head").over(w.rowsBetween(1, max(after, 1))))
    halo = edges.select(*keys, PART, F.concat(F.slice(earlier, F.greatest(F.size(earlier) - before + 1, F.lit(1)), before), F.slice(later, 1, after)).alias("_fs_rows"))
    rows = halo.select(*keys, PART, F.explode("_fs_rows").alias("_fs_row")).select(*keys, PART, "_fs_row.*")
    return spread.withColumn("_fs_halo", F.lit(False)).unionByName(rows.withColumn("_fs_halo", F.lit(True)), allowMissingColumns=True)


def over_pieces(df: DataFrame, keys: list[str], order: list[str], read: list[str], columns: dict, before: int = 0, after: int = 0, pieces: int = 200) -> DataFrame:
    """df with columns {name: window -> expression}, over the rows of each key in ascending order. `read`: the columns that
    the expressions use; they look `before` rows back and `after` rows ahead at most."""
    w = Window.partitionBy(PART, *keys).orderBy(*order)
    held = with_halo(df, keys, order, [c for c in read if c not in order], before, after, pieces)
    return held.withColumns({n: make(w) for n, make in columns.items()}).where("not _fs_halo").drop(PART, "_fs_halo")
