"""Intermediate tables, and joins that a hot key does not slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_path, shared_dir, write_table

__all__ = ["HOT_PARTS", "join_counted", "new_path", "shared_dir", "write_table"]
#: A key with more than 1 / HOT_PARTS of all rows is hot; there are fewer than HOT_PARTS such keys.
HOT_PARTS = 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int, count: str = "rows") -> DataFrame:
    """rows joined to a table with one row a key, whose column `count` tells how many rows have it (of `total`).

    Hot keys, fewer than HOT_PARTS, are broadcast, so that their rows stay where they are; all others meet by a shuffle.
    """
    least = max(1, total // HOT_PARTS)
    hot = F.broadcast(table.where(F.col(count) > least).drop(count))
    rest = table.where(F.col(count) <= least).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))
