"""Filters, orders, pages and as-of picks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.rules import check_page, check_window
from ..functions.text import any_of
from ..storage import new_path
from .pieces import carry_last


def contains_ci(column: Column, term: str | None, literal: bool = True) -> Column | None:
    """Case-insensitive containment of a trimmed term; blank: no condition. literal=False lets % and _ be wildcards."""
    term = (term or "").strip()
    if not term:
        return None
    return F.lower(column).contains(term.lower()) if literal else column.ilike(f"%{term}%")


def at_least(column: Column, n: float | None) -> Column | None:
    return None if n is None else column >= n


def between(column: Column, low, high) -> Column | None:
    """Inclusive optional bounds."""
    if low is None and high is None:
        return None
    return (F.lit(True) if low is None else column >= F.lit(low)) & (F.lit(True) if high is None else column <= F.lit(high))


def any_relevant(score: Column, categories: Column, wanted: list[str], threshold: int = 1) -> Column:
    """Score at the threshold or any wanted category."""
    return (score >= threshold) | F.arrays_overlap(categories, F.array(*map(F.lit, wanted)))


def mentions_any(column: Column, terms: list[str]) -> Column:
    low = F.lower(column)
    return any_of([low.contains(t) for t in terms])


def recent(column: Column, as_of, days: int = 150) -> Column:
    """On or after as_of - days; null: false."""
    return F.coalesce(column >= F.lit(as_of) - F.expr(f"interval {days} days"), F.lit(False))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a total order (end it with a unique key)."""
    number, size = check_page(number, size)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def offset_limit(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    limit, offset = check_window(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


@dataclass(frozen=True)
class OrderedPages:
    """A total order cut into ranges of known sizes, so that any page opens only the ranges it lies in."""

    rows: DataFrame
    order: list[Column]
    starts: list[tuple[int, int, int]]  # range, rows before it, its rows

    def window(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows offset to offset + limit of the order, in order."""
        limit, offset = check_window(limit, offset)
        own = [(part, before) for part, before, n in self.starts if before < offset + limit and before + n > offset]
        if not own:
            return self.rows.limit(0).drop("_fs_part")
        first = own[0][1]
        held = self.rows.where(F.col("_fs_part").isin([part for part, _ in own]))  # a filter on the table's partitions
        return held.orderBy("_fs_part", *self.order).offset(offset - first).limit(limit).drop("_fs_part")

    def page(self, number: int, size: int) -> DataFrame:
        number, size = check_page(number, size)
        return self.window(size, (number - 1) * size)

    def total(self) -> int:
        return sum(n for _, _, n in self.starts)


def ordered_pages(df: DataFrame, order: list[Column], pieces: int = 64) -> OrderedPages:
    """Cut df into about equal ranges of a total order (end it with a unique key), written once as a partitioned table. A
    page then sorts the rows of one range or two, however deep it lies; the driver holds one count a range."""
    spread = df.repartitionByRange(pieces, *order).withColumn("_fs_part", F.spark_partition_id())
    path = new_path(df.sparkSession, "pages")
    spread.write.partitionBy("_fs_part").parquet(path)
    rows = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("_fs_part", IntegerType())])).parquet(path)
    starts, before = [], 0
    for r in rows.groupBy("_fs_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_fs_part").collect():
        starts.append((r["_fs_part"], before, r["n"]))
        before += r["n"]
    return OrderedPages(rows, order, starts)


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """status, count, total, limit, offset of a page of df: one aggregate, no window over all rows."""
    total = F.count(F.lit(1))
    return df.agg(F.lit("success").alias("status"), F.greatest(F.least(total - offset, F.lit(limit)), F.lit(0)).cast("long").alias("count"), total.alias("total"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))


def keyset_scan(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next n rows by key after a cursor: a filter, not a deep offset."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(n)


def last_n(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The newest n rows, oldest first."""
    return df.orderBy(*[F.desc(k) for k in keys]).limit(n).orderBy(*keys)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order."""
    return df.withColumn("_fs_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_fs_rn = 1").drop("_fs_rn")


def latest_per_key(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The columns of each key's latest row, by a partial aggregate instead of a window; ties by the columns' values."""
    picked = df.groupBy(*keys).agg(F.max(F.struct(order, *columns)).alias("_fs_last"))
    return picked.select(*keys, "_fs_last.*")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str, pieces: int | None = None) -> DataFrame:
    """Each left row with the last right value at or before its time (of several at one time the largest): union and a
    running last(), one shuffle by key. With `pieces`, rows are cut into that many ranges of (key, time) instead and last
    values handed on between them, so a key may hold any share of the rows."""
    a = left.withColumns({"_fs_ts": F.col(left_ts), "_fs_side": F.lit(1), "_fs_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, F.col(right_ts).alias("_fs_ts"), F.lit(0).alias("_fs_side"), F.col(value).alias("_fs_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = ["_fs_ts", "_fs_side", "_fs_v"]
    if pieces:
        found = carry_last(both, keys, order, "_fs_v", value, pieces)
    else:
        found = both.withColumn(value, F.last("_fs_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return found.where("_fs_side = 1").drop("_fs_ts", "_fs_side", "_fs_v")


def ordered_by_list(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows in the order of a fixed list."""
    return df.orderBy(F.array_position(F.array(*map(F.lit, values)), F.col(column)))
