"""Monthly indicators: statistics, comparison, trends, refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import envelope_ok
from ..functions.text import all_of
from ..functions.values import map_fields, normalize_month, normalize_year, period as period_of
from .paging import between
from .upsert import action_counts, fill_null_upsert


def column_statistics(column: str, order: list[str]) -> list[Column]:
    """min, max, average, latest, earliest and count of the non-null values of a column, in time order."""
    by = F.when(F.col(column).isNotNull(), F.struct(*order))
    c = F.col(column)
    average = F.sum(c.cast("decimal(28,6)")).cast("double") / F.count(c)
    return [F.min(c).alias(f"{column}_min"), F.max(c).alias(f"{column}_max"), average.alias(f"{column}_avg"), F.max_by(column, by).alias(f"{column}_latest"), F.min_by(column, by).alias(f"{column}_earliest"), F.count(c).alias(f"{column}_count")]


def statistics(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Statistics of all columns in one pass and one row."""
    return df.agg(*[s for c in columns for s in column_statistics(c, order)])


def statistics_long(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The same, one row an indicator column: unpivoted and grouped."""
    long = df.unpivot(order, columns, "indicator", "value")
    by = F.when(F.col("value").isNotNull(), F.struct(*order))
    return long.groupBy("indicator").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", by).alias("latest"), F.min_by("value", by).alias("earliest"), F.count("value").alias("count"))


def summary(df: DataFrame, order: list[str], indicators: dict[str, list[str]]) -> DataFrame:
    """Row count, first and last period, and complete rows for each indicator."""
    whole = [F.count_if(all_of([F.col(c).isNotNull() for c in columns])).alias(f"{name}_complete") for name, columns in indicators.items()]
    return df.agg(F.count(F.lit(1)).alias("total"), F.min(order[0]).alias("earliest"), F.max(order[0]).alias("latest"), *whole)


def compare_periods(df: DataFrame, columns: list[str], first: Column, second: Column) -> DataFrame:
    """Averages and counts of both sides and the delta of averages, in one pass by conditional aggregates."""
    out = []
    for c in columns:
        side = {}
        for name, cond in (("a", first), ("b", second)):
            v = F.when(cond, F.col(c))
            side[name] = F.sum(v.cast("decimal(28,6)")).cast("double") / F.nullif(F.count(v), F.lit(0))
            out += [side[name].alias(f"{c}_avg_{name}"), F.count(v).alias(f"{c}_count_{name}")]
        out.append((side["b"] - side["a"]).alias(f"{c}_delta"))
    return df.agg(*out)


def compare_months(df: DataFrame, period: str, a, b, columns: list[str]) -> DataFrame:
    """Two periods side by side with deltas (b - a), in one pass; no row unless both are there. Of several rows of a period
    the largest counts."""
    side = lambda v: F.max(F.when(F.col(period) == F.lit(v), F.struct(period, *columns)))
    both = df.where(F.col(period).isin(a, b)).agg(side(a).alias("_a"), side(b).alias("_b")).where("_a is not null and _b is not null")
    named = [F.col(f"_{s}")[c].alias(f"{name}_{s}") for s in "ab" for c, name in ((period, "period"), *((c, c) for c in columns))]
    return both.select(*named).select("period_a", "period_b", *[x for c in columns for x in (f"{c}_a", f"{c}_b", (F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"{c}_delta"))])


def missing_periods(df: DataFrame, period: str, wanted: list) -> list:
    """Which of a few wanted periods have no row; for error messages."""
    have = {r[0] for r in df.where(F.col(period).isin(*wanted)).select(period).distinct().collect()}
    return [w for w in wanted if w not in have]


def month_over_month(df: DataFrame, period: str, column: str, trend: str, keys: list[str] = ()) -> DataFrame:
    """Value minus the previous calendar month's, null across gaps: lag with a check of the distance. Without keys all
    months would meet in one task, so the month before is joined instead."""
    if not keys:
        return previous_period(df, period, column, trend)
    w = Window.partitionBy(*keys).orderBy(period)
    adjacent = F.lag(period).over(w) == F.add_months(period, -1)
    return df.withColumn(trend, F.when(adjacent, F.col(column) - F.lag(column).over(w)))


def previous_period(df: DataFrame, period: str, column: str, trend: str) -> DataFrame:
    """The same by a self join on the month before: scales with the key, needs no order. Of several rows of a month the
    largest value counts as the month's, so rows never multiply."""
    before = df.groupBy(F.add_months(period, 1).alias(period)).agg(F.max(column).alias("_fs_before"))
    return df.join(before, period, "left").withColumn(trend, F.col(column) - F.col("_fs_before")).drop("_fs_before")


def search(df: DataFrame, equals: dict, ranges: dict[str, tuple]) -> DataFrame:
    """Equality and inclusive range filters, any of them optional."""
    conditions = [F.col(c) == F.lit(v) for c, v in equals.items() if v is not None] + [between(F.col(c), *r) for c, r in ranges.items()]
    return df.where(all_of(conditions))


def pivot_sources(frames: dict[str, DataFrame], keys: list[str], columns: dict[str, list[str]]) -> DataFrame:
    """One row a key from per-indicator frames with disjoint columns: a union and one aggregate, one shuffle."""
    every = [c for cs in columns.values() for c in cs]
    parts = [df.select(*keys, *[F.col(c) if c in columns[name] else F.lit(None).cast("double").alias(c) for c in every]) for name, df in frames.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(*[F.max(c).alias(c) for c in every])


def refresh_all(existing: DataFrame, frames: dict[str, DataFrame], keys: list[str], columns: dict[str, list[str]]) -> DataFrame:
    """All indicators into the table at once: the state that refreshing one after another would reach."""
    every = [c for cs in columns.values() for c in cs]
    return fill_null_upsert(existing, pivot_sources(frames, keys, columns), keys, every)


def refresh_indicator(existing: DataFrame, records: DataFrame, fields: dict[str, str], trend: dict[str, str], scope: str = "all") -> DataFrame:
    """One indicator's raw records (strings: month, year and source fields) into the table.

    Months and years are normalised, unusable months dropped, fields renamed and parsed, nulls filled or rows inserted,
    and month-over-month trends added (column -> trend column) for all rows or, with scope 'changed', only for inserted
    and updated ones. Adds action and period.
    """
    if scope not in ("all", "changed"):
        raise ValueError("scope is all or changed")
    columns = map_fields(fields, records.columns)
    clean = records.select(normalize_month(F.col("month")).alias("month"), normalize_year(F.col("year")).alias("year"), *[c.alias(n) for n, c in columns.items()]).where("month is not null")
    first = [F.col(c).asc_nulls_last() for c in columns]
    state = fill_null_upsert(existing, clean, ["month", "year"], list(columns), first).withColumn("period", period_of(F.col("month"), F.col("year")))
    for column, name in trend.items():
        state = previous_period(state, "period", column, name)
        if scope == "changed":
            state = state.withColumn(name, F.when(F.col("action").isin("inserted", "updated"), F.col(name)))
    return state


def records_of(envelopes: DataFrame) -> DataFrame:
    """Records of successful extractor envelopes; others give none."""
    return envelopes.where(envelope_ok(envelopes.columns)).select("table_name", "report_date", "source_url", F.inline("data"))


def refresh_counts(existing: DataFrame, frames: dict[str, DataFrame], keys: list[str], columns: dict[str, list[str]]) -> DataFrame:
    """Counters of each source on its own, against the table before the refresh."""
    out = None
    for name, df in frames.items():
        part = action_counts(fill_null_upsert(existing, df, keys, columns[name])).select(F.lit(name).alias("source"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def refresh_rollup(counts: DataFrame) -> DataFrame:
    """Status and sums over sources: success, partial_success or failed. counts: source, status, saved, report_date."""
    bad, n = F.count_if(F.col("status") != "success"), F.count(F.lit(1))
    status = F.when(bad == 0, "success").when(bad < n, "partial_success").otherwise("failed")
    return counts.agg(n.alias("sources"), bad.alias("failed"), F.sum("saved").alias("rows_saved"), F.min_by("report_date", F.when(F.col("report_date").isNotNull(), F.col("source"))).alias("report_date"), status.alias("status"))
