"""Table updates as joins and rewrites: plain Parquet tables have no MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_of, any_of
from ..storage import write_table
from .paging import first_per_key


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Append-only insert of validated rows. A job is all or nothing, so rows that would fail are set apart before it
    (rules.quarantine) instead of being tried one by one after it."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def rewrite(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Write a new version of a table to a folder of its own; readers move over when it is whole."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Batch rows to insert: the first of each key, unless the key is stored. Rows with a null key part match nothing, so
    each of them is inserted."""
    named = first_per_key(batch.dropna(subset=keys), keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")
    return named.unionByName(batch.where(any_of([F.col(k).isNull() for k in keys])).select(*named.columns))


def new_row_counts(batch: DataFrame, existing: DataFrame, keys: list[str], by: list[str], order: list[Column]) -> DataFrame:
    """fetched, saved and duplicates for each value of `by`: what new_rows inserts and leaves out. Partial aggregates by key
    pick the first row, so no task holds the rows of a key."""
    fetched = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("fetched"))
    ranks = [c.alias(f"_fs_o{i}") for i, c in enumerate(order)]
    first = batch.dropna(subset=keys).select(*keys, F.struct(*ranks, *by).alias("_fs_at")).groupBy(*keys).agg(F.min("_fs_at").alias("_fs_at"))
    named = first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*[F.col(f"_fs_at.{c}").alias(c) for c in by])
    nameless = batch.where(any_of([F.col(k).isNull() for k in keys])).select(*by)
    saved = named.unionByName(nameless).groupBy(*[F.col(c).alias(f"_fs_{c}") for c in by]).agg(F.count(F.lit(1)).alias("_fs_saved"))
    same = all_of([F.col(c).eqNullSafe(F.col(f"_fs_{c}")) for c in by])
    n = F.coalesce("_fs_saved", F.lit(0).cast("long"))
    return fetched.join(saved, same, "left").select(*by, "fetched", n.alias("saved"), (F.col("fetched") - n).alias("duplicates"))


def fill_null_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """Insert unmatched keys; for matched keys fill a column only where the stored value is null.

    Adds action: inserted, updated, unchanged, or kept (stored rows without incoming ones). Keys match by plain
    equality, so a null key part always inserts. With `order`, the first incoming row of each key counts; rows with a
    null key part are then all kept apart.
    """
    if order is not None:
        whole = incoming.dropna(subset=keys)
        incoming = first_per_key(whole, keys, order).unionByName(incoming.join(whole.select(*keys).distinct(), keys, "left_anti"))
    e = existing.select(*keys, *[F.col(c).alias(f"_e_{c}") for c in columns], F.lit(True).alias("_e"))
    i = incoming.select(*keys, *[F.col(c).alias(f"_i_{c}") for c in columns], F.lit(True).alias("_i"))
    both = e.join(i, keys, "full")
    filled = F.lit(False)
    for c in columns:
        filled = filled | (F.col(f"_e_{c}").isNull() & F.col(f"_i_{c}").isNotNull())
    action = F.when(F.col("_e").isNull(), "inserted").when(F.col("_i").isNull(), "kept").when(filled, "updated").otherwise("unchanged")
    return both.select(*keys, *[F.coalesce(f"_e_{c}", f"_i_{c}").alias(c) for c in columns], action.alias("action"))


def action_counts(df: DataFrame) -> DataFrame:
    """inserted, updated, unchanged and saved of an upsert, in one row."""
    n = {a: F.count_if(F.col("action") == a) for a in ("inserted", "updated", "unchanged")}
    return df.agg(*[c.alias(a) for a, c in n.items()], (n["inserted"] + n["updated"]).alias("saved"))


def update_by_key(existing: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Overwrite one column where an update with a non-null value exists. Of several updates of a key the largest value
    counts, so rows never multiply."""
    u = updates.groupBy(key).agg(F.max(column).alias("_fs_new"))
    return existing.join(u, key, "left").withColumn(column, F.coalesce("_fs_new", column)).drop("_fs_new")


def insert_strict(batch: DataFrame, existing: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, conflicts): stored keys are reported and never overwritten."""
    stored = existing.select(*keys).distinct()
    return batch.join(stored, keys, "left_anti"), batch.join(stored, keys, "left_semi")


def assign_ids(df: DataFrame, order: list[Column], start: int, buckets: int = 64) -> DataFrame:
    """Gapless ascending ids from start + 1 in a total order: a range partitioning and per-partition offsets, so no task
    sees all rows. The partitioned rows are written once with the number of their partition: range bounds come from a
    sample, and a second pass could draw others."""
    spread = write_table(df.repartitionByRange(buckets, *order).withColumn("_fs_part", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy("_fs_part").agg(F.count(F.lit(1)).alias("_fs_n"))
    before = F.coalesce(F.sum("_fs_n").over(Window.orderBy("_fs_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_fs_part", before.alias("_fs_before"))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("_fs_part").orderBy(*order))
    return spread.withColumn("_fs_rn", inside).join(F.broadcast(offsets), "_fs_part").withColumn("id", F.lit(start) + F.col("_fs_before") + F.col("_fs_rn")).drop("_fs_part", "_fs_rn", "_fs_before")


def requested(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for; missing keys are left out."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
