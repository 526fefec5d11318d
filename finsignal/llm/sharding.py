"""Sharding by jump consistent hashing: no ring table, and appended shards take rows only into themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The multiplier of the published jump hash generator, 2862933555777941757, in 32- and 16-bit parts.
MULT_HIGH, MULT_LOW1, MULT_LOW0 = 0x27BB2EE6, 0x87B0, 0xB0FD
MASK32 = 0xFFFFFFFF
RANGE_ROWS = 10_000  # slots that one row becomes at a time


def key_halves(key: Column) -> tuple[Column, Column]:
    """Two unsigned 32-bit halves of a stable 64-bit key: the first 16 hex digits of md5(text form); null counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64, in halves, without leaving signed 64-bit range."""
    mid = low * F.lit(MULT_LOW1)
    sum_low = low * F.lit(MULT_LOW0) + F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    cross = high * F.lit(MULT_LOW0) + F.shiftleft((high * F.lit(MULT_LOW1)).bitwiseAND(F.lit(0xFFFF)), 16)
    sum_high = cross.bitwiseAND(F.lit(MASK32)) + (low * F.lit(MULT_HIGH)).bitwiseAND(F.lit(MASK32)) + F.shiftright(sum_low, 32) + F.shiftright(mid, 16)
    return sum_high.bitwiseAND(F.lit(MASK32)), sum_low.bitwiseAND(F.lit(MASK32))


def jump_shards(key: Column, counts: list[int]) -> Column:
    """array<int>: the shard of `key` for each shard count in `counts` (each at least 1).

    The sequence of jumps depends on the key alone, so one pass to the largest count gives all answers.
    """
    if not counts or min(counts) < 1:
        raise ValueError("shard counts must be positive")
    most = max(counts)
    high, low = key_halves(key)

    def step(s: Column, _: Column) -> Column:
        new_high, new_low = _next(s["high"], s["low"])
        landed = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(new_high, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(landed.alias("j"), new_high.alias("high"), new_low.alias("low"), F.transform(s["at"], lambda old, i: F.when(s["j"] < F.element_at(F.array(*map(F.lit, counts)), i + 1), s["j"].cast("int")).otherwise(old)).alias("at"))
        return F.when(s["j"] < most, moved).otherwise(s)

    start = F.struct(F.lit(0).cast("long").alias("j"), high.alias("high"), low.alias("low"), F.array(*[F.lit(0)] * len(counts)).alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["at"])


def assign_shards(df: DataFrame, key: str, shards: int, grown: int | None = None, shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """Add the shard of each row, and its shard once there are `grown` shards. A projection: no shuffle, any row order.

    Equal keys share a shard; a null key is the key ''. Existing columns of the output names are replaced.
    """
    both = jump_shards(F.col(key), [shards, grown or shards + 1])
    return df.withColumn("_fs_jump", both).withColumns({shard_col: F.col("_fs_jump")[0], grown_col: F.col("_fs_jump")[1]}).drop("_fs_jump")


def number_slots(df: DataFrame, shard_col: str, keys: list[str], spread: Column, slot_col: str = "slot") -> DataFrame:
    """Gapless numbers from 0 inside each shard, ordered by (spread, keys); rows of one shard never meet in one task.

    df: narrow rows (shard, keys). Equal rows are counted before the shuffle and expanded after it, in ranges of at most
    RANGE_ROWS that are dealt to tasks anew, so a key that holds a third of all rows costs one row a task on the way in,
    and neither one task nor one array on the way out. `spread`: a small integer expression of bounded range, which
    splits a shard into pieces; pieces get their offsets from a table of shards x pieces counts.
    """
    cols = [shard_col, "_fs_piece", *keys]
    packed = df.withColumn("_fs_piece", spread).groupBy(*cols).agg(F.count(F.lit(1)).alias("_fs_n"))
    pieces = packed.groupBy(shard_col, "_fs_piece").agg(F.sum("_fs_n").alias("_fs_rows"))
    before = Window.partitionBy(shard_col).orderBy("_fs_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(F.col(shard_col), F.col("_fs_piece"), F.coalesce(F.sum("_fs_rows").over(before), F.lit(0)).alias("_fs_offset"))
    inside = Window.partitionBy(shard_col, "_fs_piece").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    started = packed.withColumn("_fs_start", F.coalesce(F.sum("_fs_n").over(inside), F.lit(0)))
    at = F.col("_fs_offset") + F.col("_fs_start")
    joined = started.join(F.broadcast(offsets), [shard_col, "_fs_piece"])  # at most shards x pieces rows
    named = joined.withColumn("_fs_at", at).drop("_fs_piece", "_fs_start", "_fs_offset")
    one = named.where("_fs_n = 1").withColumn(slot_col, F.col("_fs_at"))
    ranges = named.where("_fs_n > 1").withColumn("_fs_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_fs_n") - 1) / RANGE_ROWS))))
    first = F.col("_fs_at") + F.col("_fs_no") * RANGE_ROWS
    last = F.least(first + RANGE_ROWS, F.col("_fs_at") + F.col("_fs_n")) - 1
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = ranges.withColumns({"_fs_first": first, "_fs_last": last}).repartition(tasks).withColumn(slot_col, F.explode(F.sequence("_fs_first", "_fs_last")))
    return one.drop("_fs_n", "_fs_at").unionByName(many.drop("_fs_n", "_fs_at", "_fs_no", "_fs_first", "_fs_last"))


def shard_documents(documents: DataFrame, shards: int = 16, pieces: int = 512) -> DataFrame:
    """Law `key`: doc_id and the shard count decide the shard.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (of the bytes; null text: 0), law,
    shard, slot (gapless from 0 in its shard) and grown_shard (with one more shard). A null doc_id is a key of its own;
    repeated rows get slots of their own; an empty table gives no rows; other columns are ignored. Only ids, sizes and
    checksums are shuffled, never texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign_shards(narrow, "doc_id", shards, shards + 1)
    _, low = key_halves(F.col("doc_id"))
    slots = number_slots(placed, "shard", ["grown_shard", "doc_id", "size", "text_crc32"], F.pmod(low, F.lit(pieces)))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
