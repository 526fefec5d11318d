"""Streaming forms of ingestion: dedupe by key, price bars, scores. All run with any trigger; tests use availableNow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import any_of

from ..operators.headlines import build_headline, enrich_articles, min_impact_gate, normalize_entry
from ..operators.quotes import ingest_quotes
from ..operators.sentiment import Scorer, backfill
from ..operators.upsert import new_rows, update_by_key
from ..sources.dims import Dictionary

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within the watermark; state is bounded by the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


class FirstOfKey(StatefulProcessor):
    """Lets the first row of each key through, by `order` among rows that come together. State is one mark a key; with a time
    column, a timer forgets a key once the watermark passes its row's time. A null time: never forgotten."""

    def __init__(self, order: list[str], ts: str | None = None):
        self.order, self.ts = order, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "known boolean")

    def handleInputRows(self, key, rows, timerValues):
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: tuple((r[c] is None, r[c]) for c in self.order))
        self.seen.update((True,))
        if self.ts is not None and first[self.ts] is not None:
            self.handle.registerTimer(int(first[self.ts].timestamp() * 1000))
        yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))


def first_of_key_stream(stream: DataFrame, keys: list[str], order: list[str], ts: str | None = None, delay_ms: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Rows whose key was not seen before, by keyed state in RocksDB: a micro-batch costs what it brings, however much is
    stored. `stored` (rows with the keys) is read once, when the query first starts. With `ts` and `delay_ms`, a key is
    forgotten once the newest time is that far past its row's, so state is bounded, and rows that come later than that are
    dropped. A row with a null key part goes through, as it matches nothing."""
    known = stored.dropna(subset=keys).select(*keys).distinct().groupBy(*keys) if stored is not None else None
    timed = delay_ms is not None
    if timed:
        stream = stream.withWatermark(ts, f"{delay_ms} milliseconds")  # before the rows part, so that both ways see all times
    held = stream.dropna(subset=keys).groupBy(*keys).transformWithState(FirstOfKey(order, ts if timed else None), stream.schema, "append", "eventTime" if timed else "none", known)
    nameless = stream.where(any_of([F.col(k).isNull() for k in keys]))
    return held.unionByName(nameless)


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streaming queries that start here keep their state in RocksDB, which keyed state needs."""
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def append_new_sink(stream: DataFrame, read_others: Callable[[int], DataFrame], write: Callable[[DataFrame, int], None], keys: list[str], order: list[Column]) -> DataStreamWriter:
    """Append keys that are not stored yet: the last guard behind the watermark, also on replays. read_others(number): what
    batches other than this one have stored."""

    def each(batch: DataFrame, number: int) -> None:
        write(new_rows(batch, read_others(number), keys, order), number)

    return stream.writeStream.foreachBatch(each)


def headlines_stream(entries: DataFrame, d: Dictionary = Dictionary(), stored: DataFrame | None = None, delay_ms: int | None = None) -> DataFrame:
    """Landed feed entries to stored rows: enriched, gated, the first of each url by feed order. stored: what an earlier
    life of the table holds (its urls); delay_ms: how long after its publication a url is remembered (default: always)."""
    rows = build_headline(min_impact_gate(enrich_articles(normalize_entry(entries).where("not malformed"), d)))
    return first_of_key_stream(rows, ["url"], ["feed_ord", "entry_ord"], "published_at", delay_ms, stored)


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append-only Parquet sink, each row once whatever restarts."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def bars_stream(stream: DataFrame, ts: str, key: str, value: str, every: str, delay: str) -> DataFrame:
    """Open, high, low, close and count of tumbling windows; a window comes out once the watermark has passed it."""
    at = F.struct(ts, value)
    bars = stream.withWatermark(ts, delay).groupBy(F.window(ts, every), key).agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).alias("n"))
    return bars.select(F.col("window.start").alias("bar_start"), key, "open", "high", "low", "close", "n")


def quotes_stream(raw: DataFrame, path: str, checkpoint: str) -> tuple[StreamingQuery, StreamingQuery]:
    """Raw quotes to market rows: valid ones are appended to `path`, the others with their reason to `path`-quarantine. Each
    query has a checkpoint of its own and goes on by itself."""
    rows = ingest_quotes(raw)
    good = append_stream(rows.where("reason is null").drop("reason"), path, checkpoint).trigger(availableNow=True).start()
    bad = append_stream(rows.where("reason is not null"), f"{path}-quarantine", f"{checkpoint}-quarantine").trigger(availableNow=True).start()
    return good, bad


def scores_sink(headlines: DataFrame, scorer: Scorer, read_stored: Callable[[int], DataFrame], write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Scores of new headlines (id, headline, description, content, sentiment_score), written into the stored ones by id:
    each micro-batch is one update of the table. read_stored(number): the table before that batch, so a replayed batch
    gives the same table."""

    def each(batch: DataFrame, number: int) -> None:
        scored = backfill(batch, scorer).where("outcome = 'updated'")
        write(update_by_key(read_stored(number), scored.select("id", "sentiment_score"), "id", "sentiment_score"), number)

    return headlines.writeStream.foreachBatch(each)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Replay what is there, write it to a Parquet folder and return the table."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
