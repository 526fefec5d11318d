"""Streaming queries: tables are replayed from their files with availableNow and compared with batch SQL.

What is stored is read from its folder, so a query that starts again goes on where the last one stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import table
from ..storage import exists, new_path
from ..streaming import streams as ST
from .market import ORACLE as MARKET_SQL
from .market import raw_quotes, quote_totals
from .news import ENRICHED, WORDS, entries_of
from .reports import headlines_of, lexicon, SCORED_SQL


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files; a pattern, since the table may be one file or a folder."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def _events(spark, sf):
    """Events with ts as an instant: the stored wall clock is UTC, whatever the session's zone."""
    return _stream(spark, sf, "events").withColumn("ts", F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp"))


def _stored(spark: SparkSession, schema, folder: str) -> DataFrame:
    """All batches in a folder, with their number; none where nothing is written yet."""
    numbered = StructType([*schema.fields, StructField("batch", LongType())])
    if not exists(spark, folder):
        return spark.createDataFrame([], numbered)
    return spark.read.schema(numbered).parquet(folder)


def append_new(stream: DataFrame, folder: str, keys: list[str], order: list) -> DataFrame:
    """Run a stream into a folder of batches behind the append-only guard, and return what is stored. A batch is written
    over if it is replayed, and is no part of what it is compared with."""
    spark, out = stream.sparkSession, f"{folder}/out"

    def write(fresh, number):
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def others(number):
        return _stored(spark, stream.schema, out).where(F.col("batch") != number).drop("batch")

    ST.append_new_sink(stream, others, write, keys, order).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _stored(spark, stream.schema, out).drop("batch")


def stream_dedupe(spark, sf):
    """Keys of events, each once: watermark dedupe, then the append-only guard against what is stored."""
    keys = ["user_id", "event_type"]
    stream = ST.dedupe_stream(_events(spark, sf), keys, "ts", "40 days").select(*keys)
    return append_new(stream, new_path(spark, "dedupe"), keys, [F.col(k) for k in keys])


def ingest_stream(entries: DataFrame, folder: str, stored: DataFrame | None = None) -> DataFrame:
    """Take what has landed into the headlines of a folder, and return them all. Starting again goes on."""
    rows = ST.headlines_stream(entries, WORDS, stored)
    with ST.disk_state(entries.sparkSession):
        query = ST.append_stream(rows, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return entries.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")


def stream_headlines(spark, sf):
    """Documents as landed feed entries: normalised, enriched, gated, deduplicated by url, appended."""
    stored = ingest_stream(entries_of(_stream(spark, sf, "documents")), new_path(spark, "headlines"))
    return stored.select("url", "keywords_detected", "categories", "matched_keywords_count", "impact_score")


def stream_quotes(spark, sf):
    """Events as raw quotes, parsed; valid rows are appended, the others kept apart. Totals of both."""
    folder = new_path(spark, "quotes")
    raw = raw_quotes(_stream(spark, sf, "events")).drop("event_id")
    for query in ST.quotes_stream(raw, f"{folder}/out", f"{folder}/checkpoint"):
        query.awaitTermination()
    good, bad = spark.read.parquet(f"{folder}/out").withColumn("reason", F.lit(None).cast("string")), spark.read.parquet(f"{folder}/out-quarantine")
    return quote_totals(good.unionByName(bad))


def stream_scores(spark, sf):
    """Documents as new headlines: their scores are written into the stored ones."""
    folder = new_path(spark, "scores")
    start = headlines_of(table(spark, sf, "documents")).select("id", "sentiment_score")
    start.write.parquet(f"{folder}/out/version=0")
    done = update_versions(headlines_of(_stream(spark, sf, "documents")), folder)
    return done.select("id", F.round(F.col("sentiment_score") * 10000).cast("long").alias("score_x10000"))


def update_versions(headlines: DataFrame, folder: str) -> DataFrame:
    """Run score updates over the versions of a table in a folder; batch n makes version n + 1 from the newest before it."""
    spark = headlines.sparkSession

    def before(number):
        every = spark.read.parquet(f"{folder}/out")
        last = every.where(F.col("version") <= number).agg(F.max("version")).first()[0]
        return every.where(F.col("version") == last).drop("version")

    def write(updated, number):
        updated.write.mode("overwrite").parquet(f"{folder}/out/version={number + 1}")

    ST.scores_sink(headlines, lexicon(), before, write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return before(1 << 30)


def stream_bars(spark, sf):
    """Daily bars by event type of all days that the watermark has passed."""
    folder = new_path(spark, "bars")
    bars = ST.bars_stream(_events(spark, sf), "ts", "event_type", "value", "1 day", "1 hour")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("bar_start").cast("timestamp_ntz"))
    return ST.run_to_table(bars, f"{folder}/out", f"{folder}/checkpoint").withColumn("bar_start", utc)


QUERIES = {f.__name__: f for f in (stream_dedupe, stream_headlines, stream_quotes, stream_scores, stream_bars)}
ORACLE = {
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_headlines": f"""WITH {ENRICHED} SELECT DISTINCT ON (url) url, nullif(array_to_string(kw, ', '), '') AS keywords_detected, nullif(array_to_string(cats, ', '), '') AS categories, n_kw AS matched_keywords_count, impact AS impact_score
  FROM (SELECT *, md5(lower(text)) AS url FROM e) WHERE impact >= 2""",
    "stream_quotes": MARKET_SQL["quote_parse"],
    "stream_scores": f"SELECT id, CASE WHEN doc5 THEN 2500 ELSE score_x10000 END::BIGINT AS score_x10000 FROM ({SCORED_SQL})",
    "stream_bars": "SELECT date_trunc('day', ts)::TIMESTAMP AS bar_start, event_type, arg_min(value, struct_pack(a := ts, b := value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, struct_pack(a := ts, b := value)) AS close, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL",
}
