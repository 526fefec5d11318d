"""Exact deduplication as a chain of three streaming queries, which go on where they stopped.

    arrive   reads new files; each row becomes (doc_id, digest, code points, locator): texts stay where they are
    claim    keyed state without expiry, held in RocksDB: a digest's number of rows, the row that claimed it first (its
             id and where its content lies) and the row that stays. Rows are merged before they are shuffled to the state
    check    a row whose digest was claimed by another is a hit: its bytes are read again and compared with the claim's

A locator is a file's path and a row's place in it, so files that were read must stay as they are. Where a digest turns out
to stand for different contents, its rows are told apart by their bytes and counted by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import HOT_PARTS, join_counted, new_path, write_table

SPACES = b" \t\n\v\f\r"
#: State on disk: commits write changes, not whole copies, and many small stores do not set disk aside for growth.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FILES_A_BATCH = 1000
FILTER_BITS = 1 << 25  # of the filter that tells which rows a second reading needs: 4 MB at most
AT = ["file", "row"]
ARRIVED = "doc_id long, sha binary, chars long, file string, row long, seen timestamp"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each text without its white space, and the code points of the text itself."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = [hashlib.sha256(t.encode("utf-8", "surrogatepass").translate(None, SPACES)).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary()), pa.array(list(map(len, texts)), pa.int64()), *[batch.column(c) for c in ("file", "row", "seen")]], [f.split()[0] for f in ARRIVED.split(", ")])


@contextmanager
def _disk_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start here keep their state in RocksDB."""
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _contents(files: list[str], bits: np.ndarray, spark: SparkSession) -> DataFrame:
    """(file, row, sha, content): white space out, of the rows of `files` that the filter lets through."""
    mask = np.int64(len(bits) * 64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy() & mask
            kept = pa.array(np.flatnonzero((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)))
            part = batch.take(kept)
            bare = [(t or "").encode("utf-8", "surrogatepass").translate(None, SPACES) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("file"), part.column("row"), pa.array([hashlib.sha256(t).digest() for t in bare], pa.binary()), pa.array(bare, pa.binary())], ["file", "row", "sha", "content"])

    read = spark.read.schema("text string").parquet(*files)
    rows = read.select("text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).withColumn("at", F.xxhash64(*AT))
    return rows.mapInArrow(run, "file string, row long, sha binary, content binary")


def _filter(wanted: DataFrame, n: int) -> np.ndarray:
    """A bit for each wanted locator, at least 8 bits a row as long as FILTER_BITS allow. It lets every wanted row through
    and some others; a full one lets all through."""
    size = min(FILTER_BITS, max(64, 1 << (8 * n - 1).bit_length()))
    at = F.xxhash64(*AT).bitwiseAND(F.lit(size - 1))
    words = wanted.select(at.alias("_at")).select(F.shiftright("_at", 6).alias("word"), F.expr("shiftleft(1L, cast(_at & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # size / 64 rows at most
    bits = np.zeros(size // 64, dtype=np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def _compare(keep: bool):
    """Rows sorted by (digest, piece): one row for each of these, telling whether all its contents are the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, rows, same = None, b"", 0, True
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[], [], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["digest", "piece", "rows", "same", "content"])

        for batch in batches:
            for digest, piece, content in zip(batch.column("digest").to_pylist(), batch.column("piece").to_pylist(), batch.column("content")):
                data = content.as_py()
                if own != (digest, piece):
                    if own:
                        out.append((*own, rows, same, first if keep else b""))
                    own, first, rows, same = (digest, piece), data, 0, True
                rows, same = rows + 1, same and data == first
            if out:
                yield made()
                out.clear()
        if own:
            out.append((*own, rows, same, first if keep else b""))
            yield made()

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest: which of the digest's contents each row holds, from 0 in the order they come."""
    own, seen = None, {}
    for batch in batches:
        found = []
        for digest, content in zip(batch.column("digest").to_pylist(), batch.column("content").to_pylist()):
            if digest != own:
                own, seen = digest, {}
            found.append(seen.setdefault(content, len(seen)))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("digest", "file", "row")], pa.array(found, pa.int64())], ["digest", "file", "row", "variant"])


@dataclass
class ExactDedup:
    """Rows of the Parquet files at `path` (columns doc_id and text; others are ignored), deduplicated in `folder`, which
    driver and executors share. run() takes in what is new; result() tells of every row so far. digest_bytes: how much of
    the SHA-256 the state is keyed by; fewer than 32 make contents share a digest, for tests."""

    spark: SparkSession
    path: str
    folder: str
    files_a_batch: int = FILES_A_BATCH
    digest_bytes: int = 32

    @property
    def digest(self) -> Column:
        return F.substring("sha", 1, self.digest_bytes)

    def _write(self, stream: DataFrame, name: str):
        return stream.writeStream.option("checkpointLocation", f"{self.folder}/{name}-log").trigger(availableNow=True)

    def arrive(self) -> None:
        rows = self.spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", self.files_a_batch).parquet(self.path)
        narrow = rows.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.current_timestamp().alias("seen"))
        self._write(narrow.mapInArrow(_digests, ARRIVED), "arrive").format("parquet").option("path", f"{self.folder}/arrived").start().awaitTermination()

    def _arrivals(self) -> DataFrame:
        return self.spark.readStream.schema(ARRIVED).option("maxFilesPerTrigger", self.files_a_batch).parquet(f"{self.folder}/arrived")

    def claim(self) -> None:
        """The state: partial sums before the shuffle, one row a digest behind it, no watermark, so nothing expires."""
        first = F.struct("seen", *AT, "doc_id")  # the time of a micro-batch: later ones never come first
        stays = F.struct("chars", F.col("doc_id").isNotNull().alias("named"), F.bitwise_not("doc_id").alias("falling"), *AT)
        state = self._arrivals().groupBy(self.digest.alias("digest")).agg(F.count(F.lit(1)), F.min(first), F.max(stays))
        with _disk_state(self.spark):
            query = self._write(state, "claim").format("noop").outputMode("update").start()
        query.awaitTermination()

    def groups(self) -> DataFrame:
        """(digest, rows, first, stays): the state as it is, read from its checkpoint, where values have their functions' names."""
        with _disk_state(self.spark):
            state = self.spark.read.format("statestore").load(f"{self.folder}/claim-log")
        return state.select("key.*", "value.count", "value.min", "value.max").toDF("digest", "rows", "first", "stays")

    def check(self) -> None:
        self._write(self._arrivals(), "check").foreachBatch(self._check_batch).start().awaitTermination()

    def _check_batch(self, batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("digest", self.digest)
        groups = write_table(self.groups().where("rows > 1"), "claimed")
        total = groups.agg(F.sum("rows")).first()[0] or 0
        met = join_counted(batch.select("digest", *AT), groups.select("digest", "rows", "first"), "digest", total)
        hits = write_table(met.where("file <> first.file or row <> first.row"), "hits")
        claims = hits.select("digest", "first.file", "first.row").distinct()
        wanted = hits.select("digest", *AT).unionByName(claims)
        mixed = self._compared(wanted, groups, total)
        if mixed is None or mixed.isEmpty():
            split = self.spark.createDataFrame([], "digest binary, file string, row long, variant long")
        else:
            split = self._split(mixed)
        split.write.mode("overwrite").parquet(f"{self.folder}/split/batch={number}")

    def _texts(self, wanted: DataFrame) -> tuple[DataFrame | None, int]:
        n = wanted.count()
        files = [r[0] for r in wanted.select("file").distinct().collect()]  # paths, which the driver lists to read them anyway
        return (_contents(files, _filter(wanted, n), self.spark).withColumn("digest", self.digest) if n else None), n

    def _compared(self, wanted: DataFrame, groups: DataFrame, total: int) -> DataFrame | None:
        """Digests of the wanted rows that stand for more than one content. Contents meet by digest; those of a digest with
        more than 1 / HOT_PARTS of the rows meet in pieces of about that many first, then one content a piece."""
        texts, n = self._texts(wanted)
        if texts is None:
            return None
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        share = max(1, total // HOT_PARTS)
        hot = F.broadcast(groups.where(F.col("rows") > share).select("digest", F.ceil(F.col("rows") / share).alias("_pieces")))
        dealt = texts.join(hot, "digest", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64(*AT), F.col("_pieces")), F.lit(-1).cast("long")))
        shape = "digest binary, piece long, rows long, same boolean, content binary"
        once = dealt.select("digest", "piece", "content").repartition(parts, "digest", "piece").sortWithinPartitions("digest", "piece").mapInArrow(_compare(True), shape)
        once = write_table(once.withColumn("content", F.when(F.col("piece") >= 0, F.col("content"))), "compared")
        if (once.agg(F.sum("rows")).first()[0] or 0) < n:
            raise ValueError("contents that were read before cannot be found at their places")
        again = once.where("piece >= 0").select("digest", F.lit(0).cast("long").alias("piece"), "content").repartition(parts, "digest").sortWithinPartitions("digest").mapInArrow(_compare(False), shape)
        return write_table(once.where("not same").select("digest").unionByName(again.where("not same").select("digest")).distinct(), "mixed")

    def _split(self, mixed: DataFrame) -> DataFrame:
        """All rows of digests that stand for several contents, by content. Nothing comes here unless SHA-256 collides."""
        arrived = self.spark.read.schema(ARRIVED).parquet(f"{self.folder}/arrived").withColumn("digest", self.digest)
        members = write_table(arrived.join(mixed, "digest", "left_semi").select("digest", *AT), "members")
        texts, _ = self._texts(members)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = texts.join(members.select(*AT), AT, "left_semi").select("digest", *AT, "content")
        return own.repartition(parts, "digest").sortWithinPartitions("digest", *AT).mapInArrow(_variants, "digest binary, file string, row long, variant long")

    def run(self) -> ExactDedup:
        self.arrive()
        self.claim()
        self.check()
        return self

    def result(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256: one row for each row that came in. Null texts count as empty. Of
        equal texts the row with the most code points stays, then the smallest doc_id (null ids last), then the last by
        file and place, so of repeated rows one is kept."""
        arrived = self.spark.read.schema(ARRIVED).parquet(f"{self.folder}/arrived").withColumn("digest", self.digest)
        split = self.spark.read.schema("digest binary, file string, row long, variant long, batch long").parquet(f"{self.folder}/split")
        groups = write_table(self.groups().select("digest", "rows", F.col("rows").alias("group_size"), F.bitwise_not("stays.falling").alias("keep_id"), "stays"), "groups")
        total = groups.agg(F.sum("rows")).first()[0] or 0
        columns = ["doc_id", "keep_id", "group_size", F.expr("file = stays.file and row = stays.row").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
        if split.isEmpty():
            return join_counted(arrived, groups, "digest", total).select(*columns)
        last = split.withColumn("_last", F.max("batch").over(Window.partitionBy("digest"))).where("batch = _last").select("digest", *AT, "variant")
        mixed = write_table(last.select("digest").distinct(), "mixed")
        sure = join_counted(arrived.join(mixed, "digest", "left_anti"), groups, "digest", total).select(*columns)
        own = arrived.join(last, ["digest", *AT])
        order = Window.partitionBy("digest", "variant").orderBy(F.desc("chars"), F.col("doc_id").isNull(), "doc_id", F.desc("file"), F.desc("row"))
        whole = Window.partitionBy("digest", "variant")
        told = own.select("doc_id", F.first("doc_id").over(order).alias("keep_id"), F.count(F.lit(1)).over(whole).alias("group_size"), (F.row_number().over(order) == 1).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
        return sure.unionByName(told)


def deduplicate(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the Parquet table at `path`, by a new state of its own; see ExactDedup. An empty table gives no rows."""
    table = path.rstrip("/")
    return ExactDedup(spark, f"{table[:-1]}[{table[-1]}]", new_path(spark, "exact-dedup")).run().result()
