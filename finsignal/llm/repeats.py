"""Removal of repeated byte strings (200 bytes and more) across and inside documents.

Not the named method: see the README. Suffixes are not sorted one by one; strings are sampled by content and refined.
A window is a string of LENGTH bytes.

* Level 1. Each window is represented by the K-byte string inside it whose hash is smallest (the leftmost such), its
  anchor. Neighbouring windows share anchors, so a text gives about one row for 85 bytes: a chunk of windows with one
  anchor. Equal windows have equal anchors, so only chunks whose anchor string occurs twice go on.
* Level 2. Such chunks are cut into pieces of at most STEP windows, aligned to the anchor, and represented by the
  string common to all windows of the piece (LENGTH - STEP + 1 bytes). Again only repeated strings go on.
* Level 3. The windows of what is left, one by one.

At each level a chunk that occurs as a whole twice is settled, and one of its copies stands for all on the next level,
so groups of copies, however large, add one chunk. A level is one shuffle of narrow rows by their string's hash and one
pass over the sorted rows that keeps a single row in memory. Strings in very many documents (found in a sample of them,
which decides the plan and not the result) are dealt over all tasks and counted by partial aggregates instead.

Texts are never shuffled. They are written once to a table bucketed by `part`, a slice of the task that read them; what a
level asks of a text is gathered by part and meets it there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import join_counted, new_path, write_table

LENGTH, K, STEP = 200, 32, 16
SPAN = LENGTH - K + 1  # anchors candidates in a window
PIECE, BATCH = 1 << 17, 1 << 18
BASE = 0x9E3779B97F4A7C15 | 5
MASK = (1 << 64) - 1
PRIME, BASES = (1 << 31) - 1, (1_370_925_743, 918_273_645)
SLICES, SAMPLE_DOCS, HOT_SHARE, HOT_LEAST, HOT_MOST = 16, 4000, 50, 20, 50_000
#: p: where the row is dealt; h: what strings are compared by first; z: the whole chunk; part, row: the text; a: first
#: window; n: windows; o: place of the anchor behind a; need: false for a copy's stand-in.
ROW = "p long, h long, z long, part int, row int, a int, n int, o int, need boolean"
SPAN_ROW, CHUNK_ROW, HOT_ROW = 0, 1, 2
SETTLED = ROW.replace("p long", "kind int")
NAMES = [c.split()[0] for c in ROW.split(", ")]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & MASK))
    out[0] = 1
    return np.multiply.accumulate(out)


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xE7037ED1A0B428DB)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any substring, position-free, from prefix sums: polynomials modulo 2**64, and modulo a prime with two
    bases of their own, mixed into 64 bits so that no regularity of one of them survives. h takes the first and second of
    a chunk's core, z all three of the whole chunk. Two chunks count as equal if h and z both agree."""

    def __init__(self, size: int = BATCH + PIECE + 4 * LENGTH):
        self.power, self.inverse = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
        self.primes = [(_prime_powers(b, size), _prime_powers(pow(b, -1, PRIME), size)) for b in BASES]

    def prefix(self, data: np.ndarray) -> list[np.ndarray]:
        byte, out = data.astype(np.uint64) + np.uint64(1), []
        for terms in (byte * self.power[: len(data)], *(byte * power[: len(data)] % np.uint64(PRIME) for power, _ in self.primes)):
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])  # fewer than 2**33 terms below 2**31
            out.append(sums)
        return out

    def plain(self, prefix: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (prefix[0][ends] - prefix[0][starts]) * self.inverse[starts]

    def prime(self, i: int, prefix: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (prefix[i + 1][ends] - prefix[i + 1][starts]) % np.uint64(PRIME) * self.primes[i][1][starts] % np.uint64(PRIME)

    def h(self, prefix: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed(_mixed(self.plain(prefix, starts, ends)) + self.prime(0, prefix, starts, ends) * np.uint64(0xD6E8FEB86659FD93))

    def z(self, prefix: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> np.ndarray:
        both = self.prime(0, prefix, starts, ends) << np.uint64(31) | self.prime(1, prefix, starts, ends)
        return _mixed(_mixed(both) + _mixed(self.plain(prefix, starts, ends)) * np.uint64(0xD6E8FEB86659FD93) + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by block-wise prefix and suffix minima."""
    n = len(x) - w + 1
    blocks = np.full((-(-len(x) // w), w), np.uint64(MASK))
    blocks.reshape(-1)[: len(x)] = x
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchored_chunks(hasher: Hasher, data: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor - start, anchor hash, chunk hash) of the chunks of a buffer; piece: owner of each byte.
    Windows that cross owners do not exist."""
    if len(data) < LENGTH:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    prefix = hasher.prefix(data)
    at = np.arange(len(data) - K + 1)
    full = _mixed(hasher.plain(prefix, at, at + K))
    low = np.uint64((1 << 20) - 1)
    best = (_sliding_min((full & ~low) | at.astype(np.uint64), SPAN) & low).astype(np.int64)  # leftmost smallest
    inside = piece[: len(best)] == piece[LENGTH - 1 : LENGTH - 1 + len(best)]
    # a window's anchor lies inside it, so equal neighbours have one owner unless a crossing window stands between
    edge = np.flatnonzero((best[1:] != best[:-1]) | (inside[1:] != inside[:-1])) + 1
    start = np.concatenate(([0], edge))
    size = np.diff(np.concatenate((start, [len(best)])))
    keep = inside[start]
    start, size = start[keep], size[keep]
    anchor = best[start]
    return start, size, anchor - start, hasher.h(prefix, anchor, anchor + K), hasher.z(prefix, start, start + size - 1 + LENGTH, anchor - start)


def _dealt(hot: np.ndarray, h: np.ndarray, part: np.ndarray, row: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Where rows go: by h, and rows with a hot h anywhere."""
    p = h.copy()
    many = np.isin(h, hot)
    if many.any():
        own = [x[many].astype(np.uint64) for x in (part, row, a)]
        p[many] = _mixed(own[0] * np.uint64(0xA0761D6478BD642F) + own[1] * np.uint64(0xE7037ED1A0B428DB) + own[2]).view(np.int64)
    return p


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    types = {"p": np.int64, "h": np.int64, "z": np.int64, "need": np.bool_}
    return pa.RecordBatch.from_arrays([pa.array(c.astype(types.get(n, np.int32), copy=False)) for n, c in zip(names, columns)], names)


def _level1(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[tuple[bytes, int, int, int]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(x[0] for x in held), dtype=np.uint8)
            sizes = np.array([len(x[0]) for x in held])
            owner = np.repeat(np.arange(len(held)), sizes)
            base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            start, size, offset, h, z = anchored_chunks(hasher, data, owner)
            who = owner[start]
            part, row, begin = (np.array([x[i] for x in held], dtype=np.int64)[who] for i in (1, 2, 3))
            h, a = h.view(np.int64), start - base[who] + begin
            return _batch(NAMES, _dealt(hot, h, part, row, a), h, z.view(np.int64), part, row, a, size, offset, np.ones(len(a), dtype=bool))

        for batch in batches:
            for text, part, row in zip(*(batch.column(c) for c in ("text", "part", "row"))):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for begin in range(0, max(0, len(data) - LENGTH + 1), PIECE):
                    own = data[begin : begin + PIECE + LENGTH - 1]
                    held.append((own, part.as_py(), row.as_py(), begin))
                    total += len(own)
                    if total >= BATCH:
                        yield flush()
                        held, total = [], 0
        if held:
            yield flush()

    return run


def _near(data: bytes, starts: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(row numbers, base, bytes) of stretches that hold all rows starting in them."""
    order = np.argsort(starts, kind="stable")
    at = 0
    while at < len(order):
        base = int(starts[order[at]])
        to = at + int(np.searchsorted(starts[order[at:]], base + PIECE))
        yield order[at:to], base, np.frombuffer(data[base : base + PIECE + 4 * LENGTH], dtype=np.uint8)
        at = to


def _refine(step: int, hot: np.ndarray):
    """Chunks of a text (a, n, o, need) -> pieces of at most `step` windows with the hash of what they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for text, part, row, chunks in zip(*(batch.column(c) for c in ("text", "part", "row", "found"))):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                flat = chunks.values
                a, n, o = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "n", "o"))
                need = flat.field("need").to_numpy(zero_copy_only=False)
                anchor = a + o
                first, last = anchor - (a + n - 1), o  # distance of the anchor from the last and the first window
                pieces = last // step - first // step + 1
                own = np.repeat(np.arange(len(a)), pieces)
                cls = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (first // step)[own]
                core = anchor[own] - cls * step
                begin, end = np.maximum(a[own], core - step + 1), np.minimum(a[own] + n[own] - 1, core)
                h, z = np.zeros(len(own), dtype=np.uint64), np.zeros(len(own), dtype=np.uint64)
                for rows, base, stretch in _near(data, begin):
                    prefix = hasher.prefix(stretch)
                    h[rows] = hasher.h(prefix, core[rows] - base, core[rows] - step + 1 + LENGTH - base)
                    z[rows] = hasher.z(prefix, begin[rows] - base, end[rows] + LENGTH - base, core[rows] - begin[rows])
                h, where = h.view(np.int64), [np.full(len(own), x.as_py(), dtype=np.int64) for x in (part, row)]
                yield _batch(NAMES, _dealt(hot, h, *where, begin), h, z.view(np.int64), *where, begin, end - begin + 1, anchor[own] - begin, need[own])

    return run


def _settle(hot: np.ndarray):
    """Rows sorted by (h, z), all rows of an h together -> spans of chunks that occur twice as a whole (SPAN_ROW), and one
    chunk of each z, as long as its h has several (CHUNK_ROW). Rows with a hot h pass (HOT_ROW). Between batches one row
    is kept: the first of the last (h, z), with what is known of its fellows."""
    names = NAMES[1:]

    def out(kind: int, c: dict, rows: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        return _batch(["kind", *names], np.full(len(rows), kind), *[c[x][rows] for x in names[:-1]], need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, several, told, more = None, False, False, 0  # row; its z repeats; its span is out; other z of its h were seen
        for batch in batches:
            c = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in names}
            passing = np.isin(c["h"], hot)
            if passing.any():
                at = np.flatnonzero(passing)
                yield out(HOT_ROW, c, at, c["need"][at])
                c = {x: v[~passing] for x, v in c.items()}
            if not len(c["h"]):
                continue
            if held:
                c = {x: np.concatenate([held[x], v]) for x, v in c.items()}
            new_h = np.concatenate(([True], c["h"][1:] != c["h"][:-1]))
            new = new_h | np.concatenate(([True], c["z"][1:] != c["z"][:-1]))
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1
            size = np.diff(np.concatenate((starts, [len(new)])))
            of_h = (np.cumsum(new_h) - 1)[starts]
            kinds = np.bincount(of_h)
            if held:
                size[0] += several
                kinds[0] += more
            again = (size > 1)[group] & c["need"]
            again[0] &= not (held and told)
            at = np.flatnonzero(again)
            yield out(SPAN_ROW, c, at, c["need"][at])
            mixed = kinds[of_h] > 1
            closed = np.flatnonzero(mixed[:-1])
            yield out(CHUNK_ROW, c, starts[closed], c["need"][starts[closed]] & (size[closed] == 1))
            held = {x: v[starts[-1] : starts[-1] + 1] for x, v in c.items()}
            several = told = bool(size[-1] > 1)
            more = int(mixed[-1])
        if held and more:
            yield out(CHUNK_ROW, held, np.array([0]), held["need"] & (not several))

    return run


def _by_place(rows: DataFrame, *columns: str) -> DataFrame:
    """One row a part: a map from row to the list of what is asked of that text."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.repartition(tasks, "part").groupBy("part", "row").agg(F.collect_list(F.struct(*columns)).alias("_own"))
    return each.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("row", "_own"))).alias("_map"))


def _with_found(docs: DataFrame, rows: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """docs and the list `found` of what is asked of each text. docs are bucketed by part: they are not shuffled."""
    joined = docs.join(_by_place(rows, *columns).hint("shuffle_hash"), "part", how)
    return joined.withColumn("found", F.try_element_at("_map", F.col("row"))).drop("_map")


def _settled(docs: DataFrame, sample: DataFrame, least: int, rows_of, name: str) -> tuple[DataFrame, DataFrame]:
    """(spans, chunks for the next level) of one level; rows_of(docs, hot): the level's rows."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = rows_of(sample, np.empty(0, dtype=np.int64)).groupBy("h").count().where(F.col("count") > least).orderBy(F.desc("count"), "h").limit(HOT_MOST)
    hot = np.array([r["h"] for r in often.collect()], dtype=np.int64)
    rows = rows_of(docs, hot).repartition(tasks, "p").sortWithinPartitions("h", "z")
    done = write_table(rows.mapInArrow(_settle(hot), SETTLED), name)
    where, chunk = ("part", "row", "a", "n"), ("part", "row", "a", "n", "o", "need")
    spans, chunks = done.where(F.col("kind") == SPAN_ROW).select(*where), done.where(F.col("kind") == CHUNK_ROW).select(*chunk)
    if len(hot):
        many = done.where(F.col("kind") == HOT_ROW).withColumn("hz", F.struct("h", "z"))
        kinds = write_table(many.groupBy("hz").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(*chunk)).alias("one")), f"{name}-hot")
        mixed = kinds.groupBy("hz.h").agg(F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1").select("h")  # at most HOT_MOST
        below = kinds.withColumn("h", F.col("hz.h")).join(F.broadcast(mixed), "h", "left_semi")
        chunks = chunks.unionByName(below.select("one.*", (F.col("rows") == 1).alias("_alone")).withColumn("need", F.col("need") & F.col("_alone")).drop("_alone"))
        total = kinds.agg(F.sum("rows")).first()[0] or 0
        spans = spans.unionByName(join_counted(many.where("need"), kinds.where("rows > 1").select("hz", "rows"), "hz", total).select(*where))
    return spans, chunks


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs(part, row, text), bucketed by part -> (part, row, a, n): n windows from a on that all repeat; they may overlap."""
    n_docs, parts = docs.agg(F.count(F.lit(1)), F.max("part")).first()
    sample = docs
    if n_docs and n_docs > SAMPLE_DOCS:  # whole parts, evenly spaced
        every = max(1, (parts + 1) * SAMPLE_DOCS // n_docs)
        sample = docs.where(F.col("part").isin(sorted({i * (parts + 1) // every for i in range(every)})))
    least = max(HOT_LEAST, min(n_docs, SAMPLE_DOCS) // HOT_SHARE)
    found, chunks = [], None
    for level, step in enumerate((None, STEP, 1)):
        if step is None:
            rows_of = lambda d, hot: d.select("part", "row", "text").mapInArrow(_level1(hot), ROW)
        else:
            asked = write_table(chunks, f"chunks{level}")
            rows_of = lambda d, hot: _with_found(d.select("part", "row", "text"), asked, "a", "n", "o", "need").where("found is not null").mapInArrow(_refine(step, hot), ROW)  # noqa: E731, B023
        spans, chunks = _settled(docs, sample, least, rows_of, f"level{level + 1}")
        found.append(spans)
    return found[0].unionByName(found[1]).unionByName(found[2])


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], starts[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    return starts[first], reach[np.concatenate((first[1:] - 1, [len(starts) - 1]))]


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("found")):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            found = spans.values
            removed = runs = 0
            digest = hashlib.sha256()
            at = 0
            if found is not None and len(found):
                a, n = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "n"))
                a, b = merge_spans(a, a + n - 1 + LENGTH)
                removed, runs = int((b - a).sum()), len(a)
                for x, y in zip(a.tolist(), b.tolist()):
                    digest.update(data[at:x])
                    at = y
            digest.update(data[at:])
            out.append((len(data), removed, runs, digest.hexdigest()))
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [c.split()[0] for c in OUT.split(", ")])


def placed(documents: DataFrame) -> tuple[DataFrame, str]:
    """((doc_id, text, part, row), its name in the catalog): the documents in a table of their own, bucketed by part. A part is one of SLICES slices
    of a task's rows, so writing needs no shuffle, and joins by part need none either."""
    spark = documents.sparkSession
    at = F.monotonically_increasing_id()
    numbered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), at.alias("_at"))
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    cut = numbered.select("doc_id", "text", (F.shiftright("_at", 33) * SLICES + row % SLICES).cast("int").alias("part"), row.cast("int").alias("row"))
    name, buckets = f"finsignal_texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut.write.format("parquet").option("path", new_path(spark, "texts")).bucketBy(buckets, "part").saveAsTable(name)
    return spark.table(name), name


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, over whole texts as UTF-8 bytes.

    Every byte covered by a 200-byte string that also starts elsewhere goes (same document included, overlaps count);
    strings never cross documents. Null text: empty. Equal rows are copies of one another, and so lose all of a text of
    200 bytes or more. A null doc_id is a document of its own. An empty table gives no rows; other columns are ignored.
    Strings count as equal if two 64-bit hashes agree, one of a core and one of the whole (see Hasher): for m different
    strings with one core a chance of about m**2 / 2**65.
    """
    docs, name = placed(documents)
    try:
        spans = write_table(repeated_spans(docs), "spans")
        return _with_found(docs, spans, "a", "n", how="left").select("doc_id", "text", "found").mapInArrow(_cut, OUT)
    finally:
        documents.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # the catalog's entry; the plan reads the files, which stay in the shared folder
