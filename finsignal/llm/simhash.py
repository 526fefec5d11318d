"""SimHash near-dedup through a segment-popcount embedding.

Each fingerprint of 64 bits is cut into 32 segments of two bits; its embedding is the vector of bit counts per segment.
The Manhattan distance of two embeddings is a lower bound of the Hamming distance, so fingerprints at most 4 bits apart
lie at most 4 apart in the embedding. Cut into 7 groups of segments, such vectors agree exactly in at least 3 groups:
the cells of the grid are the counts in each choice of 3 groups (35 grids), and a link shares a cell in at least one.
Inside a cell, pairs pass the Manhattan bound first and the exact distance then; a cell gives the tree of links that
keeps its texts connected, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import join_counted, write_table

SHINGLE, SEED, BITS = 4, 42, 4
LOW_BITS = 0x5555555555555555  # the lower bit of every two-bit segment
BLOCK_BYTES, BLOCK_SHINGLES = 4 << 20, 1 << 16
SMALL_CELL, LARGE_CELL = 12, 4096


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists that overlap by SHINGLE - 1 words, so that memory does not grow with the text."""
    kept: list[bytes] = []
    start, n = 0, len(data)
    while start < n:
        stop = min(n, start + BLOCK_BYTES)
        while stop < n and data[stop] not in b" \t\n\v\f\r":
            stop += 1
        words = kept + data[start:stop].split()
        yield words
        kept, start = words[-(SHINGLE - 1) :], stop


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 4-word shingles of a text (A-Z lower-cased); repeats count; no words (or null): 0."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() and split() know ASCII only
    ones, total = np.zeros(64, dtype=np.int64), 0
    digest, few = xxhash.xxh64_intdigest, []
    for words in _word_blocks(data):
        n = len(words) - SHINGLE + 1
        if n < 1:
            few = words
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts, stops = (np.concatenate(([0], ends[: n - 1]))).tolist(), (ends[SHINGLE - 1 :] - 1).tolist()
        for at in range(0, n, BLOCK_SHINGLES):
            part = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK_SHINGLES], stops[at : at + BLOCK_SHINGLES])]
            h = np.array(part, dtype=np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
    if not total:
        return digest(b" ".join(few), SEED) if few else 0
    return sum(1 << b for b in np.flatnonzero(ones * 2 > total).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_signed(fingerprint(x.as_py())) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every whole text. Arrow batches; no shuffle."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """The bit counts of the 32 segments in unary code (0: 00, 1: 01, 2: 11), packed in 64 bits: Manhattan distances of
    count vectors are Hamming distances of these codes."""
    shifted = F.shiftrightunsigned(fp, 1)
    low = fp.bitwiseOR(shifted).bitwiseAND(F.lit(LOW_BITS))
    both = fp.bitwiseAND(shifted).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(F.shiftleft(both, 1))


def _embed(fp: np.ndarray) -> np.ndarray:
    low, one = np.uint64(LOW_BITS), np.uint64(1)
    return ((fp | (fp >> one)) & low) | ((fp & (fp >> one) & low) << one)


def grid_masks(bits: int, agree: int = 3) -> list[int]:
    """Masks over the packed embedding, one for each choice of `agree` of bits + agree groups of segments."""
    groups = bits + agree
    cuts = [round(32 * g / groups) for g in range(groups + 1)]
    parts = [sum(3 << (2 * s) for s in range(cuts[g], cuts[g + 1])) for g in range(groups)]
    return [sum(choice) for choice in combinations(parts, agree)]


def _tree(fp: np.ndarray, bits: int) -> list[np.ndarray]:
    """Links that connect what is connected in one cell, by breadth-first search, as arrays of shape (2, n): fewer links
    than fingerprints."""
    code, left, found = _embed(fp), np.arange(len(fp)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(code[left] ^ code[at]) <= bits
            near[near] = np.bitwise_count(fp[left[near]] ^ fp[at]) <= bits
            if near.any():
                new = left[near]
                found.append(np.stack([np.full(len(new), fp[at]), fp[new]]))
                queue.extend(new)
                left = left[~near]
    return found


def _split(fp: np.ndarray, bits: int) -> list[np.ndarray]:
    """Links of a cell of any size. A cell above LARGE_CELL is cut by a further exact grid over the segments in which its
    embeddings differ: of bits + 2 groups of them a linked pair agrees in two, so it shares one of the finer cells."""
    if len(fp) <= LARGE_CELL:
        return _tree(fp, bits)
    code = _embed(fp)
    differ = int(np.bitwise_or.reduce(code ^ code[0]))
    segments = [3 << (2 * s) for s in range(32) if differ >> (2 * s) & 3]
    if len(segments) < bits + 2:
        return _tree(fp, bits)
    found = []
    for a, b in combinations([sum(segments[g :: bits + 2]) for g in range(bits + 2)], 2):
        order = np.argsort(key := code & np.uint64(a | b), kind="stable")
        for part in np.split(fp[order], np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) > 1:
                found += _split(part, bits) if 2 * len(part) < len(fp) else _tree(part, bits)
    return found


def _cell_links(cell: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole cells; rows of one cell stand together."""
    edge = np.flatnonzero(np.diff(cell)) + 1
    starts = np.concatenate(([0], edge))
    sizes = np.diff(np.concatenate((starts, [len(cell)])))
    a, b = [], []
    small = np.repeat(sizes <= SMALL_CELL, sizes)
    for d in range(1, SMALL_CELL):
        i = np.flatnonzero((cell[:-d] == cell[d:]) & small[:-d]) if len(cell) > d else np.empty(0, dtype=np.int64)
        if not len(i):
            break
        i = i[np.bitwise_count(_embed(fp[i]) ^ _embed(fp[i + d])) <= bits]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= bits]
        a.append(fp[i])
        b.append(fp[i + d])
    for k in np.flatnonzero(sizes > SMALL_CELL):
        for pair in _split(fp[starts[k] : starts[k] + sizes[k]], bits):
            a.append(pair[0])
            b.append(pair[1])
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell; a cell that goes on in the next batch is kept back, 16 bytes a fingerprint."""
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def out(cell, fp):
            u, v = _cell_links(cell, fp, bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp"))
            fp = fp.view(np.uint64)
            last = np.searchsorted(cell, cell[-1])
            if last == 0 and kept and kept[-1][0][-1] == cell[-1]:
                kept.append((cell, fp))
                continue
            kept.append((cell[:last], fp[:last]))
            yield out(*(np.concatenate(x) for x in zip(*kept)))
            kept = [(cell[last:], fp[last:])]
        if kept:
            yield out(*(np.concatenate(x) for x in zip(*kept)))

    return run


def near_links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """distinct(fp) -> links (u, v) that connect all fingerprints joined by chains of at most `bits` differing bits.

    One shuffle of 35 rows of 16 bytes for each distinct fingerprint, sorted by cell inside its partitions: the same at
    every size. A cell is told by three of seven groups of segments, about 19 bits, so n unlike fingerprints meet n / 2**19
    others in each of the 35 grids: 7 comparisons a fingerprint for 10**5 of them, 7,000 for 10**8. Cells above LARGE_CELL
    fingerprints are cut further in memory, which divides that by about 20. A task holds a cell as 16 bytes a fingerprint.
    """
    cells = F.array(*[F.xxhash64(F.lit(i), F.col("_code").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(grid_masks(bits))])
    rows = distinct.withColumn("_code", embed(F.col("fp"))).select(F.explode(cells).alias("cell"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_links(bits), "u long, v long")


def near_duplicates(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """Every document with its fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    Equal fingerprints are one node from the start, so groups of copies cost nothing. Null and empty texts have
    fingerprint zero and link like any other; repeated rows stay; a row with a null doc_id gets its component's smallest
    doc_id (null if there is none); an empty table gives no rows; other columns are ignored.
    """
    docs = write_table(fingerprints(documents), "fingerprints")
    nodes = write_table(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "nodes")
    roots = write_table(components(near_links(nodes.select("fp"), bits)), "roots").withColumnRenamed("u", "fp")
    linked = nodes.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))
    named = roots.join(linked, "root").select("fp", F.col("first").alias("_joined"), F.lit(True).alias("_in"))
    ids = nodes.join(named, "fp", "left").select("fp", F.when(F.col("_in"), F.col("_joined")).otherwise(F.col("first")).alias("component_id"), "rows")
    total = nodes.agg(F.sum("rows")).first()[0] or 0
    whole = join_counted(docs, write_table(ids, "ids"), "fp", total)
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by similarity of 5-word shingles: the grids above and MinHash bands for candidates, exact Jaccard for links

SIMILAR_SHINGLE, SIMILAR_FIFTHS = 5, 4  # links have a Jaccard similarity of at least 4/5
#: A pair at 0.8 shares none of 20 bands of 5 with a chance of (1 - 0.8**5)**20 = 0.0004, at any number of rows.
BANDS, BAND_ROWS = 20, 5
_DRAW = np.random.default_rng(11).integers(0, 1 << 64, size=(2, BANDS * BAND_ROWS), dtype=np.uint64, endpoint=False)
_FLIP, _TIMES = _DRAW[0], _DRAW[1] | np.uint64(1)
HASH_BLOCK = 4096


def shingle_set(text: str | None, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct 5-word shingles (A-Z lower-cased); few words: the whole sequence; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts, stops = np.concatenate(([0], ends[: n - 1])).tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64))


def set_key(own: np.ndarray) -> int:
    """64-bit hash of a whole set, signed."""
    return _signed(xxhash.xxh64_intdigest(own.tobytes(), SEED))


def band_keys(own: np.ndarray) -> np.ndarray:
    """Keys of the MinHash bands of a set, signed."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(own), HASH_BLOCK):
        x = (own[at : at + HASH_BLOCK, None] ^ _FLIP) * _TIMES
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, x.min(axis=0), out=least)
    bands = least.reshape(BANDS, BAND_ROWS)
    return np.array([_signed(xxhash.xxh64_intdigest(b.tobytes(), i)) for i, b in enumerate(bands)], dtype=np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, prints, bands = [], [], [], []
        for x in batch.column("text"):
            own = shingle_set(text := x.as_py())
            keys.append(set_key(own))
            sizes.append(len(own))
            prints.append(_signed(fingerprint(text)))
            bands.append(band_keys(own))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands) if bands else np.empty(0, dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), lists], ["doc_id", "k", "n", "fp", "bands"])


PARITY_BITS = 1024


def parity(own: np.ndarray) -> np.ndarray:
    """For each of PARITY_BITS places whether an odd number of shingles falls on it, as 64-bit integers. Two sets differ in
    at least as many shingles as their parities differ in places."""
    odd = np.bincount((own & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_sets(keys: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(k, shingles, parity): the sets of the given nodes, taken again from the whole text of one document each."""
    ids = nodes.join(keys, "k", "left_semi").select("k", F.col("id").alias("doc_id"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [(k, x) for k, t in zip(part.column("k").to_pylist(), part.column("text")) if set_key(x := shingle_set(t.as_py())) == k]  # rows that share a doc_id but not the text go
                lists = pa.array([x.view(np.int64) for _, x in sets], pa.list_(pa.int64()))
                odd = pa.array([parity(x) for _, x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], pa.int64()), lists, odd], ["k", "shingles", "parity"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").select("k", "text")
    return write_table(texts.mapInArrow(own, "k long, shingles array<long>, parity array<long>").groupBy("k").agg(F.first("shingles").alias("shingles"), F.first("parity").alias("parity")), "sets")


def grid_pairs(signatures: DataFrame, bits: int = BITS) -> DataFrame:
    """Candidate pairs (u, v) of set keys from the fingerprints of near_duplicates: its links between fingerprints at most
    `bits` bits apart, each end the smallest set of its fingerprint, and the other sets of a fingerprint with its smallest.

    signatures: k, n, fp; sets without shingles take no part. As many pairs as links, whatever the size of a crowd."""
    prints = write_table(signatures.where("n > 0").select("k", "fp").distinct(), "prints")
    ends = write_table(prints.groupBy("fp").agg(F.min("k").alias("hub"), F.count(F.lit(1)).alias("rows")), "ends")
    same = join_counted(prints, ends, "fp", prints.count()).where("k <> hub").select(F.col("hub").alias("u"), F.col("k").alias("v"))
    end = lambda c: ends.select(F.col("fp").alias(c), F.col("hub").alias(f"_{c}"))
    links = write_table(near_links(ends.select("fp"), bits).distinct(), "grid-links")
    apart = links.join(end("u"), "u").join(end("v"), "v").where("_u <> _v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
    return same.unionByName(apart).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of set keys whose sets have a Jaccard similarity of 0.8 or more."""
    right = pairs.join(sets.select(F.col("k").alias("v"), F.col("shingles").alias("_v")), "v")
    both = right.join(sets.select(F.col("k").alias("u"), F.col("shingles").alias("_u")), "u")
    counted = both.select("u", "v", F.size(F.array_intersect("_u", "_v")).alias("both"), (F.size("_u") + F.size("_v")).alias("all"))
    return counted.where(5 * F.col("both") >= SIMILAR_FIFTHS * (F.col("all") - F.col("both"))).select("u", "v")


def prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) with u < v between stray members and members of other groups: all that can be similar.

    members: k, n, group, stray. Shingles are ordered by how many members hold them, the rarest first. Sets with a
    similarity of 0.8 share one of the first n - ceil(0.8 n) + 1, their first common shingle leaves enough behind it on
    both sides, and they differ in at most a ninth of their shingles, so their parities do not differ in more places. All
    three are tested inside the join. Near copies that differ from one another begin with shingles of their own, so a
    crowd of them gives few pairs, where their bands would give all.
    """
    held = sets.join(members, "k").select("k", "n", "group", "stray", F.explode("shingles").alias("s"))
    counts = held.groupBy("s").agg(F.count(F.lit(1)).alias("_c"))
    first = (F.col("n") - F.floor((F.col("n") * SIMILAR_FIFTHS + 4) / 5) + 1).cast("int")
    ordered = held.join(counts, "s").groupBy("k", "n", "group", "stray").agg(F.array_sort(F.collect_list(F.struct("_c", "s"))).alias("_own"))
    each = ordered.join(sets.select("k", "parity"), "k").select("k", "n", "group", "stray", "parity", F.posexplode(F.slice("_own", F.lit(1), first)).alias("at", "_t"))
    rows = write_table(each.select("k", "n", "group", "stray", "parity", "at", "_t.s"), "prefixes")
    asks = rows.where("stray").select("s", F.col("k").alias("a"), F.col("n").alias("an"), F.col("group").alias("ag"), F.col("at").alias("aat"), F.col("parity").alias("ap"))
    left = F.least(F.col("n") - F.col("at"), F.col("an") - F.col("aat"))
    enough = (5 + SIMILAR_FIFTHS) * left >= SIMILAR_FIFTHS * (F.col("n") + F.col("an"))
    differ = F.aggregate(F.zip_with("parity", "ap", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    alike = (5 + SIMILAR_FIFTHS) * differ <= F.col("n") + F.col("an")
    return rows.join(asks, (rows["s"] == asks["s"]) & (F.col("group") != F.col("ag")) & enough & alike).select(F.least("a", "k").alias("u"), F.greatest("a", "k").alias("v")).distinct()


def similar_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, component_id) of rows with a doc_id: groups of documents joined by chains of links, where each link has a
    Jaccard similarity of 5-word shingle sets of at least 0.8, checked exactly.

    Candidates come from the grids of near_duplicates (grid_pairs), whose trees connect a crowd of near copies by few pairs.
    Its 4 of 64 bits miss most pairs near 0.8, so candidates also share a MinHash band; the bands are the same at every size
    and hold 0.9996 of the pairs at 0.8. Equal sets are one node. First the grids' pairs are checked, and every node against
    the smallest node of each of its bands; then, in bands that still hold more than one group, the nodes outside the group
    of the smallest are compared with the nodes of other groups through the rare shingles they share. Only pairs that sizes
    or shingles rule out, or whose ends are joined already, are left unchecked.
    """
    named = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = write_table(named.mapInArrow(_signatures, "doc_id long, k long, n long, fp long, bands array<long>"), "signatures")
    nodes = write_table(docs.groupBy("k").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows")), "nodes")
    cells = nodes.where("n > 0").select("k", "n", F.explode("bands").alias("cell"))
    hubs = cells.groupBy("cell").agg(F.min(F.struct("k", "n")).alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("cell", F.col("hub.k").alias("hub"), F.col("hub.n").alias("hub_n"))
    shared = write_table(cells.join(hubs, "cell"), "cells")  # bands that two nodes or more share
    sizes_allow = 5 * F.least("n", "hub_n") >= SIMILAR_FIFTHS * F.greatest("n", "hub_n")
    banded = shared.where(F.col("k") != F.col("hub")).where(sizes_allow).select(F.col("hub").alias("u"), F.col("k").alias("v"))
    first = write_table(banded.unionByName(grid_pairs(docs)).distinct(), "pairs")
    asked = shared.select("k").unionByName(first.select(F.explode(F.array("u", "v")).alias("k"))).distinct()
    sets = shingle_sets(asked, nodes, documents)
    links = write_table(verified(first, sets), "similar")
    roots = write_table(components(links), "roots").select(F.col("u").alias("k"), "root")

    root = lambda c, to: roots.select(F.col("k").alias(c), F.col("root").alias(to))
    placed = shared.join(root("k", "_r"), "k", "left").join(root("hub", "_h"), "hub", "left").select("cell", "k", "n", F.coalesce("_r", "k").alias("group"), F.coalesce("_h", "hub").alias("hub_group"))
    placed = write_table(placed.withColumn("stray", F.col("group") != F.col("hub_group")), "placed")
    open_cells = placed.where("stray").select("cell").distinct()
    members = write_table(placed.join(open_cells, "cell", "left_semi").groupBy("k", "n", "group").agg(F.max("stray").alias("stray")), "members")
    second = prefix_pairs(members, sets).join(first, ["u", "v"], "left_anti")
    more = write_table(verified(write_table(second, "pairs"), sets), "similar")

    roots = write_table(components(links.unionByName(more)), "roots").select(F.col("u").alias("k"), "root")
    grouped = write_table(nodes.select("k", "id", "rows").join(roots, "k", "left").select("k", "id", "rows", F.coalesce("root", "k").alias("root")), "groups")
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    placed = join_counted(grouped, least, "root", nodes.count(), "nodes")
    ids = write_table(placed.select("k", "component_id", "rows"), "ids")
    return join_counted(docs.select("doc_id", "k"), ids, "k", docs.count()).select("doc_id", "component_id")


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, with all its columns. Documents
    without doc_id stay; of repeated rows with one doc_id one stays."""
    first = similar_groups(documents).where("doc_id = component_id").select("doc_id").distinct()
    named = documents.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(documents.where("doc_id is null")).select(*documents.columns)
