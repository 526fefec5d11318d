"""Alignment of two tokenizers over the bytes of each text, by merge-path partitioning.

The token ends of encodings A and B are two sorted lists. Merging them walks through the overlaps of A tokens with B
tokens, one a step; where both lists hold the same end, an A and a B token end together. Diagonals of the merge, found by
binary search, cut it into pieces of equally many steps that need nothing from one another: a piece gives its overlaps, and
an end that two pieces share is stitched from the last step of one and the first of the next.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import write_table
from .spiece import MODEL as PIECE_MODEL
from .spiece import decoder_table, load_model

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how the byte-level model cuts a text before merging.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STEPS = 1 << 14  # merge steps of a piece
BATCH_BYTES, RENDER_GROUPS = 2 << 20, 1 << 18
ID_BITS = 17  # ids of both vocabularies fit; a pair of ids is a << ID_BITS | b
HOT_SHARE = 1 << 19  # pairs with more than 1 / HOT_SHARE of all links are looked up in tasks: fewer than HOT_SHARE pairs
HELD_PAIRS = 4 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(odd)}


def load_byte_model(path: str = BYTE_MODEL) -> list[bytes]:
    """Bytes of each id of a byte-level BPE file, read on the driver. Refused: other kinds, and vocabularies whose ids are
    not in the order of their merges (the ids then tell nothing about what merges first)."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, cut = found["model"], found.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or found.get("normalizer") or model.get("dropout"):
        raise ValueError("only plain byte-level BPE models are encoded here")
    letters, special = byte_letters(), {t["content"] for t in found["added_tokens"]}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][m] for m in made]
    if order != sorted(order):
        raise ValueError("ids are not in the order of merges")
    table = [b""] * (max(model["vocab"].values()) + 1)
    for token, i in model["vocab"].items():
        table[i] = b"" if token in special else bytes(letters[c] for c in token)
    return table


def diagonals(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """Where the merge of two sorted lists stands after 0, steps, 2 * steps, ... elements: how many are from a, where a's
    come first on ties. One binary search a diagonal, all of them at once."""
    d = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        i = np.where(open_, (low + high) // 2, 0)
        taken = np.zeros(len(d), dtype=bool)  # does a[i] come before b[d - 1 - i]?
        taken[open_] = a[i[open_]] <= b[(d - 1 - i)[open_]]
        low = np.where(open_ & taken, i + 1, low)
        high = np.where(open_ & ~taken, i, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps of one piece: (ends, A tokens, B tokens), an entry a step, tokens counted from the piece's first. A step
    whose end is that of the step before overlaps nothing: there an A and a B token end together."""
    both = np.concatenate((a, b))
    order = np.argsort(both, kind="stable")  # two runs, merged; a's first on ties
    of_a = order < len(a)
    before_a = np.cumsum(of_a) - of_a
    return both[order], before_a, np.arange(len(both)) - before_a


def shared_ends(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(A tokens, B tokens) that end together, in order, for strictly rising ends a and b."""
    cut = diagonals(a, b, steps)
    at = np.minimum(np.arange(len(cut)) * steps, len(a) + len(b))
    out_a, out_b, last = [], [], -1
    for i, j, d0, d1 in zip(cut[:-1].tolist(), cut[1:].tolist(), at[:-1].tolist(), at[1:].tolist()):
        ends, own_a, own_b = overlaps(a[i:j], b[d0 - i : d1 - j])
        if not len(ends):
            continue
        # a step that ends where the one before it did consumes a B token; its A token is the one consumed before it
        same = np.flatnonzero(ends[1:] == ends[:-1]) + 1
        if ends[0] == last:  # stitched: the A token was the last step of the piece before
            same = np.concatenate(([0], same))
        out_a.append(i + own_a[same] - 1)
        out_b.append(d0 - i + own_b[same])
        last = ends[-1]
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def number_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For ids below n: (their decimal digits in bytes 1 to 7 of a 64-bit word, how many)."""
    text = [str(i).encode() for i in range(n)]
    words = np.frombuffer(b"".join(b"\0" + t.ljust(7, b"\0") for t in text), dtype="<u8")
    return words, np.fromiter(map(len, text), dtype=np.int64, count=n)


def rendered(a_ids: np.ndarray, b_ids: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, numbers: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """`;a1,a2|b1;a3|b2,b3`: the groups that close at the given token places (counted from a_ids[0] and b_ids[0]), each
    with a semicolon before it; and where each group ends in these bytes."""
    digits, wide = numbers
    n_a, n_b, groups = len(a_ids), len(b_ids), len(ends_a)
    first_a, first_b = np.concatenate(([0], ends_a[:-1] + 1)), np.concatenate(([0], ends_b[:-1] + 1))
    group_a = np.repeat(np.arange(groups), ends_a - first_a + 1)
    group_b = np.repeat(np.arange(groups), ends_b - first_b + 1)
    words = np.empty(n_a + n_b, dtype=np.uint64)
    sep_a, sep_b = np.full(n_a, ord(","), dtype=np.uint64), np.full(n_b, ord(","), dtype=np.uint64)
    sep_a[first_a], sep_b[first_b] = ord(";"), ord("|")
    words[np.arange(n_a) + first_b[group_a]] = digits[a_ids] | sep_a
    words[np.arange(n_b) + ends_a[group_b] + 1] = digits[b_ids] | sep_b
    letters = words.view(np.uint8)
    size_a, size_b = np.concatenate(([0], np.cumsum(wide[a_ids] + 1))), np.concatenate(([0], np.cumsum(wide[b_ids] + 1)))
    return letters[letters != 0].tobytes(), size_a[ends_a + 1] + size_b[ends_b + 1]


class Aligner:
    """Both encoders and the tables of their ids, one in each Python worker."""

    def __init__(self, byte_table: list[bytes], piece_table: list[bytes], piece_model: bytes):
        import sentencepiece
        import tiktoken

        self.tables = [byte_table, piece_table]
        if max(map(len, self.tables)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies of more than {1 << ID_BITS} ids are not aligned here")
        ranks = {t: i for i, t in enumerate(byte_table) if t}
        self.a = tiktoken.Encoding("byte_level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.lengths = [np.fromiter(map(len, t), dtype=np.int64, count=len(t)) for t in self.tables]
        self.bytes = [pa.array(t, pa.large_binary()) for t in self.tables]
        self.numbers = number_table(max(map(len, self.tables)))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: (ids of all texts in a row, how many each text has). A reads a space and the text, B adds its own."""
        a = [self.a.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        b = self.b.encode(texts, out_type=int, num_threads=1) if texts else []
        sizes = [np.fromiter(map(len, x), dtype=np.int64, count=len(texts)) for x in (a, b)]
        joined = np.concatenate(a).astype(np.int64) if a else np.empty(0, dtype=np.int64)
        return [(joined, sizes[0]), (np.fromiter(chain.from_iterable(b), dtype=np.int64, count=int(sizes[1].sum())), sizes[1])]

    def faithful(self, texts: list[str], coded: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which texts' tokens, joined, are a space and the text, in A and in B."""
        own = [b" " + t.encode() for t in texts]
        whole, good = b"".join(own), np.ones(len(texts), dtype=bool)
        for (ids, sizes), table, lengths in zip(coded, self.bytes, self.lengths):
            data = table.take(pa.array(ids)).buffers()[2]
            data = data.to_pybytes()[: int(lengths[ids].sum())] if data is not None else b""
            places = np.concatenate(([0], np.cumsum(lengths[ids])))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
            if data != whole or places[1:] != np.cumsum(list(map(len, own))).tolist():
                good &= np.fromiter((data[x:y] == t for x, y, t in zip(places, places[1:], own)), dtype=bool, count=len(own))
        return good

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray | list], np.ndarray, np.ndarray, np.ndarray]:
        """Columns a text, and the distinct pairs of ids that end together with how often they do: (pairs, times, and where
        each text's begin)."""
        coded = self.encode(texts)
        good = self.faithful(texts, coded) & np.fromiter((len(t) > 0 for t in texts), dtype=bool, count=len(texts))
        coded = [(ids[np.repeat(good, sizes)], np.where(good, sizes, 0)) for ids, sizes in coded]
        (a_ids, n_a), (b_ids, n_b) = coded
        ends_a, ends_b = shared_ends(np.cumsum(self.lengths[0][a_ids]), np.cumsum(self.lengths[1][b_ids]))
        doc = np.searchsorted(np.cumsum(n_a), ends_a, side="right")
        n_groups = np.bincount(doc, minlength=len(texts))
        key = (doc << (2 * ID_BITS)) | (a_ids[ends_a] << ID_BITS) | b_ids[ends_b]
        kinds, times = np.unique(key, return_counts=True)
        starts = np.searchsorted(kinds, np.arange(len(texts) + 1) << (2 * ID_BITS))
        columns = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": self.digests(a_ids, b_ids, ends_a, ends_b, doc, good)}
        return columns, kinds & ((1 << (2 * ID_BITS)) - 1), times, starts

    def digests(self, a_ids, b_ids, ends_a, ends_b, doc, good) -> list[str]:
        """Digest of each text's groups; groups are written RENDER_GROUPS at a time, whatever the length of a text."""
        hashes = [hashlib.sha256() if g else None for g in good.tolist()]
        begun = [False] * len(hashes)
        a0 = b0 = 0
        for at in range(0, len(ends_a), RENDER_GROUPS):
            ea, eb, own = ends_a[at : at + RENDER_GROUPS], ends_b[at : at + RENDER_GROUPS], doc[at : at + RENDER_GROUPS]
            data, places = rendered(a_ids[a0 : ea[-1] + 1], b_ids[b0 : eb[-1] + 1], ea - a0, eb - b0, self.numbers)
            a0, b0 = int(ea[-1]) + 1, int(eb[-1]) + 1
            last = np.append(np.flatnonzero(np.diff(own)), len(own) - 1)
            start = 0
            for k, stop in zip(own[last].tolist(), places[last].tolist()):
                hashes[k].update(data[start + (not begun[k]) : stop])  # no semicolon before a text's first group
                begun[k], start = True, stop
        return [h.hexdigest() if h else "" for h in hashes]


def worker_aligner(byte_table: list[bytes], piece_table: list[bytes], piece_model: bytes) -> Aligner:
    """One aligner for each Python worker and pair of models."""
    state = sys.modules.setdefault("finsignal_worker_aligner", ModuleType("finsignal_worker_aligner"))
    key = hashlib.sha256(b"\0".join(byte_table) + piece_model).hexdigest()
    if getattr(state, "key", None) != key:
        state.key, state.aligner = key, Aligner(byte_table, piece_table, piece_model)
    return state.aligner


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows of about BATCH_BYTES characters together; a longer text alone."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > BATCH_BYTES:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"


def align_texts(documents: DataFrame, byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> DataFrame:
    """Each whole text encoded twice and aligned: counts, the digest of its groups, and the distinct pairs of ids that end
    together (a << 17 | b) with how often they do. Written once. No shuffle; the models are read on the driver."""
    byte_table, piece_table = load_byte_model(byte_path), decoder_table(load_model(piece_path))
    with open(piece_path, "rb") as f:
        piece_model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(byte_table, piece_table, piece_model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, stop in _blocks(list(map(len, texts))):
                columns, pairs, times, starts = aligner.align(texts[start:stop])
                part = batch.slice(start, stop - start)
                places = pa.array(starts.astype(np.int32))
                lists = [pa.ListArray.from_arrays(places, pa.array(pairs)), pa.ListArray.from_arrays(places, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *[pa.array(columns[c]) for c in ("n_a", "n_b", "n_groups", "groups_sha256")], *lists], [f.split()[0] for f in ALIGNED.split(", ")])

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return write_table(rows.mapInArrow(run, ALIGNED), "aligned")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): sums over a task, HELD_PAIRS entries at a time."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        pairs, times = (np.concatenate(x) for x in zip(*held))
        kinds, at = np.unique(pairs, return_inverse=True)
        return kinds, np.bincount(at, weights=times, minlength=len(kinds)).astype(np.int64)

    for batch in batches:
        pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
        held.append((pairs, times.astype(np.int64)))
        size += len(pairs)
        if size > HELD_PAIRS:
            held = [out()]
            size = len(held[0][0])
            if size > HELD_PAIRS // 2:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["pair", "n"])
                held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, out())), ["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus each pair of ids has, and whether no pair with the same B id has more.
    Summed in the tasks before the shuffle; the highest counts by B id are a table of one row an id."""
    counts = write_table(aligned.select("pairs", "times").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return write_table(counts.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-ranks")


def align(documents: DataFrame, byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (all long) and groups_sha256 for every row.

    A is the byte-level model over a space and the text, B the piece model, which adds the space; control strings inside
    texts are plain text. Null and empty texts, and texts whose joined tokens are not a space and the text (for one, a
    space mark U+2581 inside it), have no tokens: zeros and ''. Repeated rows each count; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored.

    Pairs that hold more than 1 / HOT_SHARE of all links, fewer than HOT_SHARE, are looked up inside the tasks; all rarer
    ones meet their counts by a shuffle. Work in a task is bounded by one text: its ids, 8 bytes a token and encoding.
    """
    aligned = align_texts(documents, byte_path, piece_path)
    counts = pair_counts(aligned)
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = total // HOT_SHARE
    hot = counts.where(F.col("n") > least).orderBy("pair").toArrow()
    hot_pair, hot_n, hot_best = (hot.column(c).to_numpy() for c in ("pair", "n", "best"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            own = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(hot_pair, pairs), max(len(hot_pair) - 1, 0))
            found = hot_pair[at] == pairs if len(hot_pair) else np.zeros(len(pairs), dtype=bool)
            n, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=bool)
            n[found], best[found] = hot_n[at[found]], hot_best[at[found]]
            edge = np.concatenate(([0], np.cumsum(sizes)))
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[edge]) for x in (times * best, times * n)]
            rest = np.concatenate(([0], np.cumsum(~found)))[edge].astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x)) for x in (pairs[~found], times[~found])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")], *map(pa.array, sums), *left], [f.split()[0] for f in shape.split(", ")])

    shape = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"
    partly = write_table(aligned.mapInArrow(known, shape), "aligned-hot")
    rare = partly.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    added = rare.join(counts.where(F.col("n") <= least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    whole = partly.drop("pairs", "times").join(added, "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
