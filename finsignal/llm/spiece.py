"""SentencePiece encoding and decoding with a streaming Viterbi search.

The lattice has a node for each boundary between characters and an arc for each piece. The model at hand is of kind BPE,
where an arc may follow another only if merging the two pieces' characters gives exactly these two pieces (score 0, else
minus infinity). With these transition scores one arc at most survives at each boundary, and the surviving path is what
BPE merging gives, so ids equal the model's own encoding. The search keeps the boundaries of the last longest-piece
characters; whenever all their backpointer paths meet in one boundary, ids up to it are committed and forgotten. Texts
are read once, from left to right, in memory bounded by the window and a cache of short words.

Places that no piece of the vocabulary crosses are boundaries where all paths meet whatever stands around them, so the
search commits there without looking: a text is cut at them, and the ids of short stretches are kept in the cache. The
search itself runs in stretches that are new or long, and commits inside a stretch every COMMIT_EVERY characters.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Where no piece can cross, paths always meet: before a space mark that follows another character, and between letters
#: and other characters (word_pattern checks the vocabulary for the latter).
COARSE = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
OTHER = "\x00-@\\[-`{-¿\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff1f"  # ASCII and common marks that are no letters
FINE = re.compile(f"{SPACE}*[^{SPACE}{OTHER}]+|{SPACE}*[{OTHER}]+|{SPACE}+")
CACHE_WORDS, CACHE_PAIRS, CACHE_CHARS, COMMIT_EVERY = 150_000, 300_000, 40, 256


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def load_model(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds (1 normal, 2 unknown, 3 control, 6 byte) of a model file, read on the driver.

    The lattice stands for BPE models with byte fallback that leave texts as they are but for spaces. A model of another
    kind, with another normaliser, or with user-defined or unused pieces is refused with a ValueError.
    """
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, 1))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    # Field numbers of the model format and their defaults.
    kind = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}.get(trainer.get(3, 1), "unknown")
    if kind != "bpe":
        raise ValueError(f"a model of kind {kind}: only bpe models are encoded here")
    if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
        raise ValueError("only models that keep texts as they are, with a space before the first word, are encoded here")
    if odd := {k for k in kinds if k not in (1, 2, 3, 6)}:
        raise ValueError(f"pieces of kinds {sorted(odd)} (4: user-defined, 5: unused) are not encoded here")
    if kinds.count(6) != 256:
        raise ValueError("only models with byte fallback are encoded here")
    return pieces, scores, kinds


def model_key(model: tuple[list[str], list[float], list[int]]) -> str:
    """A digest of all pieces, scores and kinds of a model."""
    return hashlib.sha256(repr(model).encode("utf-8", "surrogatepass")).hexdigest()


def word_pattern(pieces: list[str]) -> re.Pattern:
    """The finest split of marked text that no piece of the vocabulary crosses."""
    for pattern in (FINE, COARSE):
        if all(len(pattern.findall(p)) == 1 for p in pieces):
            return pattern
    return re.compile("(?s).+")


class Encoder(dict):
    """word -> ids as int32 bytes, filled as words come up; emptied when it holds CACHE_WORDS words."""

    def __init__(self, model: tuple[list[str], list[float], list[int]]):
        pieces, scores, kinds = model
        self.piece_id = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 1}
        self.rank = {p: (-scores[i], i) for p, i in self.piece_id.items()}
        self.worst = (float("inf"), 0)
        self.longest = max(map(len, self.piece_id), default=1)
        self.words = word_pattern(list(self.piece_id))
        self.endings: dict = {}  # trie of pieces read from their last character; '' holds the piece itself
        for piece in self.piece_id:
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
        self.follows: dict[tuple[str | None, str], bool] = {}
        self.older: dict[str, bytes] = {}
        self.table = decoder_table(model)

    def merged(self, chars: str) -> list[str]:
        """What merging gives for a short string: the best-ranked neighbours first, the leftmost on ties."""
        parts, rank, none = list(chars), self.rank, self.worst
        ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) is not none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], none)
        return parts

    def may_follow(self, before: str | None, piece: str) -> bool:
        """Transition score of the lattice: may `piece` stand after `before` (None: at the start)?"""
        if before is None:
            found = self.merged(piece) == [piece]
        elif before not in self.piece_id or piece not in self.piece_id:
            found = True  # an unknown character merges with nothing
        else:
            found = self.merged(before + piece) == [before, piece]
        if len(self.follows) > CACHE_PAIRS:
            self.follows.clear()
        self.follows[before, piece] = found
        return found

    def _ids(self, piece: str) -> list[int]:
        own = self.piece_id.get(piece)
        return [own] if own is not None else [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]

    def _advance(self, chars: str, last: dict[int, str | None], at: int) -> None:
        """Find the arc that survives at boundary `at`: longer pieces first; a lone character always has an arc."""
        node, arcs, start = self.endings, [], at
        while start > 0 and (node := node.get(chars[start - 1])) is not None:
            start -= 1
            if "" in node and start in last:
                arcs.append((start, node[""]))
        if not arcs and at - 1 in last:
            arcs = [(at - 1, chars[at - 1])]
        follows = self.follows
        for start, piece in reversed(arcs):
            before = last[start]
            ok = follows.get((before, piece))
            if self.may_follow(before, piece) if ok is None else ok:
                last[at] = piece
                return

    def stream(self, chars: str) -> Iterator[list[int]]:
        """Committed ids of one stretch, in order."""
        last: dict[int, str | None] = {0: None}  # boundary -> surviving arc that ends there
        done = 0
        for at in range(1, len(chars) + 1):
            self._advance(chars, last, at)
            if at - done >= COMMIT_EVERY:
                live = {b for b in range(max(done, at - self.longest + 1), at + 1) if b in last}
                while len(live) > 1:
                    top = max(live)
                    live.discard(top)
                    live.add(top - len(last[top]))
                meet = live.pop()
                if meet > done:
                    yield self._path(last, done, meet)
                    last = {b: p for b, p in last.items() if b >= meet}
                    done = meet
        if len(chars) > done:
            yield self._path(last, done, len(chars))

    def _path(self, last: dict, start: int, end: int) -> list[int]:
        parts = []
        while end > start:
            parts.append(last[end])
            end -= len(last[end])
        return [i for p in reversed(parts) for i in self._ids(p)]

    def _short(self, chars: str) -> bytes:
        """The same search over a stretch too short for a commit before its end, in one loop."""
        root, follows, may_follow = self.endings, self.follows, self.may_follow
        last: list[str | None] = [None] * (len(chars) + 1)
        live = [True] + [False] * len(chars)
        for at in range(1, len(chars) + 1):
            node, start, arcs = root, at, []
            while start:
                start -= 1
                node = node.get(chars[start])
                if node is None:
                    break
                if live[start] and "" in node:
                    arcs.append((start, node[""]))
            if not arcs and live[at - 1]:
                arcs.append((at - 1, chars[at - 1]))
            while arcs:
                start, piece = arcs.pop()
                pair = last[start], piece
                ok = follows.get(pair)
                if may_follow(*pair) if ok is None else ok:
                    last[at] = piece
                    live[at] = True
                    break
        parts, end, known = [], len(chars), self.piece_id
        while end:
            parts.append(last[end])
            end -= len(last[end])
        ids = [known[p] for p in reversed(parts)] if all(p in known for p in parts) else [i for p in reversed(parts) for i in self._ids(p)]
        return struct.pack(f"<{len(ids)}i", *ids)

    def _encode(self, word: str) -> bytes:
        if len(word) < COMMIT_EVERY:
            return self._short(word)
        return b"".join(struct.pack(f"<{len(ids)}i", *ids) for ids in self.stream(word))

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHE_CHARS:
            return self._encode(word)
        if len(self) >= CACHE_WORDS:  # keep one older generation, so that frequent words stay
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        self[word] = value = self._encode(word) if value is None else value
        return value

    def packed(self, text: str) -> bytes:
        """Ids of a text as int32 bytes, with the mark of a space before its first character; a space mark in the text
        itself is written as its bytes, so that decoding gives it back. Empty text: no ids."""
        if not text:
            return b""
        out = []
        for n, part in enumerate(text.split(SPACE)):
            if n:
                out.append(np.array([self.byte_id[b] for b in SPACE.encode()], dtype=np.int32).tobytes())
            marked = part.replace(" ", SPACE)
            out.extend(map(self.__getitem__, self.words.findall(marked if n else SPACE + marked)))
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return np.frombuffer(self.packed(text), dtype=np.int32)


def worker_encoder(model: tuple[list[str], list[float], list[int]]) -> Encoder:
    """One encoder for each Python worker and whole model, so that tasks after the first find its caches filled."""
    state = sys.modules.setdefault("finsignal_worker_state", ModuleType("finsignal_worker_state"))
    key = model_key(model)
    if getattr(state, "key", None) != key:
        state.key, state.encoder = key, Encoder(model)
    return state.encoder


def decoder_table(model: tuple[list[str], list[float], list[int]]) -> list[bytes]:
    """Bytes of each id: byte pieces are their byte, control and unknown pieces nothing, space marks spaces."""
    out = []
    for piece, kind in zip(model[0], model[2]):
        out.append(bytes([int(piece[3:5], 16)]) if kind == 6 else piece.replace(SPACE, " ").encode() if kind == 1 else b"")
    return out


def decode_ids(ids: list[int], table: list[bytes]) -> str:
    """Text of ids: one leading space goes; bytes that are no UTF-8 become replacement characters."""
    data = b"".join(map(table.__getitem__, ids))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def come_back(ids: np.ndarray, sizes: np.ndarray, pieces: pa.LargeBinaryArray, texts: list[str]) -> list[bool]:
    """Does each text's share of the ids, decoded, equal the whole text? All ids of a batch are looked up at once."""
    taken = pieces.take(pa.array(ids))
    data = taken.buffers()[2]
    places = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset :]
    ends = places[np.cumsum(sizes)].tolist()
    out, start = [], int(places[0])
    for end, text in zip(ends, texts):
        own = data[start:end].to_pybytes() if end > start else b""
        out.append((own[1:] if own[:1] == b" " else own) == text.encode("utf-8", "surrogatepass"))
        start = end
    return out


def encode(documents: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens long, ids array<int>, exact boolean (decoding gives the text back) for every whole text.

    The ids of every row are decoded again and compared with its whole text, so `exact` depends on that row alone.

    Null and empty texts have no ids and are exact (null counts as empty). Repeated rows are each encoded; an empty table
    gives no rows; other columns are ignored. One pass in Arrow batches, no shuffle; the model file is read on the driver
    and its pieces go along with the tasks.
    """
    model = load_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model)
        pieces = pa.array(encoder.table, pa.large_binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [x or "" for x in part.column("text").to_pylist()]
                found = [encoder.packed(text) for text in texts]
                sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
                ids = np.frombuffer(b"".join(found), dtype=np.int32)
                exact = come_back(ids, sizes, pieces, texts)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), lists, pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "ids", "exact"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, exact boolean")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text: encoded ids (doc_id, ids) back to text. Null ids: empty text."""
    model = load_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder_table(model)
        for batch in batches:
            texts = [decode_ids(ids.as_py() or [], table) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
