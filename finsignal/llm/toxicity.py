"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Training (driver, on a bounded sample of labelled documents, see the parameters of fit):

1. Word features (the word, its first letters, its last letters) whose documents are toxic far beyond chance name the
   toxic words of toxic documents; that labels the tokens.
2. A chain with labels clean and toxic is trained by gradient ascent on the conditional likelihood (forward-backward).
3. A logistic curve turns a document's largest toxic marginals, twelve at most, into a score.

Scoring runs over every word of every text in Arrow batches. A word whose marginal cannot reach FLOOR whatever its
neighbours are adds nothing, so documents without any other word need no forward-backward pass; all others get one over
the whole text. Scores see texts only.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 18
FLOOR = 1e-3
CACHE_WORDS = 80_000
SPAN_AT = 0.5
TOP = 12  # words that a document is judged by
SEGMENT = 48


def word_features(word: str) -> list[str]:
    w = word.lower()
    return [f"w={w}", *(f"p={w[:n]}" for n in (3, 4, 5) if len(w) >= n), f"s={w[-3:]}"]


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class Chain:
    """Weights of the label `toxic` against `clean`: by feature bucket, and of transitions [before, now]."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    curve: tuple[float, float, float]

    def emission(self, word: str) -> float:
        return self.bias + float(sum(self.weights[_bucket(f)] for f in word_features(word)))

    def cut(self) -> float:
        """Emissions below this cannot give a marginal of FLOOR, whatever stands around."""
        m = self.moves
        gain = max(m[0, 1] - m[0, 0], m[1, 1] - m[1, 0]) + max(0.0, m[1, 0] - m[0, 0], m[1, 1] - m[0, 1])
        return math.log(FLOOR / (1 - FLOOR)) - gain

    def marginals(self, emissions: list[float]) -> list[float]:
        """Probability of `toxic` for each word of one text, by forward-backward in log odds."""
        (a, b), (c, d) = np.exp(self.moves).tolist()
        exp, odds = [min(math.exp(min(e, 300.0)), 1e100) for e in emissions], []
        r = 0.0
        for x in exp:  # r: odds of the forward message of the word before
            r = x * (b + d * r) / (a + c * r) if odds else x
            odds.append(r)
        back = 1.0
        out = [0.0] * len(exp)
        for i in range(len(exp) - 1, -1, -1):
            o = odds[i] * back
            out[i] = o / (1 + o) if o < 1e300 else 1.0
            back = (c + d * exp[i] * back) / (a + b * exp[i] * back)
        return out

    def score(self, marginals: list[float]) -> float:
        total, most = evidence(marginals)
        a, b, c = self.curve
        z = a + b * math.log1p(total) + c * most
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def evidence(marginals: list[float]) -> tuple[float, float]:
    """Sum of the TOP largest marginals of FLOOR or more, and the largest: the same for a text of any length, so that many
    small marginals of a long text never add up to a toxic one."""
    heavy = nlargest(TOP, (m for m in marginals if m >= FLOOR))
    return sum(heavy), (heavy[0] if heavy else 0.0)


def _surprise(hit: int, miss: int, share: float) -> float:
    """n * KL(hit / n || share) for a share of hits above `share`, else 0: log of how far beyond chance."""
    n = hit + miss
    p = hit / n
    if p <= share:
        return 0.0
    return n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def toxic_features(texts: list[list[str]], toxic: list[bool], least: int = 3, purity: float = 0.9, chance: float = 0.01) -> set[str]:
    """Features that mark toxic documents: first those whose documents are toxic far beyond chance (Bonferroni over all
    features); then, for documents still without one, features that recur inside their toxic documents."""
    seen: tuple[Counter, Counter] = Counter(), Counter()
    often: Counter = Counter()
    held: list[Counter] = []
    for words, bad in zip(texts, toxic):
        own: Counter = Counter()
        for w, n in Counter(x.lower() for x in words).items():
            for f in word_features(w):
                own[f] += n
        seen[bad].update(own.keys())
        if bad:
            held.append(own)
            for f, n in own.items():
                often[f] += min(n, 8)
    n1, n0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    share = n1 / (n1 + n0)
    pure = {f: c for f, c in seen[1].items() if c >= least and c / n1 >= purity * (c / n1 + seen[0][f] / n0)}
    need = math.log(max(2, len(seen[1])) / chance)
    sure = {f for f, c in pure.items() if _surprise(c, seen[0][f], share) >= need}
    loose = {f for f, c in pure.items() if often[f] >= 2 * c and f not in sure}
    open_docs = [own.keys() & loose for own in held if not own.keys() & sure]
    while open_docs:
        count = Counter(x for f in open_docs for x in f)
        best = max(count, key=lambda f: (count[f], often[f], -len(f), f), default=None)
        if best is None or count[best] < least:
            break
        sure.add(best)
        open_docs = [f for f in open_docs if best not in f]
    return sure


def _padded(segments: list[list[str]], labels: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (segments x words x 5, padded by BUCKETS), labels and mask."""
    idx = np.full((len(segments), SEGMENT, 5), BUCKETS, dtype=np.int64)
    y, mask = np.zeros((len(segments), SEGMENT), dtype=np.int64), np.zeros((len(segments), SEGMENT), dtype=bool)
    for i, (words, own) in enumerate(zip(segments, labels)):
        for t, w in enumerate(words):
            found = [_bucket(f) for f in word_features(w)]
            idx[i, t, : len(found)] = found
        y[i, : len(own)] = own
        mask[i, : len(words)] = True
    return idx, y, mask


def train_chain(segments: list[list[str]], labels: list[list[int]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> Chain:
    """Adagrad on the conditional log likelihood of segments of at most SEGMENT words."""
    idx, y, mask = _padded(segments, labels)
    rng = np.random.default_rng(seed)
    w, sq = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-2)
    bias, bias_sq, moves, moves_sq = -3.0, 1e-2, np.zeros((2, 2)), np.full((2, 2), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(idx))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            x, own, on = idx[rows], y[rows], mask[rows]
            emit = np.stack([np.zeros(own.shape), w[x].sum(axis=2) + bias], axis=2)
            n, steps = own.shape
            fwd, bwd = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
            fwd[:, 0] = emit[:, 0]
            for t in range(1, steps):
                fwd[:, t] = np.where(on[:, t, None], emit[:, t] + np.logaddexp(fwd[:, t - 1, :1] + moves[0], fwd[:, t - 1, 1:] + moves[1]), fwd[:, t - 1])
            for t in range(steps - 2, -1, -1):
                nxt = emit[:, t + 1] + bwd[:, t + 1]
                bwd[:, t] = np.where(on[:, t + 1, None], np.logaddexp(moves[:, 0] + nxt[:, :1], moves[:, 1] + nxt[:, 1:]), 0.0)
            z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
            p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None])
            slope = np.where(on, own - p1, 0.0) / n
            pair = fwd[:, :-1, :, None] + moves + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None]
            both = on[:, 1:, None, None]
            hit = np.zeros(pair.shape)
            i, t = np.indices(own[:, 1:].shape)
            hit[i, t, own[:, :-1], own[:, 1:]] = 1.0
            g_moves = np.where(both, hit - np.exp(np.minimum(pair, 0)), 0.0).sum(axis=(0, 1)) / n
            g = np.bincount(x.ravel(), np.repeat(slope.ravel(), 5), BUCKETS + 1) - decay * w
            g[BUCKETS] = 0.0
            sq += g * g
            w += rate * g / np.sqrt(sq)
            bias_sq += slope.sum() ** 2
            bias += rate * slope.sum() / math.sqrt(bias_sq)
            moves_sq += g_moves**2
            moves += rate * g_moves / np.sqrt(moves_sq)
    return Chain(w[:BUCKETS], bias, moves, (0.0, 0.0, 0.0))


def _curve(points: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on (1, log1p(sum), max) by damped Newton steps."""
    x, b = np.column_stack([np.ones(len(points)), np.log1p(points[:, 0]), points[:, 1]]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        b = b + np.linalg.solve(hess, x.T @ (toxic - p) - 0.05 * b)
    return tuple(float(v) for v in b)


def fit(texts: list[str], toxic: list[bool]) -> Chain | None:
    """Train on labelled documents; None if either class is missing or nothing marks the toxic ones."""
    if len(set(toxic)) < 2:
        return None
    words = [WORD.findall(t) for t in texts]
    marks = toxic_features(words, toxic)
    if not marks:
        return None
    segments, labels, rng = [], [], np.random.default_rng(5)
    for ws, bad in zip(words, toxic):
        tags = [int(bad and not marks.isdisjoint(word_features(w))) for w in ws]
        cuts = range(0, len(ws), SEGMENT)
        with_tag = [c for c in cuts if any(tags[c : c + SEGMENT])]
        rest = [c for c in cuts if not any(tags[c : c + SEGMENT])]
        plain = rng.permutation(rest)[: max(3, len(with_tag))].tolist() if rest else []
        for c in with_tag + plain:
            segments.append(ws[c : c + SEGMENT])
            labels.append(tags[c : c + SEGMENT])
    chain = train_chain(segments, labels)
    points = []
    for ws in words:
        points.append(evidence(chain.marginals([chain.emission(w) for w in ws])))
    chain.curve = _curve(np.array(points), np.array(toxic, dtype=float))
    return chain


class _Emissions(dict):
    def __init__(self, chain: Chain):
        self.chain = chain
        self.older: dict[str, float] = {}

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:  # keep one older generation, so that frequent words stay
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        self[word] = value = self.chain.emission(word) if value is None else value
        return value


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5 is 0: rows that training never sees. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(documents: DataFrame, labels: DataFrame, bounds: tuple[int, int], max_bytes: int) -> tuple[list[str], list[bool]]:
    """At most bounds = (toxic, clean) labelled texts, of at most max_bytes, chosen by hash; never held-out rows.

    The ids are chosen from the labels alone; the texts then come by a broadcast of those ids, and only they are shuffled.
    An id that several documents have counts once, with its smallest text.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("_fs_toxic"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = [known.where(F.col("_fs_toxic") == c).orderBy(order, "doc_id").limit(n) for c, n in zip((1, 0), bounds)]
    pool = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    ids = chosen[0].unionByName(chosen[1])
    found = pool.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_fs_toxic").alias("_fs_toxic"))
    rows = found.collect()  # at most sum(bounds) rows, however often an id repeats
    rows.sort(key=lambda r: (r[0], r[1]))
    return [r[1] for r in rows], [bool(r[2]) for r in rows]


def train(documents: DataFrame, labels: DataFrame, bounds: tuple[int, int] = (1500, 3500), max_bytes: int = 16_000) -> Chain | None:
    """A chain from labelled documents that are not held out. The bounds (toxic and clean documents, bytes a text) limit
    what reaches the driver: 80 MB with the defaults, whatever the tables' size."""
    return fit(*training_rows(documents, labels, bounds, max_bytes))


def score(documents: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans and spans (start:end of each toxic run of words, in code points,
    comma-joined) of every document, over whole texts.

    Null and empty texts get the score of a text without toxic words; with no chain every score is 0. Repeated rows are
    scored each; an empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = _Emissions(chain)
        cut = chain.cut() if chain else 0.0
        plain = chain.score([]) if chain else 0.0
        for batch in batches:
            scores, spans, counts = [], [], []
            for item in batch.column("text"):
                text, found, value = item.as_py() or "", [], plain
                own = [emissions[w] for w in WORD.findall(text)] if chain else []
                if own and max(own) >= cut:
                    marginals = chain.marginals(own)
                    value = chain.score(marginals)
                    joined = False
                    for m, at in zip(marginals, WORD.finditer(text)):
                        if m >= SPAN_AT and joined:
                            found[-1][1] = at.end()
                        elif m >= SPAN_AT:
                            found.append([at.start(), at.end()])
                        joined = m >= SPAN_AT
                scores.append(value)
                counts.append(len(found))
                spans.append(",".join(f"{a}:{b}" for a, b in found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], ["doc_id", "score", "n_spans", "spans"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = narrow.mapInArrow(run, "doc_id long, score double, n_spans long, spans string")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_spans", "spans")


def drop_toxic(documents: DataFrame, chain: Chain | None) -> DataFrame:
    """Documents that are not predicted toxic, all columns unchanged; scoring and dropping happen in one pass.

    Null and empty texts are scored as texts without toxic words; repeated rows are judged each; an empty table gives no
    rows; without a chain all documents stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = _Emissions(chain)
        cut = chain.cut() if chain else 0.0
        for batch in batches:
            keep = []
            for item in batch.column("text"):
                own = [emissions[w] for w in WORD.findall(item.as_py() or "")] if chain else []
                keep.append(not (own and max(own) >= cut and chain.score(chain.marginals(own)) >= 0.5))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
