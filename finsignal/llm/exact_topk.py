"""Exact top-k by integer inner product with one KD-tree per shard.

Vectors are dealt to shards of a bounded size by a hash of vec_id. A task reads its shards one after another: first a
shard's rows, which become a KD-tree (median splits along the widest side, tight bounding boxes at the leaves), then the
queries of that shard as a stream of batches. Each query visits leaves best first, by the largest product any point of
the box can reach, until no box can beat its kth best score. That score travels: a first wave searches one shard for each
query, and the second wave, over all other shards, starts from the kth score found there and returns nothing below it.

Products are taken in double precision where every sum stays below 2**53, in 64-bit integers below 2**63, and in Python's
whole numbers beyond, so scores are exact in every case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import write_table
from .vectors import first_of_equal, matrix, streamed, usable

SCALE = 64
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 64, 4096
OUT = "query_id long, vec_id long, score long"
NONE = -(1 << 63)


class KDTree:
    """Leaves of at most LEAF_ROWS rows: an order of the rows, leaf bounds in it, and tight boxes."""

    def __init__(self, points: np.ndarray):
        order, bounds, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF_ROWS:
                bounds.append((a, b))
                continue
            own = points[order[a:b]]
            side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], mid)]
            todo += [(a + mid, b), (a, a + mid)]
        self.order, self.bounds = order, bounds
        self.low = np.array([points[order[a:b]].min(axis=0) for a, b in bounds])
        self.high = np.array([points[order[a:b]].max(axis=0) for a, b in bounds])

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each leaf's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def whole(values: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers as Python's whole numbers."""
    return np.array([[int(v) for v in row] for row in values.tolist()], dtype=object).reshape(values.shape)


class Shard:
    """The rows of a shard, by ascending vec_id, with their tree."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[by_id], points[by_id]
        self.tree = KDTree(self.points)
        self.largest = float(np.abs(self.points).max(initial=0.0))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of each query's k best rows of the shard, its own row excepted, with scores of at
        least floor[query] (NONE: no floor)."""
        bound = float(np.abs(queries).max(initial=0.0)) * self.largest * max(1, self.points.shape[1])
        if bound >= 1 << 62:
            return self._plain(query_ids, queries, floor, k)
        reach = self.tree.reach(queries) + bound * 1e-12 * (bound >= 1 << 53)  # room for rounded sums
        if bound >= 1 << 53:
            points, asked = self.points.astype(np.int64), queries.astype(np.int64)
        else:
            points, asked = self.points, queries
        visit = np.argsort(-reach, axis=1, kind="stable")
        best = np.full((len(queries), k), NONE, dtype=np.int64)
        best_at = np.full((len(queries), k), len(self.ids), dtype=np.int64)  # places in the shard; ties: the smaller one
        active = np.arange(len(queries))
        for step in range(len(self.tree.bounds)):
            kth = np.maximum(best[active, -1], floor[active])
            active = active[(kth == NONE) | (reach[active, visit[active, step]] >= kth.astype(np.float64) * (1 - 1e-15 * np.sign(kth)))]
            if not len(active):
                break
            leaf = visit[active, step]
            for one in np.unique(leaf):
                who, (a, b) = active[leaf == one], self.tree.bounds[one]
                place = self.tree.order[a:b]
                score = (asked[who] @ points[place].T).astype(np.int64)
                good = (score >= np.maximum(best[who, -1], floor[who])[:, None]) & (self.ids[place] != query_ids[who][:, None])
                some = good.any(axis=1)
                if not some.any():
                    continue
                who, score, good = who[some], score[some], good[some]
                both = np.concatenate([best[who], np.where(good, score, NONE)], axis=1)
                at = np.concatenate([best_at[who], np.where(good, place, len(self.ids))], axis=1)
                top = np.lexsort((at, ~both), axis=1)[:, :k]  # ~x falls where x grows, without overflow
                best[who], best_at[who] = np.take_along_axis(both, top, axis=1), np.take_along_axis(at, top, axis=1)
        who, rank = np.nonzero(best_at < len(self.ids))
        return query_ids[who], self.ids[best_at[who, rank]], best[who, rank]

    def _plain(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every product in Python's whole numbers. A result beyond a long cannot be returned and is an error."""
        points, out = whole(self.points), []
        for qid, query, least in zip(query_ids.tolist(), whole(queries), floor.tolist()):
            scores = sorted((-int(s), i) for s, i in zip(points @ query, self.ids.tolist()) if i != qid and (least == NONE or s >= least))[:k]
            if scores and (-scores[0][0] >= 1 << 63 or scores[-1][0] > 1 << 63):
                raise ValueError(f"the inner products of vector {qid} do not fit in 64 bits")
            out += [(qid, i, -s) for s, i in scores]
        return tuple(np.array(x, dtype=np.int64) for x in zip(*out)) if out else (np.empty(0, dtype=np.int64),) * 3


def _index(k: int):
    return lambda rows: Shard(*first_of_equal(rows["vec_id"].to_numpy(), np.floor(matrix(rows["vec"]) * SCALE), k + 1))


def _answer(k: int):
    def answer(shard: Shard, asked: pa.RecordBatch) -> pa.RecordBatch:
        queries = np.floor(matrix(asked.column("vec")) * SCALE)
        found = shard.search(asked.column("vec_id").to_numpy(), queries, asked.column("floor").to_numpy(), k)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    return answer


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, its k largest integer inner
    products over all other rows of floor(64 * x), ties to the smaller vec_id.

    Vectors that vectors.usable leaves out take no part (zero vectors do); equal vectors under several ids all count;
    an empty table gives no rows. Other columns are ignored. Scores are exact whatever the components' size; a result
    that does not fit in a long raises a ValueError. A shard holds about SHARD_ROWS rows and is indexed once in each
    wave; every query meets every shard, so a query's vector is sent once to each.
    """
    rows = write_table(usable(embeddings, zero_ok=True), "vectors")
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    none = F.lit(NONE)
    placed = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "vec_id", "vec", none.alias("floor"))
    queries = placed.where(F.col("vec_id") % every == 0).withColumn("asks", F.lit(1))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def wave(asked: DataFrame) -> DataFrame:
        both = placed.unionByName(asked).repartition(tasks, "shard").sortWithinPartitions("shard", "asks")
        return both.mapInArrow(streamed(_index(k), _answer(k), QUERY_ROWS), OUT)

    first = write_table(_best(wave(queries), k).drop("rank"), "wave1")
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("_kth"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("_own"))
    rest = queries.withColumnRenamed("shard", "_own").join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    rest = rest.select(F.explode(others).alias("shard"), "asks", "vec_id", "vec", F.coalesce("_kth", none).alias("floor"))
    return _best(first.unionByName(wave(rest)), k).select("query_id", "rank", "vec_id", "score")
