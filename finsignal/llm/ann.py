"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (SAMPLE_ROWS, by hash of vec_id) and sent to the tasks; every row is indexed in
its nearest leaf. A query takes inner nodes and leaves from a priority queue by the inner product with the node's centre
plus a part of what the node's radius allows, and so lists the leaves it visits, best first. How many it visits, and
which part of the radius counts, is calibrated: some queries are searched exactly, and visits widen until recall is
reached for all of them together and for nine in ten of them.

Leaves that are neighbours in the tree lie together in bins of about BIN_ROWS rows; a leaf with more rows has bins of its
own. A query's vector is sent once to each bin that holds a leaf it visits. A task gathers a bin's rows, then answers the
bin's queries as a stream, so no leaf and no crowd of queries has to fit in a task. The first FIRST_VISITS leaves give a
kth best score, and later leaves return only rows that reach it. A query that then has fewer than k rows visits all other
leaves as well.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import write_table
from .vectors import first_of_equal, matrix, streamed, usable

SAMPLE_ROWS, BRANCH, BIN_ROWS, PAIRS = 20_000, 8, 16_384, 1 << 17
CALIBRATE_QUERIES, TARGET_RECALL, LEAST_RECALL, FIRST_VISITS = 128, 0.97, 0.9, 4
RADIUS_PARTS = (0.0, 0.5, 1.0)
OUT = "query_id long, vec_id long, score double"


@dataclass
class Tree:
    """Nodes in arrays: centre, radius (set from all indexed rows for leaves' parents too), children; leaves by number."""

    centres: np.ndarray
    children: list[list[int]]
    leaf_of: list[int]
    radius: np.ndarray

    def leaves(self) -> list[int]:
        return [i for i, x in enumerate(self.leaf_of) if x >= 0]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Label of each row: Lloyd's rounds from a random choice of rows."""
    centres = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(rounds):
        label = np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)
        for c in range(k):
            if (own := label == c).any():
                centres[c] = x[own].mean(axis=0)
    return label


def fit_tree(sample: np.ndarray, leaf_rows: float, seed: int = 7) -> Tree:
    """Split the sample by k-means, BRANCH ways, until a node holds at most leaf_rows sampled rows."""
    rng, centres, children, leaf_of, members = np.random.default_rng(seed), [sample.mean(axis=0)], [[]], [-1], [np.arange(len(sample))]
    todo, leaves = [0], 0
    while todo:
        node = todo.pop()
        own = members[node]
        label = _kmeans(sample[own], BRANCH, rng) if len(own) > max(leaf_rows, BRANCH) else np.zeros(len(own), dtype=int)
        parts = [own[label == c] for c in np.unique(label)]
        if len(parts) < 2:
            leaf_of[node], leaves = leaves, leaves + 1
            continue
        for part in parts:
            children[node].append(len(centres))
            todo.append(len(centres))
            centres.append(sample[part].mean(axis=0))
            children.append([])
            leaf_of.append(-1)
            members.append(part)
    radius = np.array([np.sqrt(((sample[m] - c) ** 2).sum(axis=1)).mean() if len(m) else 0.0 for m, c in zip(members, centres)])
    return Tree(np.array(centres), children, leaf_of, radius)


def nearest_leaf(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf whose centre is nearest, over all leaves."""
    nodes = np.array(tree.leaves())
    own = tree.centres[nodes]
    pick = np.argmin((own**2).sum(axis=1) - 2 * (x @ own.T), axis=1)
    return np.array(tree.leaf_of)[nodes[pick]]


def visit_order(tree: Tree, queries: np.ndarray, visits: int, part: float = 1.0) -> list[list[int]]:
    """Best-bin-first: the first `visits` leaves of each query, in the order the priority queue gives them."""
    reach = queries @ tree.centres.T + part * np.sqrt((queries**2).sum(axis=1))[:, None] * tree.radius
    out = []
    for row in reach:
        queue, found = [(-row[0], 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if tree.leaf_of[node] >= 0:
                found.append(tree.leaf_of[node])
            for child in tree.children[node]:
                heapq.heappush(queue, (-row[child], child))
        out.append(found)
    return out


def exact_scores(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products added from left to right in double precision: equal vectors get equal scores."""
    return np.cumsum(points * query, axis=1)[:, -1]


class Bin:
    """The rows of a bin by leaf. Of equal vectors only the k + 1 smallest ids stay, which changes no answer."""

    def __init__(self, rows: pa.Table, k: int):
        leaf, self.k, self.leaves = rows["leaf"].to_numpy(), k, {}
        ids, points = rows["vec_id"].to_numpy(), matrix(rows["vec"])
        for one in np.unique(leaf).tolist():
            self.leaves[one] = first_of_equal(ids[leaf == one], points[leaf == one], k + 1)

    def answer(self, asked: pa.RecordBatch) -> pa.RecordBatch:
        """Each query's k best rows of the leaves it wants here, its own row excepted, with scores of at least its floor:
        rough products choose, exact ones decide."""
        query_ids, queries, floor = asked.column("vec_id").to_numpy(), matrix(asked.column("vec")), asked.column("floor").to_numpy()
        want = asked.column("want")
        owner, wanted = np.repeat(np.arange(len(queries)), want.value_lengths().to_numpy()), want.flatten().to_numpy()
        parts: list[tuple] = []
        for leaf, (ids, points) in self.leaves.items():
            who = owner[wanted == leaf]
            if not len(who):
                continue
            rough = queries[who] @ points.T
            rough[ids == query_ids[who][:, None]] = -np.inf
            kth = np.partition(rough, len(ids) - self.k, axis=1)[:, len(ids) - self.k] if len(ids) > self.k else np.full(len(who), -np.inf)
            least = np.maximum(kth, floor[who])
            least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)
            at, row = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
            for cut in range(0, len(at), PAIRS):
                q, r = who[at[cut : cut + PAIRS]], row[cut : cut + PAIRS]
                score = exact_scores(points[r], queries[q])
                keep = score >= floor[q]
                parts.append((q[keep], ids[r[keep]], score[keep]))
        q, found, score = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        order = np.lexsort((found, -score, q))
        q, found, score = q[order], found[order], score[order]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1)) if len(q) else np.empty(0, dtype=np.int64)
        nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(q)]))))
        best = nth < self.k
        return pa.RecordBatch.from_arrays([pa.array(query_ids[q[best]]), pa.array(found[best]), pa.array(score[best])], ["query_id", "vec_id", "score"])


@dataclass
class Layout:
    """Bins of leaves: a leaf's first bin, and over how many bins its rows are dealt by hash of vec_id."""

    first: np.ndarray
    parts: np.ndarray


def lay_out(sizes: np.ndarray) -> Layout:
    """Leaves, in the order of the tree, to bins of at most BIN_ROWS rows; a larger leaf has several of its own."""
    first, parts, at, filled = np.zeros(len(sizes), dtype=np.int32), np.ones(len(sizes), dtype=np.int32), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if filled and filled + n > BIN_ROWS:
            at, filled = at + 1, 0
        first[leaf] = at
        if n > BIN_ROWS:
            parts[leaf] = -(-n // BIN_ROWS)
            at += int(parts[leaf])
        else:
            filled += n
    return Layout(first, parts)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrate(tree: Tree, queries: np.ndarray, owner: np.ndarray, leaf: np.ndarray, sizes: np.ndarray, recall: float) -> tuple[int, float]:
    """(visits, part of the radius) that read the fewest rows and reach `recall` over all true neighbours and LEAST_RECALL
    for nine in ten queries. owner, leaf: query number and leaf of each true neighbour."""
    leaves, options = len(sizes), []
    for part in RADIUS_PARTS:
        order = np.array(visit_order(tree, queries, leaves, part))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(leaves)[None, :].repeat(len(order), axis=0), axis=1)
        at = place[owner, leaf]
        total = np.bincount(owner, minlength=len(queries))
        visits = leaves
        for v in range(1, leaves + 1):
            own = np.bincount(owner[at < v], minlength=len(queries)) / np.maximum(total, 1)
            if (at < v).mean() >= recall and (own[total > 0] >= LEAST_RECALL).mean() >= 0.9:
                visits = v
                break
        options.append((float(sizes[order[:, :visits]].sum()), visits, part))
    _, visits, part = min(options)
    return visits, part


def neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, recall: float = TARGET_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, its k nearest rows found, by
    inner product in double precision of the original vectors, ties to the smaller vec_id, its own row excepted.

    Vectors that vectors.usable leaves out take no part (zero vectors neither). Every query gets k rows, or all
    candidates if there are fewer. An empty table gives no rows. The sample for the tree (SAMPLE_ROWS) and the queries
    for calibration (CALIBRATE_QUERIES) are bounded and chosen by hash; all rows are indexed and all queries answered.
    Where vectors have no structure a tree cannot prune, and calibration then visits most leaves: see the README.
    """
    spark = embeddings.sparkSession
    rows = write_table(usable(embeddings, zero_ok=False), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_hash = F.xxhash64("vec_id", F.lit("sample"))
    sample = rows.where(F.pmod(by_hash, F.lit(1 << 20)) <= F.lit(int((1 << 20) * min(1.0, SAMPLE_ROWS / n)))).limit(2 * SAMPLE_ROWS).select("vec").toArrow()
    if not sample.num_rows:
        sample = rows.limit(1).select("vec").toArrow()
    points = matrix(sample["vec"])
    tree = fit_tree(points, max(16.0, 5 * len(points) / n**0.5))  # about sqrt(n) leaves, as splits overshoot
    n_leaves = len(tree.leaves())  # the tree goes along with the tasks: bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = nearest_leaf(tree, matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], ["vec_id", "vec", "leaf"])

    placed = write_table(rows.mapInArrow(place, "vec_id long, vec array<double>, leaf int"), "leaves")
    sizes = np.zeros(n_leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row a leaf: bounded by the sample
        sizes[r["leaf"]] = r["count"]
    layout = lay_out(sizes)
    bins = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(layout.first, layout.parts))], "leaf int, first int, parts int")
    shard = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
    indexed = placed.join(F.broadcast(bins), "leaf").select(shard.alias("shard"), F.lit(0).alias("asks"), "vec_id", "vec", "leaf", F.lit(None).cast("array<int>").alias("want"), F.lit(None).cast("double").alias("floor"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = "shard int, asks int, vec_id long, vec array<double>, leaf int, want array<int>, floor double"

    def asked(which: DataFrame, after: int, upto: int, part: float) -> DataFrame:
        """Queries (vec_id, vec, floor) dealt to the bins of their visits number `after` to `upto`."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    own = batch.slice(at, 1024)
                    row, shards, want = [], [], []
                    for i, leaves in enumerate(visit_order(tree, matrix(own.column("vec")), upto, part)):
                        by_bin: dict[int, list[int]] = {}
                        for leaf in leaves[after:]:
                            for b in range(layout.first[leaf], layout.first[leaf] + layout.parts[leaf]):
                                by_bin.setdefault(int(b), []).append(leaf)
                        row += [i] * len(by_bin)
                        shards += by_bin
                        want += by_bin.values()
                    vec_id, vec, floor = (own.column(c).take(pa.array(row, pa.int64())) for c in ("vec_id", "vec", "floor"))
                    ones, none = pa.array(np.ones(len(row), dtype=np.int32)), pa.array([None] * len(row), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), ones, vec_id, vec, none, pa.array(want, pa.list_(pa.int32())), floor], [c.split()[0] for c in columns.split(", ")])

        return which.select("vec_id", "vec", "floor").mapInArrow(run, columns)

    def search(which: DataFrame, after: int, upto: int, part: float) -> DataFrame:
        both = indexed.unionByName(asked(which, after, upto, part)).repartition(tasks, "shard").sortWithinPartitions("shard", "asks")
        return both.mapInArrow(streamed(lambda table: Bin(table, k), lambda found, batch: found.answer(batch)), OUT)

    lowest = F.lit(float("-inf"))
    queries = placed.where(F.col("vec_id") % every == 0).withColumn("floor", lowest)
    pool = write_table(queries.orderBy(F.xxhash64("vec_id", F.lit("calibrate")), "vec_id").limit(CALIBRATE_QUERIES), "calibration")
    truth = _ranked(search(pool, 0, n_leaves, 0.0), k).select("query_id", "vec_id")
    known = placed.select("vec_id", "leaf").join(F.broadcast(truth), "vec_id").select("query_id", "leaf").toArrow()  # at most CALIBRATE_QUERIES * k rows
    asks = pool.select("vec_id", "vec").toArrow()
    number = {q: i for i, q in enumerate(asks["vec_id"].to_pylist())}
    owner = np.array([number[q] for q in known["query_id"].to_pylist()], dtype=np.int64)
    visits, part = calibrate(tree, matrix(asks["vec"]), owner, known["leaf"].to_numpy(), sizes, recall) if len(owner) else (n_leaves, 0.0)

    early = min(FIRST_VISITS, visits)
    found = write_table(_ranked(search(queries, 0, early, part), k).drop("rank"), "wave1")
    for after, upto in ((early, visits), (visits, n_leaves)):
        if after >= upto:
            continue
        kth = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth"))
        rest = queries.drop("floor").join(kth, "vec_id", "left").withColumn("floor", F.when(F.col("_n") == k, F.col("_kth")).otherwise(lowest))
        if after == visits:  # only queries that are short of rows go on
            rest = rest.where(F.coalesce("_n", F.lit(0)) < min(k, n - 1))
            if rest.isEmpty():
                continue
        found = write_table(_ranked(found.unionByName(search(rest, after, upto, part)), k).drop("rank"), "wave")
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
