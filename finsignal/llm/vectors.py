"""What the two vector searches share: clean tables, and shards that are indexed once and asked by a stream of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


QUERY_ROWS = 1024  # queries answered at a time


def usable(embeddings: DataFrame, zero_ok: bool, dim: int | None = None) -> DataFrame:
    """(vec_id long, vec array<double>): rows that take part in a search.

    Left out: null ids, null or empty vectors, vectors with a null or non-finite component, zero vectors unless zero_ok,
    and vectors whose length is not `dim` (default: the commonest length; ties to the longest). Rows repeating an id
    count once, with the smallest vector. Only one number reaches the driver.
    """
    vec = F.col("embedding").cast("array<double>")
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(F.size("vec") > 0)
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if not zero_ok:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    if dim is None:
        found = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = found["d"] if found else 1
    return rows.where(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an array<double> column of one length as a 2-d array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def first_of_equal(ids: np.ndarray, points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by ascending id, of each vector only the `most` smallest ids. With most = k + 1 this changes no query's k
    best rows: equal vectors have equal scores, ties go to smaller ids, and one of them may be the query itself."""
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], np.ascontiguousarray(points[order] + 0.0)  # + 0.0: no negative zeros
    if len(ids) <= most:
        return ids, points
    _, kind = np.unique(points.view([("", points.dtype)] * points.shape[1]).reshape(-1), return_inverse=True)
    together = np.argsort(kind, kind="stable")
    starts = np.concatenate(([0], np.flatnonzero(np.diff(kind[together])) + 1))
    nth = np.arange(len(ids)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(ids)]))))
    keep = np.sort(together[nth < most])
    return ids[keep], points[keep]


def streamed(index: Callable[[pa.Table], object], answer: Callable[[object, pa.RecordBatch], pa.RecordBatch], rows: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (shard, asks): a shard's rows (asks = 0) are gathered and indexed, its queries (asks = 1) answered
    `rows` (default QUERY_ROWS) at a time. Memory: one shard and one batch of queries."""
    most = rows or QUERY_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, found = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("asks").to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                own, asks = divmod(int(key[a]), 2)
                if own != shard:
                    shard, held, found = own, [], None
                part = batch.slice(a, b - a)
                if not asks:
                    held.append(part)
                    continue
                if held:
                    found, held = index(pa.Table.from_batches(held)), []
                if found is not None:
                    for at in range(0, part.num_rows, most):
                        yield answer(found, part.slice(at, most))

    return run
