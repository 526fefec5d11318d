"""Embedding whitening: leading eigenpairs of a covariance by Jacobi-Davidson, without ever forming the covariance.

Spark multiplies it with a few vectors at a time: every task centres its blocks of the fit list, multiplies twice and gives
one sum. The driver holds a search space of a few dozen vectors (Rayleigh-Ritz, locking) and the recurrences of MINRES,
which solves the projected correction equations of all open Ritz pairs side by side: one distributed product a step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import write_table
from .vectors import matrix

SCALE, SHIFT = 64, 1_000_000
BLOCK_ROWS = 1024
SUM_TASKS = 8  # that add up what the tasks before them give
INNER_STEPS, OUTER_STEPS, PROBE_STEPS = 8, 200, 3
EPS = float(np.finfo(float).eps)


def scaled(embeddings: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """((vec_id long, x array<long>), dim): rows that take part, with x = floor(64 * component) + 1000000.

    Left out: null or empty vectors, vectors with a null or non-finite component, and vectors whose length is not `dim`
    (default: the commonest length; ties to the longest). A component of 2**46 or more in size is an error. Repeated rows
    and null ids stay.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where(F.size("vec") > 0)
    rows = rows.where(F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))))
    if dim is None:
        found = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = found["d"] if found else 1
    whole = lambda c: F.when(F.abs(c) < F.lit(float(1 << 46)), F.floor(SCALE * c) + F.lit(SHIFT)).otherwise(F.raise_error(F.lit("a component does not fit")).cast("long"))
    return rows.where(F.size("vec") == dim).select("vec_id", F.transform("vec", whole).alias("x")), dim


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in blocks of up to BLOCK_ROWS, as bytes."""
    for batch in batches:
        x = matrix(batch.column("x"))
        parts = [x[at : at + BLOCK_ROWS] for at in range(0, len(x), BLOCK_ROWS)]
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary())], ["block"])


def _total(blocks: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: type) -> np.ndarray:
    """Sum of part(x) over all blocks, in whole numbers or doubles. A task gives one array; these are dealt to SUM_TASKS
    tasks, which give one each, so the driver gets SUM_TASKS arrays, whatever the number of tasks before."""
    size, arrow = int(np.prod(shape)), pa.int64() if kind is int else pa.float64()

    def array(own: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(own, arrow))], ["own"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, dtype=kind)
        for batch in batches:
            for block in batch.column("block"):
                own += part(np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, dim)).ravel()
        yield array(own)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, dtype=kind)
        for batch in batches:
            own += matrix(batch.column("own")).sum(axis=0, dtype=kind) if batch.num_rows else 0
        yield array(own)

    shape_of = f"own array<{'long' if kind is int else 'double'}>"
    found = blocks.mapInArrow(inside, shape_of).repartition(SUM_TASKS).mapInArrow(across, shape_of).toArrow()
    return matrix(found.column("own")).sum(axis=0, dtype=kind).reshape(shape)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums in whole numbers; an error where they could leave 64 bits."""
    if 2 * n * int(np.abs(x).max(initial=0)) >= 1 << 63:
        raise OverflowError("n times a component does not fit in 64 bits")
    return n * x - sums


@dataclass(frozen=True)
class FitList:
    """Distinct vectors in blocks, in the shared folder, with their number n and exact sums by dimension."""

    blocks: DataFrame
    dim: int
    n: int
    sums: np.ndarray

    def total(self, part: Callable[[np.ndarray, int], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum of part(n * x - sums, n) over all blocks."""
        n, sums = self.n, self.sums
        return _total(self.blocks, self.dim, lambda x: part(_centred(x, n, sums), n), shape, float)

    def product(self, q: np.ndarray) -> np.ndarray:
        """Covariance times the columns of q."""

        def part(centred: np.ndarray, n: int) -> np.ndarray:
            y = centred / n
            return y.T @ (y @ q)

        return self.total(part, q.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda c, n: np.array([np.square(c / n).sum()]), (1,))[0]) / self.n


def fit_list(rows: DataFrame, dim: int) -> FitList:
    """Each distinct x of `rows` once. Copies are merged before the shuffle, so a vector that a third of all rows share
    costs a row a task. A list whose sums could leave 64 bits is an error."""
    blocks = write_table(rows.select("x").distinct().mapInArrow(_packed, "block binary"), "fit-list")

    n, size = _total(blocks, dim, lambda x: np.array([len(x), np.abs(x.astype(float)).sum(axis=0).max(initial=0.0)]), (2,), float)
    if 2 * size >= 1 << 63:
        raise OverflowError("sums do not fit in 64 bits")
    n = int(n)
    return FitList(blocks, dim, n, _total(blocks, dim, lambda x: x.sum(axis=0), (dim,), int))


def _orthogonal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what t adds to the bases; what adds nothing goes."""
    kept: list[np.ndarray] = []
    for v in t.T:
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = v / size
        for _ in range(3):  # repeated, so that rounding leaves nothing behind
            for b in (*bases, *([np.stack(kept, axis=1)] if kept else [])):
                v = v - b @ (b.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            kept.append(v)
    return np.stack(kept, axis=1) if kept else np.empty((len(t), 0))


def corrections(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, theta: np.ndarray, residual: np.ndarray, steps: int = INNER_STEPS) -> np.ndarray:
    """MINRES on (I - qq')(A - theta I)(I - qq') t = -residual, a column for each open pair, with its own shift.

    The Lanczos vectors of all columns are multiplied together. Ends after `steps`, or once all residuals fell tenfold.
    """
    project = lambda z: z - q @ (q.T @ z)
    v = project(-residual)
    beta = np.linalg.norm(v, axis=0)
    x, w, w_before = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    v_before, b = np.zeros_like(v), beta.copy()
    c, s, c_before, s_before = np.ones_like(b), np.zeros_like(b), np.ones_like(b), np.zeros_like(b)
    phi, start = beta.copy(), beta.copy()
    safe = lambda z: np.where(z == 0, 1.0, z)
    v = v / safe(b)
    for _ in range(steps):
        z = project(product(v) - v * theta)
        alpha = np.einsum("ij,ij->j", v, z)
        z = project(z - v * alpha - v_before * b)
        b_next = np.linalg.norm(z, axis=0)
        # two old rotations and a new one bring the next column of the tridiagonal matrix to triangular form
        epsilon, bar = s_before * b, c_before * b
        delta, gamma_bar = c * bar + s * alpha, c * alpha - s * bar
        gamma = safe(np.hypot(gamma_bar, b_next))
        c_before, s_before, c, s = c, s, gamma_bar / gamma, b_next / gamma
        w_next = (v - w_before * epsilon - w * delta) / gamma
        x = x + w_next * (c * phi)
        phi = -s * phi
        w_before, w = w, w_next
        v_before, v, b = v, z / safe(b_next), b_next
        if (np.abs(phi) <= 0.1 * start).all():
            break
    return project(x)


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, largest residual) of the k largest eigenvalues of a symmetric non-negative matrix, known by its
    products only. Pairs are locked once their residual is 8 * sqrt(dim) * machine precision * the largest value; all
    must get there. Then blocks of random vectors look for a larger value that was missed."""
    k = min(k, dim)
    rng = np.random.default_rng(seed)
    most = min(dim, 4 * k + 8)
    locked, largest = np.empty((dim, 0)), 0.0
    space = _orthogonal(rng.normal(size=(dim, min(dim, 2 * k))))
    image = product(space)
    for _ in range(OUTER_STEPS):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        theta, space, image = theta[::-1], space @ turn, image @ turn  # the space's own basis is now the Ritz vectors
        largest = max(largest, float(theta[0]) if len(theta) else 0.0)
        tol = 8 * np.sqrt(dim) * EPS * largest
        m = min(k - locked.shape[1], space.shape[1])
        residual = image[:, :m] - space[:, :m] * theta[:m]
        residual -= locked @ (locked.T @ residual)
        open_ = np.linalg.norm(residual, axis=0) > tol
        done = int(np.argmax(open_)) if open_.any() else m  # only from the front, so that the largest are locked first
        locked, space, image, theta, residual, open_ = np.hstack([locked, space[:, :done]]), space[:, done:], image[:, done:], theta[done:], residual[:, done:], open_[done:]
        if locked.shape[1] == k:
            missed = _missed(product, locked, rng, tol)
            if not missed.shape[1]:
                break
            space, locked = _orthogonal(np.hstack([locked, missed])), np.empty((dim, 0))
            image = product(space)
            continue
        m -= done
        t = corrections(product, np.hstack([locked, space[:, :m]]), theta[:m][open_], residual[:, open_])
        if space.shape[1] + t.shape[1] > most - locked.shape[1]:  # thick restart
            space, image = space[:, : max(m, most - locked.shape[1] - t.shape[1])], image[:, : max(m, most - locked.shape[1] - t.shape[1])]
        new = _orthogonal(t, locked, space)
        if not new.shape[1]:
            new = _orthogonal(rng.normal(size=(dim, k)), locked, space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
        elif space.shape[1] + locked.shape[1] == dim:  # the whole space: rounding of old products is all that is left
            image = product(space)
    else:
        raise ArithmeticError("residuals did not reach double precision")
    image = product(locked)
    values = np.einsum("ij,ij->j", locked, image)
    order = np.argsort(-values, kind="stable")
    worst = float(np.max(np.linalg.norm(image - locked * values, axis=0), initial=0.0))
    return values[order], locked[:, order], worst


def _missed(product: Callable[[np.ndarray], np.ndarray], locked: np.ndarray, rng: np.random.Generator, tol: float) -> np.ndarray:
    """Ritz vectors outside the locked ones with a value above the smallest locked one: a random block and its images."""
    dim, k = locked.shape
    least = float(np.min(np.einsum("ij,ij->j", locked, product(locked))))
    space = _orthogonal(rng.normal(size=(dim, min(k, dim - k))), locked)
    if not space.shape[1]:
        return space
    image = product(space)
    for step in range(PROBE_STEPS + 1):
        theta, turn = np.linalg.eigh(space.T @ image)
        if (theta > least + 4 * tol).any():
            return space @ turn[:, theta > least + 4 * tol]
        new = _orthogonal((image - space @ (space.T @ image)) if step < PROBE_STEPS else image[:, :0], locked, space)
        if not new.shape[1]:
            break
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    return space[:, :0]


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: eigenvalues, unit eigenvectors (columns), and what centres a vector."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    identity_error: float


def fit(fit_rows: FitList, components: int = 16) -> Whitening:
    """The leading components. Those whose eigenvalue is zero within rounding are left out: fewer distinct vectors than
    components, or dimensions that never vary."""
    trace = fit_rows.trace() if fit_rows.n else 0.0
    if not trace:
        none = np.empty((fit_rows.dim, 0))
        return Whitening(fit_rows.n, fit_rows.sums, none[0], none, 0.0, 0.0, 0.0)
    values, vectors, residual = leading_pairs(fit_rows.product, fit_rows.dim, components)
    real = values > 64 * fit_rows.dim * EPS * values[0]
    values, vectors = values[real], vectors[:, real]
    scaled_vectors, k = vectors / np.sqrt(values), int(real.sum())

    def moments(centred: np.ndarray, n: int) -> np.ndarray:
        w = (centred / n) @ scaled_vectors
        return np.vstack([w.sum(axis=0), w.T @ w])

    found = fit_rows.total(moments, (k + 1, k)) / fit_rows.n
    error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())
    return Whitening(fit_rows.n, fit_rows.sums, values, vectors, trace, residual, error)


def project(rows: DataFrame, w: Whitening) -> DataFrame:
    """(vec_id, deviation long, whitened array<double>) of scaled rows: exact squared distance from the mean, times n
    squared, and the components. A deviation beyond 64 bits is an error. No shuffle; the fit goes along with the tasks."""
    n, sums, turn = w.n, w.sums, w.vectors / np.sqrt(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = _centred(matrix(batch.column("x")), n, sums) if batch.num_rows else np.empty((0, len(sums)), dtype=np.int64)
            if np.square(centred.astype(float)).sum(axis=1).max(initial=0.0) >= 2.0**63 * (1 - 1e-9):
                raise OverflowError("a deviation does not fit in 64 bits")
            out = (centred / n) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.square(centred).sum(axis=1)), lists], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whiten(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector that takes part
    (see scaled) and each component (see fit).

    Repeated rows and null ids each get their rows; equal vectors count once in the fit. An empty table, or one without
    two different vectors, gives no rows; other columns are ignored.
    """
    rows, dim = scaled(embeddings)
    w = fit(fit_list(rows, dim), components)
    explained = F.element_at(F.array(*[F.lit(float(e / w.trace)) for e in w.values]) if len(w.values) else F.array(F.lit(0.0)), F.col("at") + 1)
    each = project(rows, w).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(w.identity_error).alias("identity_error"))
