import numpy as np
import pytest

from finsignal.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int"


def brute(vectors, k):
    """(n, deviations by row, mean, eigenvalues, eigenvectors, trace) by whole numbers and a dense solver."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    deviations = [int(sum((n * c - t) ** 2 for c, t in zip(r, s))) for r in x]
    y = (n * fit - s).astype(float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return n, deviations, ((n * x - s).astype(float) / n), e[::-1][:k], u[:, ::-1][:, :k], np.trace(y.T @ y) / n


def check(rows, df, k):
    n, deviations, centred, e, u, trace = brute([v for _, v in rows], k)
    got = whitening.whiten(df, k).toPandas()
    assert len(got) == len(rows) * len(e) and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    by = {key: part.sort_values("component") for key, part in got.groupby("vec_id")}
    w = np.array([by[i].whitened.to_numpy() for i, _ in rows])
    assert [int(by[i].deviation.iloc[0]) for i, _ in rows] == deviations
    want = centred @ u / np.sqrt(e)
    signs = np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want * signs, atol=1e-7)
    assert np.allclose(by[rows[0][0]].explained, e / trace, rtol=1e-10) and by[rows[0][0]].component.tolist() == list(range(1, len(e) + 1))


def test_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check([(r["vec_id"], r["embedding"]) for r in df.collect()], df, 16)


@pytest.mark.parametrize(("dim", "k"), [(3, 16), (120, 5), (150, 16)])
def test_shapes(spark, dim, k):
    """Fewer dimensions than components, and more than the search space holds; repeats count once in the fit."""
    rng = np.random.default_rng(dim)
    x = (rng.normal(size=(400, dim)) * np.linspace(3, 1, dim)).astype(np.float32)
    x[10:60] = x[9]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    check(rows, spark.createDataFrame([(*r, 0, 1, 2) for r in rows], SCHEMA).repartition(5), min(k, dim))


def test_pairs_to_double_precision():
    """Clustered, equal and zero eigenvalues, known by products only."""
    rng = np.random.default_rng(1)
    for values in (np.linspace(1, 1.05, 90), np.r_[np.full(6, 5.0), np.full(6, 2.0), np.linspace(0, 1, 188)], np.r_[7.0, 3.0, np.zeros(48)], 0.9 ** np.arange(300)):
        q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
        a = (q * values) @ q.T
        count = [0]

        def product(z, a=a, count=count):
            count[0] += 1
            return a @ z

        e, u, worst = whitening.leading_pairs(product, len(values), 8)
        top = np.sort(values)[::-1]
        assert np.allclose(e, top[:8], atol=1e-13 * top[0]) and worst < 1e-13 * top[0]
        assert np.allclose(u.T @ u, np.eye(8), atol=1e-13) and count[0] < 600


def test_edges(spark):
    bad = [(1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, [])]
    rows = [(10, [1.0, 2.0]), (11, [1.0, 2.0]), (11, [1.0, 2.0]), (None, [0.5, -3.0]), (12, [0.25, 0.125]), (13, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, 0, 1, 2) for r in rows + bad], SCHEMA)
    got = whitening.whiten(df).toPandas()
    assert len(got) == 2 * len(rows) and set(got.n) == {4} and got.vec_id.isna().sum() == 2
    assert got.identity_error.max() < 1e-12
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id in (10, 11)")).count() == 0  # one vector: nothing varies
    flat = spark.createDataFrame([(i, [float(i), 5.0], 0, 1, 2) for i in range(9)], SCHEMA)
    assert set(whitening.whiten(flat).toPandas().component) == {1}  # the other dimension never varies
    huge = spark.createDataFrame([(1, [3e20, 1.0], 0, 1, 2), (2, [1.0, 1.0], 0, 1, 2)], SCHEMA)
    with pytest.raises(Exception, match="does not fit"):
        whitening.whiten(huge).collect()
