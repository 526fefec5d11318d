import numpy as np
import pytest

from finsignal.llm import ann, exact_topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def table(spark, n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dim)) + 2 * rng.normal(size=(8, dim))[rng.integers(0, 8, n)]).astype(np.float32)
    x[5:9] = x[4]
    rows = [(i, [float(v) for v in x[i]], 0, 1) for i in range(n)]
    bad = [(n, None, 0, 1), (n + 1, [float("nan")] * dim, 0, 1), (n + 2, [None] * dim, 0, 1), (n + 3, [float("inf")] * dim, 0, 1), (None, rows[0][1], 0, 1), (n + 4, [1.0], 0, 1), (n + 5, [], 0, 1), rows[3]]
    return x.astype(float), spark.createDataFrame(rows + bad, SCHEMA).repartition(3)


def best(x, q, k, skip):
    score = x @ x[q]
    order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q and i not in skip][:k]
    return order, score[order]


@pytest.mark.parametrize(("shard", "block"), [(8192, 4096), (50, 7)])
def test_exact(spark, monkeypatch, shard, block):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(exact_topk, "QUERY_ROWS", block)
    x, df = table(spark, 400)
    x = np.floor(64 * x)
    got = exact_topk.top_k(df).toPandas()
    for q in range(0, 400, 20):
        own = got[got.query_id == q].sort_values("rank")
        order, score = best(x, q, 20, set())
        assert own.vec_id.tolist() == order and own.score.tolist() == score.astype(int).tolist() and own["rank"].tolist() == list(range(1, 21))
    assert set(got.query_id) == set(range(0, 400, 20))


def test_large_components(spark):
    """Products beyond 2**53 and beyond packed codes, both signs, against Python's whole numbers."""
    rng = np.random.default_rng(9)
    for dim, size in ((1, 9e5), (4, 1e6), (8, 1e7), (2, 2.5e7)):
        x = (rng.choice([-1.0, 1.0], size=(300, dim)) * rng.uniform(0.9 * size, size, size=(300, dim))).astype(np.float32)
        x[7] = x[3]
        df = spark.createDataFrame([(i, [float(v) for v in row], 0, 1) for i, row in enumerate(x)], SCHEMA).repartition(3)
        whole = [[int(np.floor(64 * float(v))) for v in row] for row in x]
        got = {}
        for r in exact_topk.top_k(df).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(got) == set(range(0, 300, 20))
        for q, own in got.items():
            want = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in enumerate(whole) if i != q)[:20]
            assert sorted(own) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_result_beyond_a_long_is_an_error(spark):
    df = spark.createDataFrame([(0, [3e9], 0, 1), (1, [3e9], 0, 1)], SCHEMA)
    with pytest.raises(Exception, match="do not fit in 64 bits"):
        exact_topk.top_k(df).collect()


def test_few_rows_and_none(spark):
    _, df = table(spark, 10)
    few = exact_topk.top_k(df.where("vec_id < 5"))
    assert few.count() == 4
    assert ann.neighbours(df.where("vec_id < 5")).count() == 4
    assert exact_topk.top_k(df.limit(0)).count() == 0 and ann.neighbours(df.limit(0)).count() == 0


def test_tied_vectors(spark):
    rows = [(i, [1.0, 2.0], 0, 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for got in (exact_topk.top_k(df).toPandas(), ann.neighbours(df).toPandas()):
        own = got[got.query_id == 40].sort_values("rank")
        assert own.vec_id.tolist() == list(range(20))


def test_recall(spark):
    x, df = table(spark, 2000)
    got = ann.neighbours(df).toPandas()
    hit = 0
    for q in range(0, 2000, 20):
        own = got[got.query_id == q].sort_values("rank")
        assert len(own) == 20 and np.allclose(own.score, x[own.vec_id] @ x[q]) and (np.diff(own.score) <= 0).all()
        hit += len(set(own.vec_id) & set(best(x, q, 20, set())[0]))
    assert hit >= 0.9 * 20 * 100


@pytest.mark.parametrize("norms", [False, True])
def test_clustered_vectors_are_pruned(norms):
    """Vectors with structure (200 clusters, of one or of any norm): queries that calibration did not see read few rows."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(200, 64))
    x = centres[rng.integers(0, 200, 20_000)] + 0.4 * rng.normal(size=(20_000, 64))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    if norms:
        x *= rng.uniform(0.7, 1.3, size=len(x))[:, None]
    tree = ann.fit_tree(x[rng.choice(len(x), 5000, replace=False)], max(16.0, 5 * 5000 / len(x) ** 0.5))
    leaf = ann.nearest_leaf(tree, x)
    sizes = np.bincount(leaf, minlength=len(tree.leaves()))
    asked = rng.choice(len(x), 328, replace=False)
    scores = x[asked] @ x.T
    scores[np.arange(328), asked] = -np.inf
    near = np.argpartition(-scores, 20, axis=1)[:, :20]
    visits, part = ann.calibrate(tree, x[asked[:128]], np.repeat(np.arange(128), 20), leaf[near[:128].ravel()], sizes, ann.TARGET_RECALL)
    order = ann.visit_order(tree, x[asked[128:]], visits, part)
    recall = np.mean([np.isin(leaf[own], seen).mean() for own, seen in zip(near[128:], order)])
    read = np.mean([sizes[seen].sum() for seen in order]) / len(x)
    assert recall >= 0.95 and read <= 0.3


def test_query_side_is_bounded(spark, monkeypatch, tmp_path):
    """Queries that all visit one leaf are answered in small batches, with the same result."""
    rows = [(i, [1.0, 2.0 + i % 7], 0, 1) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, ann.neighbours(df, every=2).collect()))
    monkeypatch.setattr(vectors, "QUERY_ROWS", 16)
    answer, folder = ann.Bin.answer, str(tmp_path)

    def noted(self, asked):
        import uuid

        open(f"{folder}/{asked.num_rows}-{uuid.uuid4().hex}", "w").close()
        return answer(self, asked)

    monkeypatch.setattr(ann.Bin, "answer", noted)
    assert sorted(map(tuple, ann.neighbours(df, every=2).collect())) == want
    sizes = [int(p.name.split("-")[0]) for p in tmp_path.iterdir()]
    assert sum(sizes) >= 300 and max(sizes) <= 16


def test_large_leaves_and_short_queries(spark, monkeypatch):
    """Leaves over several bins, and queries whose visits hold fewer than k rows."""
    monkeypatch.setattr(ann, "BIN_ROWS", 40)
    monkeypatch.setattr(ann, "calibrate", lambda *a: (1, 0.5))
    rng = np.random.default_rng(4)
    centres = 10 * rng.normal(size=(30, 4))
    x = np.concatenate([np.repeat(centres[:1], 300, axis=0), centres[rng.integers(1, 30, 300)]]) + 0.01 * rng.normal(size=(600, 4))
    df = spark.createDataFrame([(i, [float(v) for v in row], 0, 1) for i, row in enumerate(x)], SCHEMA)
    got = ann.neighbours(df).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got.query_id.nunique() == 30
    short = set(ann.lay_out(np.array([100, 5, 30, 20])).first.tolist())
    assert short == {0, 3, 4} and ann.lay_out(np.array([100, 5, 30, 20])).parts.tolist() == [3, 1, 1, 1]


def test_equal_vectors_keep_answers():
    rng = np.random.default_rng(5)
    points, ids = rng.integers(0, 3, size=(500, 2)).astype(float), rng.permutation(500)
    kept_ids, kept = vectors.first_of_equal(ids, points, 4)
    assert (np.diff(kept_ids) > 0).all()
    for v in np.unique(points, axis=0):
        same = np.sort(ids[(points == v).all(axis=1)])
        assert kept_ids[(kept == v).all(axis=1)].tolist() == same[:4].tolist()


def test_zero_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 0, 1), (20, [1.0, 0.0], 0, 1), (21, [0.5, 0.0], 0, 1)], SCHEMA)
    assert set(ann.neighbours(df).toPandas().query_id) == {20}
    assert set(exact_topk.top_k(df).toPandas().query_id) == {0, 20}
