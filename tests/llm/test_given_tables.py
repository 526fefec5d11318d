"""Registered queries over the given tables against brute force."""

import re

import numpy as np
import xxhash

from finsignal.llm import queries


def test_near_neighbours(spark, sf_dir):
    """Scores are exact inner products of the original vectors, ranks follow them, and recall is at least 0.9."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    got = queries.QUERIES["op3_kmeans_tree_ann"](spark, sf_dir).toPandas()
    place, hits, asked = {i: n for n, i in enumerate(ids)}, 0, [i for i in ids if i % 20 == 0]
    assert set(got.query_id) == set(asked)
    for q in asked:
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id) and own.vec_id.is_unique
        exact = x @ x[place[q]]
        assert np.allclose(own.score, [exact[place[v]] for v in own.vec_id], rtol=0, atol=1e-12)
        assert sorted(zip(-own.score, own.vec_id)) == list(zip(-own.score, own.vec_id))
        best = [i for i in ids[np.lexsort((ids, -exact))] if i != q][:20]
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.9 * 20 * len(asked)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark, sf_dir):
    """Fingerprints of whole texts and their components, by all pairs."""
    docs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    root = {i: i for i, _ in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(docs):
        for j, b in docs[:n]:
            if (a ^ b).bit_count() <= 4:
                low, high = sorted((top(i), top(j)))
                root[high] = low
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op5_simhash_popcount"](spark, sf_dir).collect()}
    assert got == {(i, f"{fp:016x}", top(i)) for i, fp in docs}
