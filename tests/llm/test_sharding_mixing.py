import zlib

import numpy as np
import pytest
from conftest import EDGE
from pyspark.sql import functions as F

from finsignal.llm import mixing, sharding


def jump(key, n):
    """The published loop."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_matches_the_published_loop(spark):
    import hashlib

    rows = spark.range(300).select("id", sharding.jump_shards(F.col("id"), [1, 7, 16, 17, 100]).alias("s")).collect()
    for r in rows:
        key = int(hashlib.md5(str(r["id"]).encode()).hexdigest()[:16], 16)
        assert r["s"] == [jump(key, n) for n in (1, 7, 16, 17, 100)]
    with pytest.raises(ValueError):
        sharding.jump_shards(F.col("id"), [0])


@pytest.mark.parametrize("most", [10_000, 7])
def test_slots_and_growth(spark, docs_of, monkeypatch, most):
    monkeypatch.setattr(sharding, "RANGE_ROWS", most)
    rows = EDGE + [(7, "same")] * 500 + [(i, f"t{i}") for i in range(100, 400)]
    got = sharding.shard_documents(docs_of(rows), 4, 8).collect()
    assert len(got) == len(rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
    texts = {zlib.crc32((t or "").encode()): len((t or "").encode()) + 1 for _, t in rows}
    assert all(texts[r["text_crc32"]] == r["size"] for r in got)
    assert sharding.shard_documents(docs_of([])).count() == 0


def test_rates_meet_targets(spark):
    cells = [(f"s{a}", f"l{b}", f"t{c}", 10 + 37 * a + 11 * b * c + c) for a in range(4) for b in range(3) for c in range(2)]
    targets = mixing.Targets(exponents={"source": 0.5, "topic": 0.0}, weights={"lang": {"l0": 0.6, "l1": 0.3, "l2": 0.1}}, sweeps=20)
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    for small in (True, False):
        out = mixing.rake(df, targets, small).toPandas()
        assert abs(out.weight.sum() - out.tokens.sum()) < 1e-6 and abs(out.rate.max() - 1) < 1e-12
        share = out.groupby("lang").weight.sum() / out.weight.sum()
        assert abs(share["l0"] - 0.6) < 1e-6 and abs(share["l2"] - 0.1) < 1e-6
        kept = (out.tokens * out.rate).groupby(out.topic).sum()
        assert abs(kept["t0"] / kept["t1"] - 1) < 1e-6


def test_many_cells_in_one_value(spark):
    """The shuffled path meets targets too, and stops once they are met."""
    cells = [("s0" if a < 30 else f"s{a}", f"l{a % 3}", f"t{a}", 10 + a) for a in range(40)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = mixing.Targets(exponents={"source": 0.5, "lang": 1.0, "topic": 1.0}, weights={})
    both = [mixing.rake(df, targets, small).toPandas().sort_values("topic") for small in (True, False)]
    assert np.allclose(both[0].rate, both[1].rate, atol=1e-9)


def test_budget_repeats(spark, docs_of):
    df = docs_of([(i, "w " * 50) for i in range(400)])
    for budget in (10_000, 50_000):
        targets = mixing.Targets(exponents={}, weights={}, budget=budget)
        out = mixing.mix(df, targets, F.lit("t"))
        assert abs(out.agg(F.sum(F.col("copies") * F.col("tokens"))).first()[0] / budget - 1) < 0.15
        assert mixing.keep_mixed(df, targets, F.lit("t")).count() == out.agg(F.sum("copies")).first()[0]


def test_topics(spark, docs_of):
    rows = [(i, "the common words " + ("Apple tart" if i % 10 == 0 else "river bank" if i % 10 == 1 else "more " * i)) for i in range(100)] + [(None, None), (500, "")]
    df = docs_of(rows)
    anchors = mixing.fit_topics(df)
    assert anchors == ["apple", "bank", "river", "tart"]
    got = {r["doc_id"]: r["topic"] for r in mixing.mix(df).collect()}
    assert got[10] == "apple" and got[11] == "bank" and got[12] == got[500] == got[None] == "(other)"
    assert {r["topic"] for r in mixing.mix(df, topic=F.col("spans")).collect()} == {"x"}
    assert mixing.fit_topics(docs_of([])) == []


def test_sample_edges(spark, docs_of):
    rows = EDGE + [(i, "w " * (i % 40)) for i in range(10, 300)]
    df = docs_of(rows).withColumn("source", F.when(F.col("doc_id") == 11, None).otherwise(F.col("source")))
    out = mixing.mix(df)
    assert out.count() == len(rows) and out.where("tokens = 0 and not selected").count() == 0
    assert out.where("source = '(none)'").count() == 1
    assert {r[0]: r[1] for r in out.select("doc_id", "selected").collect()} == {r[0]: r[1] for r in mixing.mix(df.repartition(7)).select("doc_id", "selected").collect()}
    kept = mixing.keep_mixed(df)
    assert kept.columns == df.columns and kept.count() == out.where("selected").count()
    assert mixing.mix(docs_of([])).count() == 0 and mixing.keep_mixed(docs_of([])).count() == 0
