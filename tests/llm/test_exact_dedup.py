import hashlib

import pytest
from conftest import EDGE

from finsignal.llm import exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, digest string, row long, file string"


def brute(rows):
    """Expected rows by plain dictionaries, as multisets: (doc_id, keep_id, size, sha, kept)."""
    groups = {}
    for i, t in rows:
        bare = (t or "").translate(dict.fromkeys(map(ord, " \t\n\v\f\r")))
        groups.setdefault(bare, []).append((-len(t or ""), i is None, i or 0))
    out = []
    for bare, own in groups.items():
        own.sort()
        keep = None if own[0][1] else own[0][2]
        out += [(None if x[1] else x[2], keep, len(own), hashlib.sha256(bare.encode()).hexdigest(), n == 0) for n, x in enumerate(own)]
    return sorted(map(str, out))


def told(df):
    return sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"], r["kept"])) for r in df.collect())


def write(spark, rows, path, files=3):
    spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 5, "z") for i, t in rows], SCHEMA).repartition(files).write.mode("append").parquet(path)


MADE = EDGE + [(20, "abcdef"), (21, "a b c d e f"), (22, "a\tb\nc d e  f"), (23, ""), (24, "é ß 日本 😀▁\\ </s>"), (25, "a bcdef"), (26, None)] + [(100 + i, "hot text " * (i % 2 + 1)) for i in range(60)]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_edges(spark, tmp_path, digest_bytes):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, a hot text; with one byte of digest many
    contents share it and are told apart by their bytes."""
    rows = MADE + [(1000 + i, f"text {i % 400}") for i in range(700)]
    write(spark, rows, f"{tmp_path}/in.parquet")
    dedup = exact_dedup.ExactDedup(spark, f"{tmp_path}/in.parque[t]", f"{tmp_path}/state", digest_bytes=digest_bytes)
    assert told(dedup.run().result()) == brute(rows)
    assert spark.read.parquet(f"{tmp_path}/state/split").isEmpty() == (digest_bytes == 32)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_goes_on_after_restarts(spark, tmp_path, digest_bytes):
    """New files meet the state of old ones, whose claims stay; a run without new files changes nothing."""
    parts = [MADE[:20], MADE[20:], [(500, "ABC"), (501, "a b c d e f      "), (502, "A B C")]]
    rows = []
    for part in parts:
        write(spark, part, f"{tmp_path}/in.parquet", 2)
        rows += part
        dedup = exact_dedup.ExactDedup(spark, f"{tmp_path}/in.parque[t]", f"{tmp_path}/state", files_a_batch=1, digest_bytes=digest_bytes)
        before = {r["digest"]: r["first"] for r in dedup.groups().collect()} if rows != part else {}
        assert told(dedup.run().result()) == brute(rows)
        after = {r["digest"]: r["first"] for r in dedup.groups().collect()}
        assert all(after[k] == v for k, v in before.items())
    assert told(dedup.run().result()) == brute(rows)


def test_failed_check_is_done_again(spark, tmp_path, monkeypatch):
    write(spark, MADE, f"{tmp_path}/in.parquet")
    dedup = exact_dedup.ExactDedup(spark, f"{tmp_path}/in.parque[t]", f"{tmp_path}/state")
    whole = exact_dedup.ExactDedup._compared
    monkeypatch.setattr(exact_dedup.ExactDedup, "_compared", lambda *_: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        dedup.run()
    monkeypatch.setattr(exact_dedup.ExactDedup, "_compared", whole)
    assert told(dedup.run().result()) == brute(MADE)


def test_lost_content_is_an_error(spark, tmp_path):
    """Bytes are read again from their places; a file that was replaced is noticed."""
    write(spark, MADE, f"{tmp_path}/in.parquet", 1)
    dedup = exact_dedup.ExactDedup(spark, f"{tmp_path}/in.parque[t]", f"{tmp_path}/state")
    dedup.arrive()
    dedup.claim()
    file = dedup.groups().first()["first"]["file"].removeprefix("file:").replace("//", "/")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/other")
    import glob
    import os
    import shutil

    for crc in glob.glob(f"{tmp_path}/in.parquet/.*.crc"):
        os.remove(crc)
    shutil.copy(glob.glob(f"{tmp_path}/other/*.parquet")[0], file)
    with pytest.raises(Exception, match="cannot be found"):
        dedup.check()


def test_empty(spark, tmp_path):
    write(spark, [], f"{tmp_path}/in.parquet", 1)
    assert exact_dedup.deduplicate(spark, f"{tmp_path}/in.parquet").count() == 0


def test_given_documents(spark, sf_dir):
    """The registered query and its SQL, each against the plain form."""
    import duckdb

    from finsignal.llm import queries

    want = brute([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    assert told(queries.QUERIES["op13_streaming_exact_dedup"](spark, sf_dir)) == want
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    found = con.sql(f"SELECT doc_id, keep_id, group_size, text_sha256, kept FROM ({queries.SQL_OP13})").fetchall()
    assert sorted(map(str, found)) == want
