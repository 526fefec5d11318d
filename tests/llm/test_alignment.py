import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import EDGE

from finsignal.llm import alignment
from finsignal.llm.spiece import MODEL


def encoded(texts):
    """(A ids, B ids, A bytes, B bytes) by the tokenizer libraries themselves; None where a text has no tokens."""
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(alignment.BYTE_MODEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = alignment.byte_letters()
    as_bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))

    def as_bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    out = []
    for text in texts:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [as_bytes_a(i) for i in ids[0]], [as_bytes_b(i) for i in ids[1]]
        good = text and all(b"".join(p) == (" " + text).encode() for p in parts)
        out.append((ids, parts) if good else None)
    return out


def brute(rows):
    """Expected rows by a walk over both lists, token by token."""
    docs = []
    for (doc_id, _), found in zip(rows, encoded([t for _, t in rows])):
        if found is None:
            docs.append((doc_id, 0, 0, 0, [], ""))
            continue
        (a, b), (pa_, pb) = found
        ends_b, at = {}, 0
        for j, p in enumerate(pb):
            at += len(p)
            ends_b[at] = j
        links, groups, at, i0, j0 = [], [], 0, 0, 0
        for i, p in enumerate(pa_):
            at += len(p)
            if at in ends_b:
                j = ends_b[at]
                links.append((a[i], b[j]))
                groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
                i0, j0 = i + 1, j + 1
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for d in docs for x in d[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return sorted((str(d[0]), d[1], d[2], d[3], len(d[4]), sum(count[x] == most[x[1]] for x in d[4]), sum(count[x] for x in d[4]), d[5]) for d in docs)


def rows_of(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in df.collect())


MADE = EDGE + [(10, "<|endoftext|> <s> </s> [INST]"), (11, "don't  stop\n\n\tnow 12345 ünïcödé 漢字 👩‍👩‍👧"), (12, "a" * 3000), (13, "▁"), (14, " leading"), (15, "x")]


@pytest.mark.parametrize("hot", [1 << 19, 8, 1])
def test_given_documents(spark, sf_dir, hot, monkeypatch):
    """Every given text against a plain walk; rare pairs by look-up, by the shuffle and by both."""
    monkeypatch.setattr(alignment, "HOT_SHARE", hot)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(alignment.align(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize(("steps", "groups", "block"), [(1 << 14, 1 << 18, 2 << 20), (7, 3, 50)])
def test_edges(spark, docs_of, steps, groups, block, monkeypatch):
    """Nulls, empty and long texts, repeats, control strings, marks; pieces and blocks of any size give the same."""
    monkeypatch.setattr(alignment.shared_ends, "__defaults__", (steps,))
    monkeypatch.setattr(alignment, "RENDER_GROUPS", groups)
    monkeypatch.setattr(alignment, "BATCH_BYTES", block)
    made = [r for r in MADE if steps > 7 or len(r[1] or "") < 5000]
    assert rows_of(alignment.align(docs_of(made))) == brute(made)
    assert alignment.align(docs_of([])).count() == 0


def test_pieces_of_a_merge():
    rng = np.random.default_rng(3)
    for n_a, n_b in ((0, 0), (0, 5), (40, 3), (200, 170)):
        a, b = (np.sort(rng.choice(400, size=n, replace=False)).astype(np.int64) for n in (n_a, n_b))
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        for steps in (1, 2, 5, 64, 1000):
            cut = alignment.diagonals(a, b, steps)
            assert cut.tolist() == [sum(side == 0 for _, side in merged[: min(k * steps, len(merged))]) for k in range(len(cut))]
            i, j = alignment.shared_ends(a, b, steps)
            assert a[i].tolist() == b[j].tolist() == sorted(set(a) & set(b))


def test_models_that_are_refused(tmp_path):
    import json

    with open(alignment.BYTE_MODEL, encoding="utf-8") as f:
        found = json.load(f)
    found["model"]["merges"].reverse()
    (tmp_path / "m.json").write_text(json.dumps(found))
    with pytest.raises(ValueError, match="order of merges"):
        alignment.load_byte_model(str(tmp_path / "m.json"))
