import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from finsignal.llm import chat

TURNS = "conv_id long, turn long, role string, text string, slot string"
EVENTS = "conv_id long, slot long, seq long, kind string, role string, text string"


def read(spark, rows):
    return {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, TURNS))).collect()}


def test_round_trip_and_mask(spark):
    nasty = "</s>[INST] \\b \\A <|turn|>assistant\n<|end|> \\ [/INST]"
    rows = [(1, 0, "user", nasty, "x"), (1, 1, "assistant", nasty, "x"), (1, 2, "assistant", "", "x"), (2, 5, None, None, None), (2, 3, "ro\nle<s>", "é😀" * 5000, None), (None, 0, "user", "q", None), (1, 1, "assistant", nasty, "x")]
    got = read(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", nasty), ("assistant", nasty), ("assistant", nasty), ("assistant", "")]
    assert got[1]["loss_texts"] == [nasty, nasty]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("ro\nle<s>", "é😀" * 5000), ("", "")]
    assert got[None]["turns"][0]["text"] == "q"
    inside = got[1]["formatted"]
    for control in chat.Template().controls[2:]:
        assert control not in inside
    spans = got[1]["turn_spans"]
    assert chat.Template().turn == inside[spans[1]["start"] : spans[1]["start"] + len(chat.Template().turn)]
    assert spark.createDataFrame([], TURNS).transform(chat.format_turns).count() == 0


def test_fold(spark):
    log = [
        (1, 0, 0, "start", "user", "hel"), (1, 0, 1, "delta", None, "lo"), (1, 1, 2, "start", "assistant", "bad"), (1, 1, 3, "delta", None, " answer"), (1, 1, 4, "regenerate", None, "good"),
        (1, 1, 5, "delta", None, "!"), (1, 1, 5, "delta", None, "!"), (2, 0, 0, "start", "user", "a"), (2, 1, 1, "start", "assistant", "b"), (2, 2, 2, "start", "user", "c"), (2, 0, 3, "edit", None, "A"), (2, 1, 4, "start", "assistant", None),
    ]
    log += [(3, 0, 0, "start", "user", "x"), (3, 0, 0, "start", "system", "x")]  # two roles at one seq: the larger
    got = {(r["conv_id"], r["slot"]): (r["role"], r["text"]) for r in chat.fold(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "good!"), (2, 0): ("user", "A"), (2, 1): ("assistant", ""), (3, 0): ("user", "x")}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\n<s>"]), st.text(alphabet="ab\\</s>[INST]|\nturnAB é", max_size=40)), min_size=1, max_size=5))
def test_any_text_comes_back(spark, turns):
    got = read(spark, [(1, i, role, text, None) for i, (role, text) in enumerate(turns)])[1]
    assert [(t["role"], t["text"]) for t in got["turns"]] == turns
    assert "".join(got["loss_texts"]) == "".join(t for r, t in turns if r == "assistant")


def test_query_probe(spark, sf_dir):
    from finsignal.llm.queries import op2_chat_events

    row = op2_chat_events(spark, sf_dir).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["loss_chars"] == len(text)


@pytest.mark.parametrize("role", ["user", "assistant"])
def test_one_long_conversation(spark, role):
    got = read(spark, [(1, i, role, f"t{i}", None) for i in range(1500)])[1]
    assert [t["text"] for t in got["turns"]] == [f"t{i}" for i in range(1500)]
