import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import connect, differences
from pairsim.llm import chat
from pairsim.llm.queries import REGISTRY, SQL

SF = "/root/testdata/sf0.001"
PIECES = st.lists(st.sampled_from([*chat.CONTROL, "<", "|", "\\", "\n", "n", "s>", "é", "a", "/", "[", ">"]), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_round_trip(turns):
    chunks = [chat.format_turn(*t) for t in turns]
    assert chat.parse_turns("".join(c for c, _, _ in chunks)) == turns
    for (_, text), (chunk, a, b) in zip(turns, chunks):
        body = chunk[len(chat.START) : -len(chat.END) - 1]
        assert not any(c in body for c in chat.CONTROL)
        assert chat.unescape(chunk[a:b]) in (text, "")
    a = [chat.format_turn("assistant", t)[0:3] for _, t in turns]
    assert [chat.unescape(c[x:y]) for c, x, y in a] == [t for _, t in turns]


@pytest.mark.parametrize(
    "record, layout, turns",
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 4}, "dialogue", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\nthis"), ("assistant", "done")]),
        ({"instruction": "do", "input": None, "output": "done", "system": "be"}, "instruction", [("system", "be"), ("user", "do"), ("assistant", "done")]),
        ({"prompt": "q", "response": "a"}, "response", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "completion": "a", "meta": {"x": [1]}}, "completion", [("user", "q"), ("assistant", "a")]),
        ({"question": "q", "answer": 7}, "question", [("user", "q"), ("assistant", "7")]),
        ({"role": "human", "text": "t"}, "turn", [("human", "t")]),
        ({"role": "user"}, "turn", [("user", "")]),
        ({"prompt": "q", "output": "a"}, None, []),
        ([1], None, []),
    ],
)
def test_layouts(record, layout, turns):
    assert chat.record_turns(json.dumps(record)) == (layout, turns)


@pytest.mark.parametrize("record", [None, "", "{", "7"])
def test_no_record(record):
    assert chat.record_turns(record) == (None, [])


def test_query(spark):
    assert differences(REGISTRY["op5_chat"](spark, SF), connect(SF), SQL["op5_chat"]) == []


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 5, "assistant", "</s>"), (2, None, "assistant", "é" * 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as record", "2 as chunk")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_records(chat.turn_records(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 0), None: (1, 4), 2: (1, 9000)}
    assert got[1].turns_sha256 == sha("user\n\nuser\n\n\nx\n") and got[1].loss_sha256 == sha("")
    assert got[None].loss_sha256 == sha("</s>")
    assert chat.conversation_digests(chat.format_records(chat.turn_records(df.limit(0)))).collect() == []
    bad = spark.createDataFrame([(1, 0, '{"x": 1}'), (2, 0, None)], "conv_id long, turn long, record string")
    assert {(r.conv_id, r.layout, r.chunk) for r in chat.format_records(bad).collect()} == {(1, None, ""), (2, None, "")}
