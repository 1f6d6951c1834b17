import hashlib
import json

import pytest

from treelift.llm.chat_format import canonical_json, canonical_turns, chat_digests, format_turns, layout_of, read_back

TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "\\[/INST]", "\\\\ [INST]", " [/INST]", "<<SYS>> x <</SYS>>", "[ROLE:dXNlcg==] y [/ROLE]", "a\\", "\n", "日本 é", "<\\</s>", "$1 \\1"]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_round_trip(spark):
    roles = ["system", "user", "assistant", "tool] x", "", None]
    rows = [(c, t, roles[(c + t) % 6], TEXTS[(c * 5 + t) % len(TEXTS)]) for c in range(40) for t in range(9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    formatted = format_turns(canonical_turns(frame))
    for r in read_back(formatted).collect():
        want = [(role or "", text) for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss_texts == [text for role, text in want if role == "assistant"]
    for r in chat_digests(canonical_turns(frame)).collect():
        want = [(role or "", text) for c, _, role, text in rows if c == r.conv_id]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(b for a, b in want if a == "assistant").encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None, "user", None), (1, 0, None, "b"), (1, 0, None, "b"), (None, 0, "user", "n")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as turns", "2 as formatted", "3 as messages")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in canonical_turns(frame).collect()}
    assert got == {1: [("user", ""), ("", "b"), ("", "b")], None: [("user", "n")]}
    assert chat_digests(canonical_turns(frame.limit(0))).count() == 0


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "x": 1}, "messages"),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from_value"),
    ({"instruction": "q", "input": "i", "output": "a"}, "instruction_input"),
    ({"instruction": "q", "output": "a"}, "instruction"),
    ({"prompt": "q", "completion": "a", "id": 3}, "prompt_completion"),
    ({"prompt": "q", "response": "a"}, "prompt_response"),
    ({"question": "q", "answer": "a"}, "question_answer"),
]


def test_layouts_row_by_row(spark):
    rows = [(k, json.dumps(r)) for k, (r, _) in enumerate(RECORDS)] + [(90, "{}"), (91, "no json"), (92, None)]
    got = {r.conv_id: r for r in canonical_json(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    for k, (_, name) in enumerate(RECORDS):
        assert got[k].layout == name
        first = "q\n\ni" if name == "instruction_input" else "q"
        assert [(t.turn, t.role, t.text) for t in got[k].turns] == [(0, "user", first), (1, "assistant", "a")]
    assert all(got[k].layout is None and got[k].turns == [] for k in (90, 91, 92))


def test_layouts_by_schema(spark):
    for record, name in RECORDS:
        frame = spark.read.json(spark.sparkContext.parallelize([json.dumps(record)])).selectExpr("7L as conv_id", "*")
        assert layout_of(frame.schema).name == name
        assert [t.role for t in canonical_turns(frame).first().turns] == ["user", "assistant"]
    with pytest.raises(ValueError):
        canonical_turns(spark.range(1))
