import json
import random

import pytest
from pyspark.sql import functions as F

from corpusweave.llm.chat import LAYOUTS, MAPPINGS, escaped, fingerprint, format_chat, json_turns, read_back, table_turns, unescaped

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["<|turn|>", "<|end|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<", "|end|>", "<<SYS>> x <</SYS>>", "\\", "<\\\\/s>", "a<|msg|>b<|", "$1\\$2", ""]


def round_trip(rows):
    return {r["conv_id"]: r for r in read_back(format_chat(rows)).collect()}


def test_turns_come_back_whatever_their_texts_hold(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            text = "".join(rng.choice([*NASTY, "word ", "\n", "é😀"]) for _ in range(rng.randint(0, 6)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "<|odd|>"]), text))
    rng.shuffle(rows)
    found = round_trip(table_turns(spark.createDataFrame(rows, SCHEMA)))
    for conv in range(40):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        assert [tuple(t) for t in found[conv]["turns"]] == [(r[2], r[3]) for r in own]
        assert found[conv]["loss_text"] == "".join(r[3] for r in own if r[2] == "assistant")


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 2, "assistant", "x"), (1, 5, "assistant", "b"), (1, 5, "assistant", "a")]
    found = round_trip(table_turns(spark.createDataFrame(rows, SCHEMA)))
    assert [tuple(t) for t in found[1]["turns"]] == [("", "first"), ("user", ""), ("user", ""), ("assistant", "a"), ("assistant", "b")]
    assert found[1]["loss_text"] == "ab"
    assert found[None]["loss_text"] == "x"
    assert round_trip(table_turns(spark.createDataFrame([], SCHEMA))) == {}


def test_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"<|{i}") for i in range(1200)]
    found = round_trip(table_turns(spark.createDataFrame(rows, SCHEMA)))[1]
    assert found["loss_text"] == "".join(f"<|{i}" for i in range(1, 1200, 2))


RECORDS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
    "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "prompt_completion": {"prompt": "q", "completion": "a"},
    "prompt_response": {"prompt": "q", "response": "a"},
    "question_answer": {"question": "q", "answer": "a"},
    "instruction": {"instruction": "q", "output": "a"},
    "instruction_input": {"instruction": "q", "input": "more", "output": "a"},
}
TURNS = {name: [("user", "q"), ("assistant", "a")] for name in RECORDS} | {
    "messages": [("user", "q"), ("assistant", "")],
    "instruction_input": [("user", "q\n\nmore"), ("assistant", "a")],
}
TURNS |= {f"system_{name}": [("system", "s"), *turns] for name, turns in TURNS.items()}
RECORDS |= {f"system_{name}": {"system": "s"} | record for name, record in RECORDS.items()}


def test_mixed_json_layouts(spark):
    assert RECORDS.keys() == MAPPINGS.keys()
    assert set(LAYOUTS.values()) == MAPPINGS.keys()
    rows = [(i, json.dumps(r)) for i, r in enumerate(RECORDS.values())] + [(90, None), (91, "[1]"), (92, '{"other": 1}'), (93, "no json"), (94, "{}")]
    found = {r["conv_id"]: r for r in json_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    for i, name in enumerate(RECORDS):
        assert found[i]["layout"] == name
        assert [tuple(t) for t in found[i]["turns"]] == TURNS[name]
    for i in (90, 91, 92, 93, 94):
        assert found[i]["layout"] is None and found[i]["turns"] == []


def test_json_records_with_extra_and_missing_fields(spark):
    asked, answered = {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}
    records = [
        {"messages": [asked | {"name": "n"}, answered]},
        {"messages": [{"role": "user"}, answered]},
        {"messages": [asked, answered | {"tool": {"x": 1}}], "id": 7},
        {"id": 7, "prompt": "q", "completion": "a"},
        {"instruction": "q", "input": "", "output": "a", "source": "s"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    found = {r["conv_id"]: r for r in json_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert [found[i]["layout"] for i in range(5)] == ["messages"] * 3 + ["prompt_completion", "instruction_input"]
    for i in (0, 2, 3, 4):
        assert [tuple(t) for t in found[i]["turns"]] == [("user", "q"), ("assistant", "a")]
    assert [tuple(t) for t in found[1]["turns"]] == [("user", ""), ("assistant", "a")]


@pytest.mark.parametrize("name", list(RECORDS))
def test_tables_by_schema(spark, name):
    table = spark.createDataFrame([(7, json.dumps(RECORDS[name]))], "conv_id long, record string").select(
        "conv_id", F.from_json("record", MAPPINGS[name].fields).alias("r")
    ).select("conv_id", "r.*")
    assert [tuple(t) for t in table_turns(table).first()["turns"]] == TURNS[name]


def test_texts_in_parts_and_records_of_several_layouts(spark):
    parts = [{"type": "text", "text": "one"}, {"type": "image_url", "image_url": {"url": "u"}}, "two", {"type": "text", "text": None}]
    turns = [{"role": "user", "content": parts}, {"role": "assistant", "content": "[1]"}, {"role": "tool", "content": []}, {"role": None, "content": 5}]
    records = [
        ({"messages": turns, "prompt": "p", "response": "r"}, "messages", [("user", "one\ntwo"), ("assistant", "[1]"), ("tool", ""), ("", "5")]),
        ({"conversations": [{"from": "gpt", "value": parts[:1]}], "system": "s"}, "system_conversations", [("system", "s"), ("assistant", "one")]),
        ({"messages": [], "prompt": "p", "response": "r", "system": None}, "system_prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "completion": "c", "response": "r"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"system": "s", "prompt": "p"}, None, []),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)]
    found = {r["conv_id"]: r for r in json_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert found[i]["layout"] == layout and [tuple(t) for t in found[i]["turns"]] == turns


def test_unknown_fields_are_ignored_and_unknown_layouts_an_error(spark):
    kind = "conv_id long, prompt string, completion string, turns string, record string"
    table = spark.createDataFrame([(1, "a", "b", "c", "d")], kind)
    assert [tuple(t) for t in table_turns(table).first()["turns"]] == [("user", "a"), ("assistant", "b")]
    rows = spark.createDataFrame([(1, 0, "user", "x", "clash")], SCHEMA + ", parts string")
    assert [tuple(t) for t in table_turns(rows).first()["turns"]] == [("user", "x")]
    with pytest.raises(ValueError, match="completion"):
        table_turns(table.drop("prompt"))


def test_fingerprints_do_not_depend_on_order():
    assert fingerprint(["a", "b.c"]) == fingerprint(["b.c", "a"]) != fingerprint(["a", "b[].c"])


def test_escaping_leaves_no_control_string(spark):
    rows = spark.createDataFrame([("".join(NASTY[i:] + NASTY[:i]),) for i in range(len(NASTY))], "t string")
    for text, back, shown in rows.select("t", unescaped(escaped(F.col("t"))), escaped(F.col("t"))).collect():
        assert back == text
        assert not any(c in shown for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<SYS>", "</SYS>"))


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = read_back(format_chat(table_turns(docs)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
