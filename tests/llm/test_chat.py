import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardflow.llm import chat, queries

from .util import SMALL, rows, table


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest(said), len(loss), digest(loss)


def test_table_round_trip(spark):
    turns = {}
    for r in sorted(table(SMALL, "conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    out = queries.op3_chat_formatting(spark, SMALL).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == {c: want(t) for c, t in turns.items()}


def one(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    done = chat.format_turns(df, ["conv_id"], ["turn"])
    return done.select(
        "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).first()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a b\n<é%", ""]), st.lists(
    st.sampled_from([*chat.CONTROL, "\\", "\n", "<", "[", "|", "é😀", "im_end|>", "$0", "%0A", " "]), max_size=8).map("".join)), max_size=5))
def test_round_trip(spark, turns):
    if not turns:
        return
    got = one(spark, turns)
    assert [tuple(t) for t in got.back] == turns
    assert got.loss == "".join(t for r, t in turns if r == "assistant")
    inside = got.formatted
    for role, _ in turns:
        inside = inside.replace(chat.OPEN, "", 1).replace(chat.CLOSE, "", 1)
    assert not any(c in inside for c in chat.CONTROL)


def test_layouts(spark):
    user, bot = ("user", "q"), ("assistant", "a")
    cases = [
        ({"role": "user", "text": "q"}, "turn", [user]),
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "id": 3}], "n": 1}, "messages", [user, bot]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [user, bot]),
        ({"instruction": "q", "input": "i", "output": "a"}, "instruction", [("user", "q\ni"), bot]),
        ({"instruction": "q", "input": "", "output": "a", "system": "s"}, "instruction", [("system", "s"), user, bot]),
        ({"prompt": "q", "response": "a"}, "prompt", [user, bot]),
        ({"completion": "a", "prompt": "q", "source": "x"}, "completion", [user, bot]),
        ({"question": "q", "context": "c", "answer": "a"}, "question", [("user", "c\nq"), bot]),
        ({"role": None, "text": None}, "turn", [("", "")]),
        ({"other": 1}, None, []),
        ([1, 2], None, []),
    ]
    texts = [json.dumps(c[0]) for c in cases] + ["not json {", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, record string")
    out = {r.i: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical(df).collect()}
    assert out == {i: (c[1], c[2]) for i, c in enumerate(cases)} | {i: (None, []) for i in range(len(cases), len(texts))}


def test_fields_of_several_layouts(spark):
    system, user, bot = ("system", "s"), ("user", "q"), ("assistant", "a")
    listed = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    said = [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]
    cases = [
        ({"instruction": "q", "input": "", "output": "a", "text": "### q a"}, "instruction", [user, bot]),
        ({"prompt": "q", "prompt_id": "7", "messages": listed}, "messages", [user, bot]),
        ({"instruction": "q", "context": "c", "response": "a", "category": "x"}, "instruction_response", [("user", "q\nc"), bot]),
        ({"instruction": "q", "context": "c", "output": "a"}, "instruction", [("user", "q\nc"), bot]),
        ({"prompt": "q", "response": "a", "completion": "b"}, "prompt", [user, bot]),
        ({"prompt": "q", "context": "c", "completion": "a", "role": "r"}, "completion", [("user", "c\nq"), bot]),
        ({"question": "q", "answer": "a", "text": "t", "role": "r"}, "question", [user, bot]),
        ({"role": "user", "text": "q", "system": "x"}, "turn", [user]),
        ({"system": "s", "messages": listed}, "messages", [system, user, bot]),
        ({"system": "x", "messages": [{"role": "system", "content": "s"}, *listed], "text": "t"}, "messages", [system, user, bot]),
        ({"system": "s", "conversations": said, "output": "o"}, "conversations", [system, user, bot]),
        ({"instruction": "q", "output": "a", "messages": []}, "instruction", [user, bot]),
        ({"prompt": "q", "answer": "a"}, None, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "i int, record string")
    out = {r.i: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical(df).collect()}
    assert out == {i: c[1:] for i, c in enumerate(cases)}


def test_hard_cases(spark):
    kind = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([
        (None, None, None, None), (1, 0, "user", None), (1, 1, "assistant", "x" * 300_000), (2, 5, "user", "b"), (2, 5, "user", "a"), (2, 5, "user", "a"),
        *[(3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(500)],
    ], kind)
    out = {r.conv_id: r for r in chat.formatted_conversations(df.withColumn("said", F.lit(1)).withColumn("turns", F.lit(2))).collect()}
    assert out[None].n_turns == 1 and out[None].loss_chars == 0
    assert out[1].loss_chars == 300_000
    assert (out[2].n_turns, out[2].turns_sha256) == want([("user", "a"), ("user", "a"), ("user", "b")])[:2]
    turns = [("assistant" if i % 2 else "user", f"t{i}") for i in range(500)]
    assert (out[3].n_turns, out[3].turns_sha256, out[3].loss_chars, out[3].loss_sha256) == want(turns)
    assert chat.formatted_conversations(spark.createDataFrame([], kind)).count() == 0
    assert rows(chat.formatted_conversations(df.limit(0))) == []
