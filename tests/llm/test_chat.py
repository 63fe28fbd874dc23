"""Chat formatting: exact round trips."""

import random

from oracle_check import compare
from pyspark.sql import functions as F

from riskframe.llm import chat

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    res = compare(spark, SF, names=["op3_chat_format"], verbose=False)
    assert res["op3_chat_format"][0] == "ok", res


def _round(df):
    out = chat.format_chats(df)
    return {
        r.conv_id: r
        for r in chat.with_loss_text(out).withColumn("back", chat.read_turns(F.col("formatted"))).collect()
    }


SCHEMA = "conv_id long, turn long, role string, text string, formatted string, ts int"


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(7)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[SEP]", "\\", "[", "<", "[\\INST]", "<\\\\s>", "é\U0001f600", " ", "\n", "", "<<SYS>>", "</SYS>>", "$1", "<|im_end|>", "INST]", "/s>"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "[INST]", ""])
            rows.append((c, t, role, "".join(rng.choices(bits, k=rng.randint(0, 12))), "f", 1))
    got = _round(spark.createDataFrame(rows, SCHEMA))
    for c in range(60):
        mine = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [(x.role, x.text) for x in got[c].back] == mine
        assert got[c].loss == "".join(t for r, t in mine if r == "assistant")
        assert got[c].n_turns == len(mine) == len([1 for _ in mine])
        runs = 1 + sum(a[0] != b[0] for a, b in zip(mine, mine[1:]))
        assert got[c].n_messages == runs == got[c].formatted.count("[/INST]</s>")
        for s, t in zip(got[c].loss_spans, [t for r, t in mine if r == "assistant"]):
            assert (s.end - s.start) >= len(t)


def test_edge_rows(spark):
    rows = [
        (1, 1, "assistant", None, None, 1),
        (1, 0, None, "hi", None, 1),
        (2, None, "user", "last", None, 1),
        (2, 5, "user", "first", None, 1),
        (3, 0, "user", "b", None, 1),
        (3, 0, "user", "b", None, 1),
        (3, 0, "user", "a", None, 1),
        (None, 0, "assistant", "x " * 100_000, None, 1),
    ] + [(9, i, "assistant" if i % 3 else "user", f"t{i}", None, 1) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = _round(df)
    assert [(x.role, x.text) for x in got[1].back] == [("", "hi"), ("assistant", "")]
    assert [x.text for x in got[2].back] == ["first", "last"] and got[2].n_messages == 1
    assert [x.text for x in got[3].back] == ["a", "b", "b"]
    assert got[None].loss == "x " * 100_000
    assert [x.text for x in got[9].back] == [f"t{i}" for i in range(5000)]
    assert got[9].loss == "".join(f"t{i}" for i in range(5000) if i % 3)
    assert chat.format_chats(df.where("false")).count() == 0
