import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestar.llm import chat

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "[INST] ", "\\", "<", "/s>", "\n", "ok", " ", "é", "😀", "[", "]", "<\\s>", "$1"]


def back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    return {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "x\\"]), st.lists(st.sampled_from(PIECES), max_size=8)), min_size=1, max_size=6), min_size=20, max_size=20))
def test_everything_is_read_back(spark, conversations):
    rows = [(c, t, role, "".join(parts), 0) for c, turns in enumerate(conversations) for t, (role, parts) in enumerate(turns)]
    got = back(spark, rows)
    for c, turns in enumerate(conversations):
        assert [(t.role, t.text) for t in got[c].turns] == [(role, "".join(parts)) for role, parts in turns]
        assert got[c].loss == "".join("".join(parts) for role, parts in turns if role == "assistant")


def test_examples(spark):
    rows = [(1, 2, "assistant", "A1", 0), (1, 1, "user", "U1", 0), (1, 4, "assistant", "A[INST]2", 0), (1, 3, "user", "U2", 0), (1, 5, "user", "tail", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    got = chat.expand(df).orderBy("example").collect()
    assert [r.turns for r in got] == [2, 4, 5]
    assert [r.text[r.loss_start - 1 : r.loss_start - 1 + r.loss_length] for r in got[:2]] == ["A1", "A[\\INST]2"]
    assert got[2].loss_length is None
    assert got[0].text == "<s>[INST] user\nU1 [/INST]</s><s>assistant\nA1</s>"
    assert all(r.text.count("[INST]") == sum(1 for k in range(r.turns) if k % 2 == 0) for r in got)


def test_edges(spark):
    rows = [(None, None, None, None, 1), (2, 1, "assistant", None, 1), (3, 1, "user", "x" * 300_000, 1), (4, 1, "assistant", "a", 1), (4, 1, "assistant", "a", 1)]
    got = back(spark, rows)
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert got[2].loss == "" and got[3].loss == "" and got[4].loss == "aa"
    assert hashlib.md5(got[3].turns[0].text.encode()).hexdigest() == hashlib.md5(b"x" * 300_000).hexdigest()
    assert back(spark, []) == {}


def test_very_long_roles_and_texts(spark):
    role, text = "r\\\n" * 300_000, "t\n\\[INST]" * 100_000
    got = back(spark, [(1, 1, role, text, 0), (1, 2, "assistant", text, 0)])[1]
    assert [(t.role, t.text) for t in got.turns] == [(role, text), ("assistant", text)] and got.loss == text


def test_only_dataframe_operations(spark):
    df = spark.createDataFrame([(1, 1, "user", "x", 1)], "conv_id long, turn long, role string, text string, example int")
    plan = chat.read_back(chat.expand(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
