from collections import Counter

import pytest
from pyspark.sql import functions as F

from moderata.operators import preferences

ROWS = [
    ("hello", "hi nice to meet you", True),
    ("how are you", "leave me alone", False),
    ("name?", "I have none", False),
    ("name?", "Mary", True),
    ("language?", "Python", True),
    ("language?", "C++", False),
    ("language?", "Java", False),
] + [("hot", f"good {i}", True) for i in range(25)] + [("hot", f"bad {i}", False) for i in range(4)]


@pytest.fixture
def rows(spark):
    numbered = [(i, *r) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(numbered, "id bigint, prompt string, completion string, label boolean")


@pytest.mark.parametrize("limit", [1000, 0])
def test_pairs_use_every_row_once_at_least(spark, rows, limit):
    pairs = preferences.pair(rows, ["id"], broadcast_rows=limit, rows_per_task=5).collect()
    assert Counter(p.prompt for p in pairs) == {"name?": 1, "language?": 2, "hot": 25}
    back = {(p.prompt, p.chosen, True) for p in pairs} | {(p.prompt, p.rejected, False) for p in pairs}
    assert back == {r for r in ROWS if r[0] in ("name?", "language?", "hot")}
    assert Counter(Counter(p.rejected for p in pairs if p.prompt == "hot").values()) == {6: 3, 7: 1}


def test_unpair_is_the_inverse(spark, rows):
    pairs = preferences.pair(rows, ["id"])
    back = {(r.prompt, r.completion, r.label) for r in preferences.unpair(pairs).collect()}
    assert back == {r for r in ROWS if r[0] in ("name?", "language?", "hot")}


def test_rendering(spark):
    df = spark.createDataFrame([("s", "q", "c", "r", 2), ("", "q", "c", "r", 0)], "sys string, prompt string, chosen string, rejected string, label int")
    paired = [tuple(r) for r in preferences.render_paired(df, system="sys").collect()]
    turn = "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"
    assert paired == [
        ("<|im_start|>system\ns<|im_end|>\n" + turn, "c<|im_end|>\n", "r<|im_end|>\n"),
        (turn, "c<|im_end|>\n", "r<|im_end|>\n"),
    ]
    single = [tuple(r) for r in preferences.unpaired(df, completion="chosen", system="sys").collect()]
    assert single == [("<|im_start|>system\ns<|im_end|>\nq", "c", True), ("q", "c", False)]


def test_lengths_and_weights(spark):
    df = spark.createDataFrame([("a b c d", "e f"), ("a", "b c d e f"), ("a", "b")], "prompt string, completion string")
    got = preferences.with_lengths(df, max_prompt_length=3, max_length=4)
    assert [(r.prompt_len, r.completion_len, r.truncated) for r in got.collect()] == [
        (3, 1, True), (1, 3, True), (1, 1, False),
    ]
    labels = spark.createDataFrame([(True,), (False,)], "label boolean")
    assert [r[0] for r in labels.select(preferences.weights(F.col("label"), 2, 0.5)).collect()] == [2.0, 0.5]


def test_turn_pairs(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"),
        (1, 4, "user", "u3"), (1, 7, "assistant", "a3"), (2, 0, "user", "u"), (3, 0, "assistant", "a"),
    ]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = preferences.with_heads(preferences.turn_pairs(df), df)
    assert sorted((r.conv_id, r.turn, r.prompt, r.completion, r.system) for r in got.collect()) == [
        (1, 2, "u1", "a1", "s"), (1, 7, "u3", "a3", "s"),
    ]
