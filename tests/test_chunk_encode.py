import random
import re
import time

import pytest
from pyspark.sql import functions as F

from moderata.operators import chunking, encode

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+")
WORD = re.compile(r"[^ \t\r\n]+[ \t\r\n]*")


def brute_force(text, budget, overlap):
    pieces = []
    for s in SENTENCE.findall(text):
        words = WORD.findall(s)
        if len(words) <= budget:
            pieces.append((s, len(words)))
        else:
            runs = [words[i : i + budget] for i in range(0, len(words), budget)]
            pieces += [("".join(r), len(r)) for r in runs]
    chunks, current = [], []
    for piece in pieces:
        if sum(n for _, n in current) + piece[1] > budget:
            chunks.append(current)
            tail = []
            for p in reversed(current):
                if sum(n for _, n in tail) + p[1] > min(overlap, budget - piece[1]):
                    break
                tail.insert(0, p)
            current = tail
        current = current + [piece]
    if current:
        chunks.append(current)
    return [("".join(t for t, _ in c).strip(" \t\r\n"), sum(n for _, n in c)) for c in chunks if sum(n for _, n in c)]


@pytest.mark.parametrize("budget, overlap", [(10, 0), (10, 4), (7, 7), (512, 200)])
def test_chunks_match_brute_force(spark, budget, overlap):
    rng = random.Random(5)
    texts = ["", "   ", "one. two. three.", "w " * 95]
    for _ in range(40):
        texts.append("".join(rng.choice(["a ", "bb ", "c. ", "d!\n", "eee", "\n", "? "]) for _ in range(rng.randint(1, 120))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in chunking.chunk(df, chunk_size=budget, chunk_overlap=overlap).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_words))
        assert r.node_id == f"{r.doc_id}:{r.pos}" and r.n_words <= budget
    for i, text in enumerate(texts):
        assert got.get(i, []) == brute_force(text, budget, overlap), text


def test_many_sentences_take_time_in_proportion(spark):
    def seconds(n):
        text = " ".join(f"a{k % 7} b c d e f g h." for k in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        best = []
        for _ in range(2):
            began = time.perf_counter()
            assert chunking.chunk(df, chunk_size=64, chunk_overlap=24).count() > n / 8
            best.append(time.perf_counter() - began)
        return min(best)

    seconds(1000)
    assert seconds(64_000) < 3 * seconds(32_000)


def test_chunk_metadata_is_carried_or_joined(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    carried = chunking.chunk(docs, carry=["lang"]).select("node_id", "lang")
    joined = chunking.attach_metadata(chunking.chunk(docs), docs, ["lang"]).select("node_id", "lang")
    assert sorted(map(tuple, carried.collect())) == sorted(map(tuple, joined.collect()))
    plan = chunking.chunk(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("limit", [1000, 0])
def test_encode_fixed_length(spark, limit):
    corpus = spark.createDataFrame([("a a a b b c",)], "text string")
    vocabulary = encode.build_vocabulary(corpus, max_vocab=2)
    assert sorted((r.token, r.n, r.token_id) for r in vocabulary.collect()) == [("a", 3, 2), ("b", 2, 3)]
    rows = [(0, ""), (1, "b"), (2, "a c b a"), (3, "a c b a b"), (4, None)]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("label", F.col("id") % 2)
    got = encode.encode(
        df, vocabulary, "id", carry=["label"], max_length=4, pad_id=9, broadcast_rows=limit, rows_per_task=1
    )
    got = {r.id: r for r in got.collect()}
    assert {i: list(r.input_ids) for i, r in got.items()} == {
        0: [9, 9, 9, 9], 1: [3, 9, 9, 9], 2: [2, 1, 3, 2], 3: [2, 1, 3, 2], 4: [9, 9, 9, 9],
    }
    assert {i: sum(r.attention_mask) for i, r in got.items()} == {0: 0, 1: 1, 2: 4, 3: 4, 4: 0}
    assert all(list(r.attention_mask) == sorted(r.attention_mask, reverse=True) for r in got.values())
    assert {i: r.label for i, r in got.items()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0}


def test_budget(spark):
    length, batch = encode.budget(F.col("r"))
    rows = spark.createDataFrame([(False,), (True,)], "r boolean").select(length, batch).collect()
    assert [tuple(r) for r in rows] == [(256, 16), (1280, 8)]
