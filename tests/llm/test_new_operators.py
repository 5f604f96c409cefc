"""Language of words, whitening and the prefix tree against brute force, and their edge rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from moderata.llm import decontamination, language_crf, prefix_trie, scans, whitening

CONVS = "conv_id bigint, turn bigint, role string, text string, depth string, n_convs int"


def trie_by_hand(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [(r, x) for _, r, x in sorted(v, key=lambda z: z[0])] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        sequence = tuple(convs.get(c - c % 5, [])[:h] + convs[c][h:])
        for d in range(len(sequence) + 1):
            members[sequence[:d]].append(c)
        ends[sequence].append(c)
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for s in members:
        if s:
            children[s[:-1]] += 1
    for s, m in members.items():
        value = (len(m) - 1) * len(s[-1][1].encode()) if s else 0
        for d in range(len(s) + 1):
            below[s[:d]][0] += children[s] == 0
            below[s[:d]][1] += value
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), children[s], *below[s], digest(s))
        for s, m in members.items()
    )


def trie(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in prefix_trie.prefix_nodes(df).collect())


@pytest.mark.parametrize("band, turns", [(32, 1 << 17), (4, 50)])
def test_prefix_nodes_match_brute_force(spark, monkeypatch, band, turns):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "PIECE", 30)
    rnd, rows = random.Random(2), []
    for c in range(30):
        for k in range(rnd.choice([0, 1, 3, 12, 90])):
            rows.append((c, k, rnd.choice(["a", None, "b"]), rnd.choice(["x", None, "é", ""]) if k > 2 else "t"))
    # Copies and one long conversation; a third of all rows each.
    rows += [(c, k, "u", f"hi{k % 3}") for c in range(100, 180) for k in range(6)]
    rows += [(401, k, "u", f"z{k}") for k in range(450)]
    rows += [(c, turn, "x", "same") for c in range(30, 33) for turn in (None, 4, 4)] + [(None, 1, "a", "b")]
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], CONVS).repartition(5)
    assert trie(df) == trie_by_hand(rows)


def test_an_empty_table_has_no_nodes(spark):
    assert trie(spark.createDataFrame([], CONVS)) == []


def test_double_array_holds_every_sequence_and_no_other():
    rnd = random.Random(8)
    sequences = sorted({tuple(rnd.randint(1, 40) for _ in range(rnd.randint(1, 7))) for _ in range(800)})
    made = prefix_trie.DoubleArray([list(s) for s in sequences])
    known = {s[:d] for s in sequences for d in range(1, len(s) + 1)}

    def walk(sequence):
        state = 0
        for number in sequence:
            state = made.child(state, number)
            if state < 0:
                return -1
        return state

    assert len({walk(s) for s in known}) == len(known) and all(walk(s) > 0 for s in known)
    others = {tuple(rnd.randint(1, 45) for _ in range(rnd.randint(1, 7))) for _ in range(2000)} - known
    assert all(walk(s) < 0 for s in others)


@pytest.mark.parametrize("descending", [False, True])
def test_running_folds_go_on_over_partitions(spark, descending):
    rnd, modulus, factor = random.Random(4), 1_000_003, 77
    rows = [(0, k, rnd.randint(0, 99)) for k in range(300)] + [(g, k, g + k) for g in range(1, 40) for k in range(g % 4)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g bigint, k bigint, v bigint").repartition(7)
    hashed = {(r["g"], r["k"]): r["s"] for r in scans.running(df, "g", "k", ["v"], ["s"], factor, modulus, descending).collect()}
    summed = {(r["g"], r["k"]): r["s"] for r in scans.running(df, "g", "k", ["v"], ["s"], descending=descending).collect()}
    want_hash, want_sum = {}, {}
    state = {}
    for g, k, v in sorted(rows, key=lambda r: (r[0], -r[1] if descending else r[1])):
        h, s = state.get(g, (0, 0))
        state[g] = want_hash[g, k], want_sum[g, k] = (h * factor + v) % modulus, s + v
    assert hashed == want_hash and summed == want_sum


VECTORS = "vec_id bigint, embedding array<double>, n string"


def test_whitening_matches_numpy(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 6)) @ rnd.normal(size=(6, 6))
    rows = [(i, row.tolist(), "own") for i, row in enumerate(x)]
    rows += [(0, x[0].tolist(), None), (900, None, "a"), (901, [], "a"), (902, [1.0, None] * 3, "a"), (903, [float("nan")] * 6, "a"),
             (904, [float("inf")] * 6, "a"), (905, [1.0], "a"), (None, x[1].tolist(), "a")]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3), n_components=4).collect()
    used = np.vstack([x, x[:1], x[1:2]])
    whole = np.floor(64 * used).astype(np.int64) + 1_000_000
    values, vectors = np.linalg.eigh(np.cov(whole.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = ((whole - whole.mean(axis=0)) @ vectors[:, :4]) / np.sqrt(values[:4])
    n, sums = len(whole), whole.sum(axis=0)
    deviation = [int(sum((n * v - s) ** 2 for v, s in zip(row.tolist(), sums.tolist()))) for row in whole]
    assert len(got) == 4 * n and {r["n"] for r in got} == {n}
    by_row = defaultdict(list)
    for r in got:
        by_row[r["vec_id"]].append(r)
    own = np.array([sorted((r["component"], r["whitened"]) for r in by_row[i]) for i in range(1, 200)])[:, :, 1]
    signs = np.sign((own * want[1:200]).sum(axis=0))
    assert np.abs(own * signs - want[1:200]).max() < 1e-9
    assert len(by_row[0]) == 8 and {r["deviation"] for r in by_row[7]} == {deviation[7]}
    assert np.allclose(sorted({r["explained"] for r in got}, reverse=True), values[:4] / values.sum(), rtol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_polarisation_equals_products():
    rnd = random.Random(6)
    for size in (1 << 10, 1 << 40, 1 << 59):
        y = np.array([[rnd.randint(-size, size) for _ in range(3)] for _ in range(40)])
        assert whitening.squared_sums(y) == [sum(int(v) ** 2 for v in y[:, j]) for j in range(3)]
    q = {(i, j): sum(int(a + b) ** 2 for a, b in zip(y[:, i], y[:, j])) for i in range(3) for j in range(i, 3)}
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) / 40**3 for j in range(3)] for i in range(3)]
    assert whitening.covariance(q, 3, 40).tolist() == want


def test_components_without_variance_are_null(spark):
    rows = [(i, [float(i), 1.0, 2.0 * i], "a") for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert [r["whitened"] is None for r in sorted(got)[:3]] == [False, True, True] and got[0]["identity_error"] < 1e-9
    same = whitening.whiten(spark.createDataFrame([(1, [1.0], "a"), (2, [1.0], "a")], VECTORS)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(0, None, None, None)] * 2
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, "a"), (2, [], "a")], VECTORS)).collect() == []


def chain_by_hand(scores, transitions, first):
    """Marginals, expected pairs and likelihood by all label sequences."""
    from itertools import product

    n, k = scores.shape
    p, pairs, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in product(range(k), repeat=n):
        w = first[path[0]] + sum(scores[t, c] for t, c in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:]))
        w = np.exp(w)
        total += w
        for t, c in enumerate(path):
            p[t, c] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    return p / total, pairs / total


def test_forward_backward_matches_all_paths(monkeypatch):
    rnd = np.random.default_rng(0)
    for block in (2, 3, 64):
        monkeypatch.setattr(language_crf, "BLOCK", block)
        sizes = [1, 4, 7, 2, 1, 5]
        scores = rnd.normal(size=(sum(sizes), 3)) * 2
        transitions, first = rnd.normal(size=(3, 3)), rnd.normal(size=3)
        begins = np.zeros(len(scores), dtype=bool)
        begins[np.cumsum([0, *sizes[:-1]])] = True
        made = language_crf.forward_backward(scores, begins, transitions, first)
        hand = [chain_by_hand(scores[e - s : e], transitions, first) for e, s in zip(np.cumsum(sizes), sizes)]
        assert np.allclose(made.marginals(), np.concatenate([p for p, _ in hand]))
        assert np.allclose(made.pairs(), sum(q for _, q in hand))


def test_ngrams_stay_inside_words():
    both, starts = language_crf.ngram_buckets(["abc", "é"])
    alone, _ = language_crf.ngram_buckets(["abc"])
    for order, (a, b) in enumerate(zip(both, alone), 2):
        assert (a[:5] == b).all() and (b > 0).sum() == 6 - order
    assert starts.tolist() == [0, 6]


LANGS = {"aa": "ka lo mi nu pa", "bb": "øst træ fløj går så", "cc": "xyz zzy qwx wqz yxq"}
DOCS = "doc_id bigint, text string, lang string, score string, lang_pred int"


def language_rows():
    rnd = random.Random(9)
    rows = []
    for i in range(240):
        lang = sorted(LANGS)[i % 3]
        rows.append((i, " ".join(rnd.choice(LANGS[lang].split()) for _ in range(60)), lang, "x", 5))
    return rows


def test_languages_of_held_out_texts_and_code_switches(spark):
    docs = spark.createDataFrame(language_rows(), DOCS)
    field = language_crf.fit(docs)
    assert field.languages == ["aa", "bb", "cc"]
    mixed = "12 ka lo mi nu, lo øst træ fløj går så træ zzy yxq xyz qwx"
    edges = [(1000, mixed, None, None, None), (1001, None, "aa", None, None), (1002, "", None, None, None),
             (1003, " \t12 !!\0", "bb", None, None), (1004, "ka " * 50_000, "bb", None, None), (None, "øst", None, None, None)]
    tagged = language_crf.tag(docs.unionByName(spark.createDataFrame(edges, DOCS)), field)
    assert tagged.columns == [*docs.columns, "lang_pred_", "score_", "spans"]
    rows = tagged.collect()
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and all(r["lang_pred_"] == r["lang"] and r["score_"] > 0.9 for r in held)
    by_id = {r["doc_id"]: r for r in rows}
    assert [(s["first"], s["upto"], s["lang"]) for s in by_id[1000]["spans"]] == [(0, 6, "aa"), (6, 12, "bb"), (12, 16, "cc")]
    for i in (1001, 1002, 1003):
        assert by_id[i]["lang_pred_"] == "und" and by_id[i]["score_"] == 0 and by_id[i]["spans"] == []
    assert by_id[1004]["lang_pred_"] == "aa" and len(by_id[1004]["spans"]) == 1 and by_id[None]["lang_pred_"] == "bb"


def test_held_out_rows_teach_nothing(spark):
    rows = [r for r in language_rows() if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    docs = spark.createDataFrame([*rows, (None, "ka", "aa", "x", 1), (5, "ka", None, "x", 1)], DOCS)
    field = language_crf.fit(docs)
    assert field.languages == [] and {r["lang_pred_"] for r in language_crf.tag(docs, field).collect()} == {"und"}
    assert language_crf.tag(docs.limit(0), field).collect() == []


def test_items_without_an_id_hit_and_are_not_listed(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "short one here"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, passage), ("b", f"{passage} more"), (None, "short one")], "item_id string, text string")
    rows = {r["doc_id"]: r for r in decontamination.scan(docs, items).collect()}
    assert [(rows[i]["n_words"], rows[i]["n_hit"], rows[i]["items"]) for i in (1, 2, 3)] == [(16, 14, ["b"]), (3, 2, []), (0, 0, [])]
