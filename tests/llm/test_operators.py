"""Edge rows and brute-force comparisons of the training-data operators."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from moderata.llm import common, decontamination, line_dedup, lm_scoring, ordinal, packing, quality_rules, sharding, simhash, warc
from moderata.llm import wrappers
from moderata.llm.tokens import tokens_of

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, _row string, shard int"
LONG = " ".join(f"w{i} common" for i in range(6000))
EDGES = [
    (1, None, "en", "x", 0), (2, "", None, None, None), (3, " \t\n ", "en", "x", 0), (4, "the same line here now", "en", "x", 1),
    (5, "the same line here now", "en", "x", 1), (5, "the same line here now", "en", "x", 1), (None, LONG, "de", "x", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_tokens_equal_the_tokenizer():
    rnd, ref, own = random.Random(3), Tokenizer.from_file(PATH), tokens_of(PATH)
    letters = "aAéÉßΣςİ 's't'LL12½!?-_ \x1c\x1d\t\nñ<|endoftext|>éﬁ漢🙂"
    for _ in range(400):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == ref.encode(text, add_special_tokens=False).ids


def test_packing_holds_every_piece_once(docs):
    rows = packing.pack(docs, PATH).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) == -(-total // packing.CAPACITY)
    assert Counter(r["doc_id"] for r in rows)[5] == 2


def test_solver_uses_the_histogram_exactly():
    rnd = random.Random(5)
    histogram = Counter(min(2048, 1 + int(rnd.expovariate(1 / 400))) for _ in range(2000))
    used = packing.solve(histogram)
    back = Counter()
    for config, times in used.items():
        assert sum(length * n for length, n in config) <= 2048
        for length, n in config:
            back[length] += n * times
    assert back == histogram
    assert sum(used.values()) <= 1.03 * -(-sum(k * n for k, n in histogram.items()) // 2048) + 1


def test_solver_prices_nearly_all_pieces(monkeypatch):
    rnd = random.Random(6)
    histogram = Counter(max(1, min(2048, int(rnd.lognormvariate(5.8, 0.8)))) for _ in range(20000))
    priced = packing._covering(np.bincount(list(histogram.elements()), minlength=2049), 2048, packing.ROUNDS, packing.RATE, packing.RESOLVES)
    sizes = []
    monkeypatch.setattr(packing, "_best_fit", lambda left, capacity: sizes.append(sum(left.values())) or Counter())
    packing._covering(np.bincount(list(histogram.elements()), minlength=2049), 2048, packing.ROUNDS, packing.RATE, packing.RESOLVES)
    assert max(sizes) < 0.15 * 20000
    assert sum(priced.values()) <= 1.005 * -(-sum(k * n for k, n in histogram.items()) // 2048) + 1


def test_best_fit_of_millions_is_counted():
    rnd = random.Random(7)
    for scale in (1, 10**6):
        left = Counter({rnd.randint(1, 100): rnd.randint(1, 9) * scale for _ in range(25)})
        back = Counter()
        packed = packing._best_fit(left, 100)
        for config, times in packed.items():
            assert times > 0 and sum(length * n for length, n in config) <= 100
            for length, n in config:
                back[length] += n * times
        assert back == left
        if scale == 1:
            rooms = []
            for length in sorted(left.elements(), reverse=True):
                room = min((r for r in rooms if r >= length), default=None)
                if room is None:
                    rooms.append(100 - length)
                else:
                    rooms[rooms.index(room)] -= length
            assert sum(packed.values()) == len(rooms)


def test_heap_schedule_equals_one_by_one():
    rnd = random.Random(2)
    classes = [(s, n, s * n) for s, n in ((rnd.randint(1, 500), rnd.randint(1, 200)) for _ in range(30))]
    classes = list({c[0]: c for c in classes}.values())
    loads = [0] * 16
    for size, n, _ in sorted(classes, reverse=True):
        for _ in range(n):
            loads[loads.index(min(loads))] += size
    got = [0] * 16
    for size, a, b, shard in sharding.schedule(classes):
        got[shard] += size * (b - a)
    assert sorted(got) == sorted(loads)


def test_shards_keep_groups_and_slots(docs, empty):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(EDGES)
    assert len({r["shard"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty).count() == 0


def test_simhash_against_all_pairs(spark):
    rnd = random.Random(4)
    values = {rnd.getrandbits(64) for _ in range(60)} | {0}
    for v in list(values):
        values |= {v ^ (1 << rnd.randrange(64)), v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))}
    ids = sorted(values)
    root = {v: v for v in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in ids:
        for b in ids:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    want = defaultdict(set)
    for v in ids:
        want[find(v)].add(v)
    signed = [(i, v - (1 << 64) if v >= 1 << 63 else v) for i, v in enumerate(ids)]
    rows = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    for shard_size in (4096,):
        got = defaultdict(set)
        for r in simhash.group(rows, shard_size=shard_size).collect():
            got[r["component_id"]].add(ids[r["doc_id"]])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_keeps_one_row_of_each_group(docs, empty):
    rows = simhash.deduplicate(docs)
    assert rows.columns == docs.columns
    kept = [r["doc_id"] for r in rows.collect()]
    assert sorted(kept, key=str) == [1, 4, None]
    assert simhash.deduplicate(empty).count() == 0


def test_line_dedup_with_frequent_shingles(docs, spark, empty):
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        line = list(base)
        line[rnd.randrange(60)] = f"x{rnd.randrange(9)}"
        rows.append((i, " ".join(line) + "\nshort line"))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = []
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            w = line.split()
            sets.append((i, k, frozenset(" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4)))))
    gone = Counter(
        b[0] for n, b in enumerate(sets) if any(5 * len(a[2] & b[2]) >= 4 * len(a[2] | b[2]) for a in sets[:n])
    )
    for frequent in (2, 50):
        got = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicate(table, frequent=frequent).collect()}
        assert got == {i: gone[i] for i, _ in rows}
    judged = {(r["doc_id"], r["n_lines"]): r["text"] for r in line_dedup.deduplicate(docs).collect()}
    assert judged[1, 0] is None and judged[4, 1] == "the same line here now" and judged[5, 1] == ""
    assert line_dedup.deduplicate(empty).count() == 0


def test_line_dedup_orders_chosen_and_other_lines_alike(spark):
    names = spark.range(400).selectExpr("concat('w', id) AS w").selectExpr("w", "xxhash64(w) AS h")
    w = [r["w"] for r in names.orderBy("h").collect()]
    # w[0] fills prefixes; w[13:16] are in many of its lines, but seldom in a prefix.
    lines = [[w[0], w[1 + 2 * i], w[2 + 2 * i], *w[13:16], *w[30 + 4 * i : 34 + 4 * i]] for i in range(6)]
    lines += [[w[0], *w[13:22]], [*w[13:22], w[-1]]]
    rnd = random.Random(12)
    for _ in range(60):
        line = rnd.choice([lines[-1], rnd.sample(w[:40], 10), rnd.sample(w, 10), rnd.choice(lines)])
        lines.append([rnd.choice(w) if rnd.random() < 0.08 else x for x in line])
    sets = [frozenset(x) for x in lines]
    want = {j: int(any(5 * len(a & b) >= 4 * len(a | b) for a in sets[:j])) for j, b in enumerate(sets)}
    assert want[7] == 1
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id bigint, text string")
    for n, frequent in ((8, 5), (len(lines), 3), (len(lines), 5), (len(lines), 9)):
        rows = line_dedup.deduplicate(table.where(f"doc_id < {n}"), size=1, frequent=frequent).collect()
        assert {r["doc_id"]: r["n_removed"] for r in rows} == {i: want[i] for i in range(n)}


def test_line_dedup_goes_on_with_connected_lines_only(spark, monkeypatch):
    rnd = random.Random(3)
    alone = [" ".join(f"a{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    near = [f"n{i}" for i in range(30)]
    rows = [(i, f"{line}\n\n \t\n{i}") for i, line in enumerate(alone)]
    rows += [(100, " ".join(near)), (101, " ".join([*near, "end"])), (102, "\n" + alone[5]), (103, ""), (104, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    fetched = []
    old = line_dedup._fetched
    monkeypatch.setattr(line_dedup, "_fetched", lambda *a: fetched.append(old(*a)) or fetched[-1])
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.deduplicate(table).collect()}
    assert got == {**dict.fromkeys(range(40), (2, 0)), 100: (1, 0), 101: (1, 1), 102: (1, 1), 103: (0, 0), 104: (0, 0)}
    assert [f.count() for f in fetched] == [2]
    left = {r["doc_id"] for r in line_dedup.deduplicate(table, drop_emptied=True).collect()}
    assert left == {*range(40), 100, 103, 104}


def test_line_dedup_leaves_lines_with_one_common_passage(spark, monkeypatch):
    passage = [f"p{i}" for i in range(8)]
    other = [[f"o{i}_{k}" for k in range(40)] for i in range(60)]
    rows = [(i, " ".join([*w[:20], *passage, *w[20:]])) for i, w in enumerate(other)]
    near = [f"n{i}" for i in range(48)]
    rows += [(100, " ".join(near)), (101, " ".join([*near[:47], "end"])), (102, "a b"), (103, "a b c"), (104, "a  b")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    fetched = []
    old = line_dedup._fetched
    monkeypatch.setattr(line_dedup, "_fetched", lambda *a: fetched.append(old(*a)) or fetched[-1])
    removed = {r["doc_id"] for r in line_dedup.deduplicate(table).where("n_removed > 0").collect()}
    assert removed == {101, 104}
    # The passage has four shingles, but few lines have all of them in their prefix.
    assert fetched[0].count() < 30 and {100, 101} <= {r["at"]["doc_id"] for r in fetched[0].collect()}


def test_line_dedup_equals_all_pairs(spark):
    rnd = random.Random(21)
    rows = []
    for i in range(150):
        line = rnd.choice(rows)[1].split() if rows and rnd.random() < 0.7 else [f"w{rnd.randrange(12)}" for _ in range(rnd.randint(1, 40))]
        for _ in range(rnd.randint(0, 2)):
            line[rnd.randrange(len(line))] = f"w{rnd.randrange(12)}"
        rows.append((i, " ".join(line[rnd.randrange(2):] or line)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (1, 2, 5):
        runs = [[tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] for w in (text.split() for _, text in rows)]
        sets = [frozenset(x) for x in runs]
        want = {j for j, b in enumerate(sets) if any(5 * len(a & b) >= 4 * len(a | b) for a in sets[:j])}
        for frequent in (4, 50):
            got = line_dedup.deduplicate(table, size=size, frequent=frequent).where("n_removed > 0")
            assert {r["doc_id"] for r in got.collect()} == want


def test_automaton_against_brute_force():
    rnd = random.Random(8)
    words = [b"a", b"b", b"c"]
    items = [(str(i), [rnd.choice(words) for _ in range(rnd.randint(1, 9))]) for i in range(12)]
    automaton = decontamination.Automaton(items, 4)
    for _ in range(200):
        text = [rnd.choice(words + [b"z"]) for _ in range(rnd.randint(0, 30))]
        hit, found = set(), set()
        for item, own in items:
            n = min(4, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            for i in range(len(text) - n + 1):
                if tuple(text[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(item)
        ranges, got = automaton.match(text)
        assert ({p for a, b in ranges for p in range(a, b)}, got) == (hit, found)


def test_decontamination_in_shards(spark, docs):
    items = [(i, " ".join(f"k{i}x{j}" for j in range(12))) for i in range(6)] + [(9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(1, f"start {items[2][1]} end " + "more words " * 20), (2, items[3][1]), (3, None), (4, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for max_words in (10, 1000):
        scanned = {r["doc_id"]: r for r in decontamination.scan(table, bench, max_words=max_words).collect()}
        assert [(scanned[i]["n_hit"], scanned[i]["items"]) for i in (1, 2, 3, 4)] == [(12, ["2"]), (12, ["3"]), (0, []), (0, [])]
        cleaned = {r["doc_id"]: r["text"] for r in decontamination.clean(table, bench, max_words=max_words).collect()}
        assert set(cleaned) == {1, 3, 4} and "k2x" not in cleaned[1] and cleaned[1].startswith("start")
    assert decontamination.clean(docs, bench.limit(0)).count() == len(EDGES)


def test_warc_round_trip(spark):
    rows = [(3, "http://b.example/x?b=1&a=2", "<p>same</p>"), (1, "http://a.example/", "<p>same</p>"), (7, None, None),
            (8, "http://a.example/#t", ""), (9, "http://a.example/", "WARC/1.1\r\n\r\nü")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    records, index = warc.archive_and_read(pages)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in records.collect()}
    assert got == {1: ("response", None, 11), 3: ("revisit", 1, 11), 7: ("response", None, 0), 8: ("revisit", 7, 0),
                   9: ("response", None, 14)}
    ordered = [(r["url_key"], r["captured"], r["page_id"]) for r in index.orderBy("range", "place").collect()]
    assert ordered == sorted(ordered)


def test_loser_tree_merges():
    rnd = random.Random(1)
    for k in range(9):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_pages_are_read_along_their_wrapper(spark):
    page = (
        "<html><body><header><h1>Site</h1></header><div class='menu'><a href=/>Home</a></div>{main}"
        "<div id='comments'><p>First!</p></div><form><input name=q></form><footer>&copy; x</footer></body></html>"
    )
    article = "<article><header><h2>Title</h2><p>by me</p></header><p>One &amp; <b>two<br>three<p>Four</p><aside>ad</aside></article>"
    rows = [
        (1, "http://h/1", page.format(main=article)), (2, "http://h/2", page.format(main=article.replace("<p>Four</p>", ""))),
        (3, "http://g/1", page.format(main="<div class='content'><p>Plain text</p></div>")), (4, None, None), (5, "", ""),
    ]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "Title\n\nOne & two three\n\nFour", 2: "Title\n\nOne & two three", 3: "Plain text", 4: "", 5: ""}


def _texts_of(pages):
    trees = [wrappers.parse(p) for p in pages]
    host = wrappers.shape(trees[0])
    for tree in trees[1:]:
        host = wrappers.align(host, wrappers.shape(tree))
    reader = wrappers.Reader(host)
    return [reader.blocks(t) for t in trees]


def test_templates_of_one_host_are_read_page_by_page(spark):
    menu = "<div class=menu><a href=/>Home</a></div>"
    kinds = ["<article><p>An article</article>", "<main><p>A main text</main>", "<div class=content><p>Some content</div>",
             "<div class=x><p>Just a body</div>"]
    want = ["An article", "A main text", "Some content", "Just a body"]
    pages = [f"<html><body>{menu}{kind}<footer>end</footer></body></html>" for kind in kinds]
    assert _texts_of(pages) == [[w] for w in want]
    rows = [(i, [None, "/a", "http://[", "x"][i], page) for i, page in enumerate(pages)]
    rows += [(10 + i, "http://h/", page) for i, page in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(table).collect()}
    assert got == {i: want[i % 10] for i, _, _ in rows}
    # Without text outside the menu a page stays empty.
    assert _texts_of([*pages, f"<html><body>{menu}<div class=cookie-notice>We use cookies</div></body></html>"])[4] == []


def test_names_do_not_drop_what_holds_the_article():
    text = "<p>The text itself, long enough to lead.<p>More."
    want = ["The text itself, long enough to lead.", "More."]
    for page in (
        f"<html class=has-menu><body class='no-sidebar'><article>{text}</article></body></html>",
        f"<body class='single header-fixed'><div class=content>{text}</div></body>",
        f"<body><div class='content with-sidebar'>{text}</div><div class=sidebar>Side</div></body>",
        f"<body><article class='post tag-social'>{text}<article class=comment>First!</article></article></body>",
        f"<body><div id=page-with-menu>{text}<div id=comments>First!</div></div></body>",
        f"<body><main class=notice-page>{text}</main></body>",
    ):
        assert _texts_of([page]) == [want], page
    # A template of few pages of a host is judged by itself.
    other = f"<body><article>{text * 9}</article></body>"
    assert _texts_of([other, f"<body><div class='content with-sidebar'>{text}</div></body>"])[1] == want
    titled = f"<body><div class=site-header><h1>Site</h1></div><article><div class=article-header><h1>T</h1><p>by</div>{text}</article>"
    assert _texts_of([titled]) == [["T", *want]]
    formula = "<body><article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object data=a><param name=b>none</object>.</article>"
    assert _texts_of([formula]) == [["So x=1 and none."]]


def test_alignment_makes_optional_and_repeated_groups():
    shapes = [wrappers.shape(wrappers.parse(p)) for p in ("<ul><li>a<li>b</ul><p>x", "<div>n</div><ul><li>c</ul><p>y")]
    assert wrappers.pattern(wrappers.align(*shapes)) == "(<div>#</div>)?<ul>(<li>#</li>)+</ul><p>#</p>"


def test_classifier_on_held_out_rows():
    rnd = random.Random(9)
    make = lambda g: " ".join(rnd.choice(["good", "plain", "text", "word"]) + str(rnd.randrange(50)) for _ in range(40)) + {0: " ||| !!!", 1: " nasty vile", 2: ""}[g]
    labels = np.array([rnd.choice([0, 1, 2]) for _ in range(600)])
    texts = [make(g) for g in labels]
    model = ordinal.fit_rows([ordinal.features(t) for t in texts[:400]], labels[:400])
    tails = model.tails(np.array([model.score(t) for t in texts[400:]]))
    assert model.thresholds[0] < model.thresholds[1]
    assert ((tails > 0.5).sum(axis=1) == labels[400:]).mean() > 0.95


def test_classifier_keeps_no_blank_text(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (99, 1, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = ordinal.with_grades(docs, ordinal.fit(docs, labels)).collect()
    assert len(rows) == len(EDGES) and not any(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))


def test_language_model_scores(docs, spark):
    rnd = random.Random(7)
    line = lambda: " ".join(rnd.choice(["the cat sat", "a dog ran", "we all saw"]) for _ in range(30))
    table = spark.createDataFrame([(i, line()) for i in range(60)], "doc_id bigint, text string")
    model = lm_scoring.fit(table, rounds=1)
    natural = line()
    mixed = natural.split()
    rnd.shuffle(mixed)
    score = lambda t: model.log_probabilities(lm_scoring.token_ids(t)).sum()
    assert score(natural) > score(" ".join(mixed))
    around, target = lm_scoring.windows([model.classes[lm_scoring.token_ids("the cat sat")]])
    one = [model.forward([a[i : i + 1] for a in around])[1][0][target[i]] for i in range(3)]
    ids = lm_scoring.token_ids("the cat sat")
    assert np.allclose(model.log_probabilities(ids), np.array(one) + model.log_share[ids], atol=1e-5)
    rows = {r["doc_id"]: r for r in lm_scoring.score(docs, model).collect()}
    assert rows[1]["n_tokens"] == 0 and rows[1]["mean_log_prob"] is None and rows[None]["n_tokens"] == 12000


def test_tokens_of_a_shared_class_are_told_apart():
    counts = np.zeros(lm_scoring.N_IDS, dtype=np.int64)
    counts[: lm_scoring.N_SINGLE], counts[[200, 201]] = 100_000, 1000
    model = lm_scoring.new_model(counts)
    assert model.classes[200] == model.classes[201] >= lm_scoring.N_SINGLE
    score = lambda m, ids: m.log_probabilities(np.array(ids))[1]
    # Untrained, a token has its corpus share.
    assert score(model, [1, 200, 1]) == pytest.approx(score(model, [1, 201, 1]), abs=1e-5)
    trainer = lm_scoring.Trainer(model)
    for _ in range(60):
        trainer.train([np.array(d) for d in ([1, 200, 1], [2, 201, 2], [200, 5, 200], [201, 6, 201])] * 20)
    made = trainer.model
    # The same class and the same share, so that only what stands around decides; and the other way round.
    assert score(made, [1, 200, 1]) > score(made, [1, 201, 1]) + 1 and score(made, [2, 201, 2]) > score(made, [2, 200, 2]) + 1
    assert score(made, [200, 5, 200]) > score(made, [201, 5, 201]) + 1
    every = np.arange(lm_scoring.N_IDS)
    total = sum(np.exp(made.scores([np.array([1, i, 2]) for i in part])[1::3]).sum() for part in np.array_split(every, 8))
    assert total == pytest.approx(1, abs=1e-3)


def test_averages_of_a_row_follow_how_often_it_was_met():
    rows = lambda met, weights: (3, np.array(met, np.float32), np.array(weights, np.float32))
    batch = lm_scoring._piece_batch([rows([1, 0, 0], [[1], [9], [9]]), rows([3, 2, 0], [[5], [4], [9]])], np.float32)
    made = next(lm_scoring._summed(iter([batch]))).to_pylist()[0]
    assert made["piece"] == 3 and np.frombuffer(made["met"], np.float32).tolist() == [4, 2, 0]
    assert np.frombuffer(made["weights"], np.float32).tolist()[:2] == [4, 4]


def test_word_numbers_keep_no_table():
    common.forget()
    words = [f"wört{i}" for i in range(2000)]
    want = [zlib.crc32(w.encode()) % lm_scoring.N_IDS for w in words]
    assert lm_scoring.token_ids(" \n".join(words)).tolist() == want
    assert lm_scoring.token_ids(None).tolist() == lm_scoring.token_ids(" ").tolist() == []
    assert not common._KEPT


def test_quality_rules_on_edge_rows(docs, empty):
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs, min_reference_words=10).collect()}
    assert rows[1]["n_words"] == 0 and rows[1]["base_failed"] and not rows[1]["kept"]
    assert rows[None]["n_words"] == 12000 and rows[None]["n_repeat_words"] == 0
    assert quality_rules.judge(empty).count() == 0


def test_text_without_common_words_is_not_kept(spark):
    rnd = random.Random(10)
    common = quality_rules.COMMON_WORDS["en"]
    other = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    text = lambda n, share: " ".join(rnd.choice(common if rnd.random() < share else other) for _ in range(n))
    rows = [(i, text(rnd.choice([60, 250, 900]), 0.2), "en") for i in range(60)] + [(99, text(250, 0), "en")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(table, min_reference_words=10).collect()}
    assert not kept.pop(99) and all(kept.values())


def test_digest_of_no_items(spark):
    table = spark.createDataFrame([(1, 0, 0, [])], "doc_id bigint, n_words bigint, n_hit bigint, items array<string>")
    assert decontamination.digest(table).first()["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_common_places_agree_with_the_whole_table():
    def table(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = max(best[i + 1][j + 1] + (a[i] == b[j]), best[i + 1][j], best[i][j + 1])
        return best[0][0]

    draw = random.Random(3)
    for _ in range(400):
        a, b = ([draw.choice("pqrst") for _ in range(draw.randrange(14))] for _ in range(2))
        pairs = wrappers._common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == table(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    a, b = ([draw.choice("pqrst") for _ in range(20_000)] for _ in range(2))
    assert len(wrappers._common(a, b)) > 10_000


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 100_000 + "inner words" + "</div>" * 100_000 + "<p>after</p>"
    nested = "".join(f"<section><p>part {i} of the text</p>" for i in range(2000)) + "</section>" * 2000
    draw = random.Random(4)
    wide = ["".join(f"<{t}>w{i}</{t}>" for i, t in enumerate(draw.choices(["p", "pre", "div", "h2"], k=20_000))) for _ in range(2)]
    rows = [(i, f"http://h{min(i, 2)}.org/{i}", page) for i, page in enumerate([deep, nested, *wide])]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(table).collect()}
    assert got[0] == "inner words\n\nafter"
    assert got[1].split("\n\n") == [f"part {i} of the text" for i in range(2000)]
    assert got[2].split() == [f"w{i}" for i in range(20_000)] and got[3].split() == got[2].split()


def test_line_dedup_reads_every_blank_alike(spark):
    line = " ".join(f"w{i}" for i in range(12))
    texts = [line, line.replace(" ", "\t"), f"\r{line}\x0b\n \x0c\r\t \n", f"  {line.replace(' ', ' \x0c ')}", "\x0b\t", None, "a b"]
    got = line_dedup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in got.orderBy("doc_id").collect()] == [
        (line, 1, 0), ("", 1, 1), (" \x0c\r\t \n", 1, 1), ("", 1, 1), ("\x0b\t", 0, 0), (None, 0, 0), ("a b", 1, 0),
    ]
