"""Benchmark decontamination with a generalised suffix automaton of the test items.

All items of a shard become one automaton over word ids. A document's words run
through it once; the automaton keeps the longest item passage that ends at each
word. Where that passage holds a window (``window`` words of an item, or a shorter
item as a whole), the window's words are hit.

The items are a stated query set. Their automata are built in tasks, one for each
``max_words`` item words, and written to the shared folder; each is broadcast on
its own, so what a task holds is bounded, and documents are never shuffled.

Defined results: a null or empty text has no words and no hits; a null or empty item
is no window; an item without an id hits but is not listed; equal items are all reported; repeated documents are judged one by
one; an empty benchmark leaves every document as it is; other columns pass through.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderata.llm.common import fresh, kept, ship
from moderata.session import settle

WINDOW = 10
MAX_COVERAGE = 0.5
# Words of one automaton: about 60 MB of Python dictionaries.
MAX_WORDS = 200_000

# Word characters are ASCII letters and digits and everything outside ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

MATCH = "struct<n_words:bigint, begins:array<int>, ends:array<int>, items:array<string>>"


class Automaton:
    """Suffix automaton over the words of several items.

    ``step[s]`` maps a word id to the next state, ``link`` and ``length`` are the
    usual suffix link and longest length. ``items[s]`` lists the items in which the
    passages of ``s`` occur, ``whole[s]`` the short items that are one of them and
    ``near[s]`` is the closest state on the link path, itself included, that has any.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[str | None, list[int], int]] = []
        for item, tokens in items:
            path, state = [], 0
            for token in tokens:
                state = self._extend(state, self.ids.setdefault(token, len(self.ids)))
                path.append(state)
            ends.append((item, path, len(tokens)))
        self.items: list[set[str | None]] = [set() for _ in self.step]
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for item, path, n in ends:
            for state in path:
                while state > 0 and item not in self.items[state]:
                    self.items[state].add(item)
                    state = self.link[state]
            if 0 < n < window:
                self.whole.setdefault(self._holding(path[-1], n), []).append((n, item))
        self.near = [0] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            self.near[state] = state if state in self.whole else self.near[self.link[state]]

    def _holding(self, state: int, n: int) -> int:
        """The state of the suffix of ``n`` words of a state's passages."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _clone(self, state: int, token: int, target: int) -> int:
        twin = len(self.step)
        self.step.append(dict(self.step[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = twin
        while state >= 0 and self.step[state].get(token) == target:
            self.step[state][token] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, token: int) -> int:
        known = self.step[last].get(token)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, token, known)
        new = len(self.step)
        self.step.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        while last >= 0 and token not in self.step[last]:
            self.step[last][token] = new
            last = self.link[last]
        if last >= 0:
            target = self.step[last][token]
            if self.length[target] == self.length[last] + 1:
                self.link[new] = target
            else:
                self.link[new] = self._clone(last, token, target)
        return new

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges, disjoint and in order, and the items that have a window there."""
        get, step, link, length = self.ids.get, self.step, self.link, self.length
        near, window = self.near, self.window
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        seen: set[int] = set()
        state = n = 0
        for i, token in enumerate(tokens):
            word = get(token)
            if word is None:
                state = n = 0
                continue
            following = step[state].get(word)
            while following is None and state:
                state = link[state]
                n = length[state]
                following = step[state].get(word)
            if following is None:
                continue
            state, n = following, n + 1
            longest = window if n >= window else 0
            if longest:
                holds = self._holding(state, window)
                if holds not in seen:
                    seen.add(holds)
                    found |= self.items[holds]
            at = near[state]
            while at:
                for size, item in self.whole[at]:
                    if size <= n:
                        found.add(item)
                        longest = max(longest, size)
                at = near[link[at]]
            if longest:
                begin = i + 1 - longest
                while hits and hits[-1][1] >= begin:
                    begin = min(begin, hits.pop()[0])
                hits.append((begin, i + 1))
        return hits, found


def split_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> list[Broadcast]:
    """Broadcast automata of ``benchmark(item_id, text)``, one per ``max_words`` item words.

    Shards are dealt by a hash of the item, so their number follows the benchmark
    and their size does not. Only built automata reach the driver, one at a time.
    """
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word and its separator take at least two bytes.
    shards = max(1, -(-n_bytes // (2 * max_words)))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        named = part["item"].astype(object).where(part["item"].notna(), None)
        pairs = [(item, split_words(text)) for item, text in zip(named, part["text"], strict=True)]
        return pd.DataFrame({"automaton": [pickle.dumps(Automaton([p for p in pairs if p[1]], window))]})

    built = settle(
        items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(build, "automaton binary")
    )
    return [spark.sparkContext.broadcast(row["automaton"]) for row in built.toLocalIterator()]


def matches(text: Column, shared: Broadcast) -> Column:
    """Words, hit ranges and matched items of a text, by one automaton."""
    key = hashlib.sha256(shared.value).digest()

    @F.pandas_udf(MATCH)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = kept("automaton", key, lambda: pickle.loads(shared.value))
        for batch in texts:
            rows = []
            for value in batch:
                tokens = split_words(value)
                hits, items = automaton.match(tokens)
                begins, ends = [a for a, _ in hits], [b for _, b in hits]
                rows.append((len(tokens), begins, ends, sorted(items - {None})))
            yield pd.DataFrame(rows, columns=["n_words", "begins", "ends", "items"])

    return scan(text)


def merged_hits(found: list[Column]) -> tuple[Column, Column]:
    """Number of distinct hit words, and the matched items, over the automata of all shards."""
    ranges = F.array_sort(F.concat(*[F.arrays_zip(f["begins"], f["ends"]) for f in found]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    total = F.aggregate(
        ranges,
        start,
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(r["ends"] - F.greatest(r["begins"], acc["upto"]), F.lit(0))).alias("n"),
            F.greatest(acc["upto"], r["ends"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    return total.cast("bigint"), F.array_sort(F.array_distinct(F.concat(*[f["items"] for f in found])))


def scan(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS
) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: words, hit words, and the items with occurring windows."""
    shared = automata(benchmark, window, max_words)
    if not shared:
        none = F.array().cast("array<string>")
        return docs.select(
            "doc_id",
            _word_count(F.col("text")).alias("n_words"),
            F.lit(0).cast("bigint").alias("n_hit"),
            none.alias("items"),
        )
    names = [f"_found{k}" for k in range(len(shared))]
    found = docs.select(
        "doc_id", *[matches(F.col("text"), s).alias(name) for name, s in zip(names, shared, strict=True)]
    )
    n_hit, items = merged_hits([F.col(name) for name in names])
    return found.select(
        "doc_id", F.col(f"{names[0]}.n_words").alias("n_words"), n_hit.alias("n_hit"), items.alias("items")
    )


@F.pandas_udf(T.LongType())
def _word_count(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(split_words(t))).astype("int64")


def digest(scanned: DataFrame) -> DataFrame:
    """Item list of :func:`scan` as a number and a digest."""
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """A text without the words of the given ranges; what stood between two words goes with them."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.lower())]
    kept, at = [], 0
    for begin, end in ranges:
        kept.append(raw[at : spans[begin][0]])
        at = spans[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut out of ``text``.

    A document with more than ``max_coverage`` of its words hit is dropped. All
    columns of ``docs`` are kept in their order.
    """
    shared = automata(benchmark, window, max_words)
    if not shared:
        return docs
    cleaned = fresh(docs, "_cleaned")
    keys = [hashlib.sha256(s.value).digest() for s in shared]

    # Matched and cut in one pass: two Python functions would take two workers per task.
    @F.pandas_udf("struct<text:string, coverage:double>")
    def without(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                tokens = split_words(text)
                found = []
                for part, key in zip(shared, keys, strict=True):
                    automaton = kept("automaton", key, lambda part=part: pickle.loads(part.value))
                    found += automaton.match(tokens)[0]
                joined = _union(sorted(found))
                n_hit = sum(end - begin for begin, end in joined)
                rows.append((cut(text, joined), n_hit / len(tokens)) if joined else (text, 0.0))
            yield pd.DataFrame(rows, columns=["text", "coverage"])

    # Else the filter below would be put under it, with a second run of its own.
    without = without.asNondeterministic()
    return (
        docs.withColumn(cleaned, without(F.col("text")))
        .where(F.col(cleaned)["coverage"] <= max_coverage)
        .select(*[F.col(cleaned)["text"].alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    )


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with overlapping and touching ones joined."""
    joined: list[tuple[int, int]] = []
    for begin, end in ranges:
        if joined and begin <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((begin, end))
    return joined
