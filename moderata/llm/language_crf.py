"""Language of each word in code-switched text by a linear-chain conditional random field.

A text is the chain of its words, split at white space and lower-cased; the labels are the languages.
Features of a word:

* n-grams: its byte sequences of 2 to 4, marks at both ends included, hashed to ``N_BUCKETS`` weights per language;
* affixes: those of them that hold a mark are its first and last letters;
* lexicon: for each language, whether the word is on the list of words that the training rows
  show at least ``LEXICON_LEAST`` times and mostly in that language.

Together with learned transitions they are trained by gradient ascent on the conditional likelihood. Training
chains are made of pieces of training texts of several languages one after another, so that
the transitions learn to stay and to switch. Forward-backward gives each word's
probabilities; a text's language is the one with the largest sum over its words that have a letter,
and its score that sum over their number.

The fit takes a bounded sample of the labelled rows: about ``SAMPLE_DOCS`` texts of each language, chosen by
a hash of their id against the language's row count, and of their pieces of ``PIECE_WORDS`` words about
``SAMPLE_PIECES``, chosen likewise. Labels beyond the ``MAX_LANGUAGES`` most frequent are not learned.
Prediction reads the text alone, whole, in blocks: the chain is a product of small matrices, so blocks
are multiplied in parallel, joined front to back and back to front, and finished in parallel.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was
learned. Ties go to the first language in alphabetical order. Repeated rows are predicted row by row; an empty
table gives no rows. Rows with a null id or language are not learned from.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.llm.common import fresh, ship

N_BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
LEXICON_LEAST = 3
MAX_LANGUAGES = 64
SAMPLE_DOCS = 1000
SAMPLE_PIECES = 1000
PIECE_WORDS = 40
PIECES_PER_CHAIN = 4
EPOCHS = 4
RATE = 0.2
DECAY = 1e-6
CHAINS_PER_STEP = 32
# Words of a batch that go through the field together, and words of a block.
STEP_WORDS = 100_000
BLOCK = 64
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_KINDS = "lang_pred string, score double"
_SPANS = "array<struct<first:int,upto:int,lang:string>>"


def words_of(text: str) -> list[str]:
    return text.replace("\0", " ").lower().split()


def ngram_buckets(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket at every byte of the joined words (0: none); and where each word begins."""
    joined = np.frombuffer(("\2" + "\3\0\2".join(words) + "\3").encode(), dtype=np.uint8)
    n = len(joined)
    wide = joined.astype(np.uint32)
    breaks = joined == 0
    out, code, crossed = [], wide.copy(), breaks.copy()
    for k in range(1, max(ORDERS)):
        code[: n - k] = code[: n - k] | (wide[k:] << np.uint32(8 * k))
        crossed[: n - k] |= breaks[k:]
        crossed[n - k :] = True
        if k + 1 in ORDERS:
            mixed = (code ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0xC2B2AE35)
            bucket = (mixed >> np.uint32(16)).astype(np.int32)
            # Bucket 0 is kept for positions without an n-gram.
            out.append(np.where(crossed, 0, np.maximum(bucket, 1)))
    starts = np.concatenate([[0], np.flatnonzero(breaks) + 1])
    return out, starts


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


@dataclass
class Field:
    """Languages in alphabetical order, and weights of the features, transitions and first words."""

    languages: list[str]
    grams: np.ndarray
    lexicon: dict[str, int]
    lexical: np.ndarray
    transitions: np.ndarray
    first: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words by language."""
        buckets, starts = ngram_buckets(words)
        total = self.grams[buckets[0]]
        for more in buckets[1:]:
            total += self.grams[more]
        listed = np.fromiter((self.lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        return _summed(total, starts) + self.lexical[listed]


@dataclass
class Chains:
    """Forward and backward values of chains that stand one after another in blocks."""

    ahead: np.ndarray
    back: np.ndarray
    emitted: np.ndarray
    factors: np.ndarray
    begins: np.ndarray
    n: int

    def marginals(self) -> np.ndarray:
        """Probability of each label at each place."""
        p = self.ahead * self.back
        p /= p.sum(axis=2, keepdims=True)
        return p.transpose(1, 0, 2).reshape(-1, p.shape[2])[: self.n]

    def pairs(self) -> np.ndarray:
        """Expected number of each pair of neighbouring labels inside chains."""
        flat = lambda x: x.transpose(1, 0, 2).reshape(-1, x.shape[2])[: self.n]
        before, after = flat(self.ahead)[:-1], (flat(self.emitted) * flat(self.back))[1:]
        inside = ~self.begins.T.reshape(-1)[1 : self.n]
        before, after = before[inside], after[inside]
        total = np.einsum("ti,ij,tj->t", before, self.factors, after)
        return np.einsum("ti,tj->ij", before / total[:, None], after) * self.factors


def forward_backward(scores: np.ndarray, begins: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> Chains:
    """``scores`` by place and label; ``begins`` marks the first place of each chain.

    Block after block of the whole row of places: products of the blocks' matrices in parallel, then the values
    at their borders one after another, then the places inside in parallel. A chain's beginning is a matrix
    that forgets what was before. Everything is scaled to a largest value of 1 on the way.
    """
    n, k = scores.shape
    blocks = -(-n // BLOCK)
    emitted = np.ones((blocks * BLOCK, k))
    emitted[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    emitted = np.ascontiguousarray(emitted.reshape(blocks, BLOCK, k).transpose(1, 0, 2))
    marks = np.zeros(blocks * BLOCK, dtype=bool)
    marks[:n] = begins
    # Places after the last are a chain of their own.
    marks[n : n + 1] = True
    marks = np.ascontiguousarray(marks.reshape(blocks, BLOCK).T)
    some = marks.any(axis=1)
    factors = np.exp(transitions - transitions.max())
    opening = np.exp(first - first.max())
    through = np.tile(np.eye(k), (blocks, 1, 1))
    for t in range(BLOCK):
        moved = (through.reshape(-1, k) @ factors).reshape(blocks, k, k)
        if some[t]:
            at = marks[t]
            moved[at] = through[at].sum(axis=2, keepdims=True) * opening
        moved *= emitted[t][:, None, :]
        through = moved / moved.max(axis=(1, 2), keepdims=True)
    enter = np.ones((blocks, k))
    leave = np.ones((blocks, k))
    for b in range(1, blocks):
        value = enter[b - 1] @ through[b - 1]
        enter[b] = value / value.max()
    for b in range(blocks - 1, 0, -1):
        value = through[b] @ leave[b]
        leave[b - 1] = value / value.max()
    ahead, back = np.empty_like(emitted), np.empty_like(emitted)
    value = enter
    for t in range(BLOCK):
        moved = value @ factors
        if some[t]:
            moved[marks[t]] = opening
        value = moved * emitted[t]
        value /= value.max(axis=1, keepdims=True)
        ahead[t] = value
    value = leave
    for t in range(BLOCK - 1, -1, -1):
        back[t] = value
        passed = emitted[t] * value
        moved = passed @ factors.T
        if some[t]:
            at = marks[t]
            moved[at] = (passed[at] @ opening)[:, None]
        value = moved / moved.max(axis=1, keepdims=True)
    return Chains(ahead, back, emitted, factors, marks, n)


def train(chains: list[tuple[list[str], np.ndarray]], languages: list[str]) -> Field:
    """Fit on chains of words and their labels (numbers of languages) by Adagrad steps on whole chains."""
    k = len(languages)
    seen: dict[str, Counter] = defaultdict(Counter)
    for words, labels in chains:
        for word, label in zip(words, labels.tolist(), strict=True):
            seen[word][label] += 1
    lexicon = {}
    for word, counts in seen.items():
        label, most = counts.most_common(1)[0]
        if most >= LEXICON_LEAST and 2 * most > counts.total() and _LETTER.search(word):
            lexicon[word] = label
    # The last row of ``lexical`` is for words on no list and stays 0.
    field = Field(
        languages, np.zeros((N_BUCKETS, k), np.float32), lexicon, np.zeros((k + 1, k)), np.zeros((k, k)), np.zeros(k)
    )
    squares = [np.full(w.shape, 1e-2) for w in (field.grams, field.lexical, field.transitions, field.first)]
    order = np.random.default_rng(11)
    for _ in range(EPOCHS if k > 1 else 0):
        turn = order.permutation(len(chains))
        for at in range(0, len(turn), CHAINS_PER_STEP):
            _step(field, squares, [chains[i] for i in turn[at : at + CHAINS_PER_STEP]])
    return field


def _step(field: Field, squares: list[np.ndarray], chains: list[tuple[list[str], np.ndarray]]) -> None:
    k = len(field.languages)
    numbers: dict[str, int] = {}
    places = np.array([numbers.setdefault(w, len(numbers)) for words, _ in chains for w in words])
    labels = np.concatenate([own for _, own in chains])
    begins = np.zeros(len(places), dtype=bool)
    begins[np.cumsum([0] + [len(own) for _, own in chains[:-1]])] = True
    words = list(numbers)
    made = forward_backward(field.emissions(words)[places], begins, field.transitions, field.first)
    truth = np.eye(k)[labels]
    missed = truth - made.marginals()
    # Per distinct word, then per feature.
    by_word = np.stack([np.bincount(places, weights=missed[:, j], minlength=len(words)) for j in range(k)], axis=1)
    buckets, starts = ngram_buckets(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(buckets[0]))))
    at = np.concatenate(buckets)
    used, local = np.unique(at, return_inverse=True)
    spread = by_word[np.tile(owner, len(buckets))]
    grams = np.stack([np.bincount(local, weights=spread[:, j], minlength=len(used)) for j in range(k)], axis=1)
    listed = np.fromiter((field.lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
    lexical = np.zeros_like(field.lexical)
    np.add.at(lexical, listed, by_word)
    inside = ~begins[1:]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (labels[:-1][inside], labels[1:][inside]), 1)
    first = missed[begins].sum(axis=0)
    # Bucket 0 and the last lexical row stand for no feature.
    grams[used == 0] = 0
    lexical[-1] = 0
    size = len(places)
    grams = grams / size - DECAY * field.grams[used]
    squares[0][used] += grams**2
    field.grams[used] += RATE * grams / np.sqrt(squares[0][used])
    rest = ((field.lexical, lexical), (field.transitions, pairs - made.pairs()), (field.first, first))
    for (weight, gradient), square in zip(rest, squares[1:], strict=True):
        step = gradient / size - DECAY * weight
        square += step**2
        weight += RATE * step / np.sqrt(square)


def label_texts(field: Field, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the probabilities of the languages at each of its words, and whether a word has a letter."""
    split = [words_of(t) for t in texts]
    numbers: dict[str, int] = {}
    places = np.array([numbers.setdefault(w, len(numbers)) for words in split for w in words], dtype=np.int64)
    sizes = [len(words) for words in split]
    if not len(places):
        return [(np.zeros((0, len(field.languages))), np.zeros(0, dtype=bool))] * len(texts)
    ends = np.cumsum(sizes)
    begins = np.zeros(len(places) + 1, dtype=bool)
    begins[ends - sizes] = True
    scores = field.emissions(list(numbers))[places]
    lettered = np.fromiter((_LETTER.search(w) is not None for w in numbers), dtype=bool, count=len(numbers))[places]
    p = forward_backward(scores, begins[:-1], field.transitions, field.first).marginals()
    return [(p[end - size : end], lettered[end - size : end]) for end, size in zip(ends, sizes, strict=True)]


def training_row(doc_id: Column) -> Column:
    """Whether the rows of an id may be learned from; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(
    docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_pieces: int = SAMPLE_PIECES, max_languages: int = MAX_LANGUAGES
) -> Field:
    """Fit on the rows of ``docs(doc_id, text, lang)`` that may be learned from."""
    usable = docs.where(training_row(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return train([], [])
    # Expected sizes: a language of N rows keeps each with sample_docs / N.
    share = lambda key, part: F.pmod(key, F.lit(1 << 30)) < (part * (1 << 30)).cast("bigint")
    part_of = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_docs / r["count"])))])
    chosen = usable.where(share(F.xxhash64("doc_id"), F.coalesce(part_of[F.col("lang")], F.lit(0.0))))
    words = F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")
    pieces = chosen.select("doc_id", "lang", words.alias("w")).select(
        "doc_id", "lang", "w", F.explode(F.sequence(F.lit(0), F.floor(F.size("w") / PIECE_WORDS).cast("int"))).alias("at")
    )
    pieces = pieces.select(
        "doc_id", "lang", "at", F.array_join(F.slice("w", F.col("at") * PIECE_WORDS + 1, F.lit(PIECE_WORDS)), " ").alias("piece")
    ).where(F.regexp_like("piece", F.lit(r"\p{L}")))
    per = {r["lang"]: r["count"] for r in pieces.groupBy("lang").count().collect()}
    if not per:
        return train([], [])
    part_of = F.create_map(*[x for lang, n in per.items() for x in (F.lit(lang), F.lit(min(1.0, sample_pieces / n)))])
    kept = (
        pieces.where(share(F.xxhash64("doc_id", "at"), part_of[F.col("lang")]))
        .orderBy(F.xxhash64("at", "doc_id"), "doc_id", "at", "piece")
        .limit(4 * sample_pieces * len(per))
        .select("lang", "piece")
        .collect()
    )
    languages = sorted({r["lang"] for r in kept})
    number = {lang: k for k, lang in enumerate(languages)}
    turn = np.random.default_rng(5).permutation(len(kept))
    chains = []
    for at in range(0, len(turn), PIECES_PER_CHAIN):
        words, labels = [], []
        for i in turn[at : at + PIECES_PER_CHAIN]:
            own = words_of(kept[i]["piece"])
            words += own
            labels += [number[kept[i]["lang"]]] * len(own)
        if words:
            chains.append((words, np.array(labels)))
    return train(chains, languages)


def _judged(field: Field, p: np.ndarray, lettered: np.ndarray, with_spans: bool) -> tuple[str, float, list | None]:
    if not lettered.any():
        return UNKNOWN, 0.0, [] if with_spans else None
    sums = p[lettered].sum(axis=0)
    best = int(sums.argmax())
    spans = None
    if with_spans:
        own = p.argmax(axis=1)
        borders = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
        spans = [
            {"first": int(a), "upto": int(b), "lang": field.languages[own[a]]}
            for a, b in zip(borders[:-1], borders[1:], strict=True)
        ]
    return field.languages[best], min(1.0, float(sums[best] / lettered.sum())), spans


def tag(docs: DataFrame, field: Field, spans: bool = True) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and, if asked for, ``spans``: runs of words of one language.

    A span holds the words from ``first`` up to, not including, ``upto``, counted from 0. Columns of
    these names that ``docs`` has already keep theirs, and the new ones end with an underscore.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # bounded by N_BUCKETS, MAX_LANGUAGES and the sample
    names = [fresh(docs, n) for n in ("lang_pred", "score", "spans")][: 3 if spans else 2]
    kinds = ["string", "double", _SPANS]
    at = docs.columns.index("text")
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("upto", pa.int32()), ("lang", pa.string())]))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            made: list[tuple] = []
            held: list[str] = []
            size = 0
            for text in batch.column(at).to_pylist():
                held.append(text or "")
                size += len(held[-1])
                # Six characters a word or so.
                if size >= 6 * STEP_WORDS:
                    made += _run(own, held, spans)
                    held, size = [], 0
            made += _run(own, held, spans)
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.float64(), span_type))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns[: len(names)]], names=[*batch.schema.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    more = ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=False))
    return docs.mapInArrow(judged, f"{own}, {more}")


def _run(field: Field, texts: list[str], spans: bool) -> list[tuple]:
    if not field.languages:
        return [(UNKNOWN, 0.0, [] if spans else None)] * len(texts)
    return [_judged(field, p, lettered, spans) for p, lettered in label_texts(field, texts)]
