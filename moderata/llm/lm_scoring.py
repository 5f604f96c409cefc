"""Language-model scoring by masked pseudo-likelihood.

A token is a word hashed to one of ``N_IDS`` numbers. Numbers are grouped in classes
by frequency: the most frequent are a class of their own, the others share classes
of equal mass. A small network sees ``REACH`` tokens on each side, each by the vector of its
class and, in a shared class, one of its own. It predicts the class in between and then, inside
a shared class, the token by a binary tree: at each split it goes to one half with a probability
that depends on what it sees. Their product is the token's conditional probability. The
sum of its logarithm over all tokens scores a document.

Counts cover all documents. Training runs over all documents too, in rounds: each
task trains from the common weights on its own rows of the round, and the weights
are averaged by tokens, those of one token or split by how often a task met it. Both are gathered as
rows that Spark adds up, so they grow with the number of tasks; what reaches the driver is the size of the model.

Defined results: a null, empty or blank text has no tokens, sum 0 and a null mean; an
unseen token counts as seen once; repeated rows are scored one by one; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderata.llm.common import forget, ship

N_IDS = 1 << 16
N_CLASSES = 128
N_SINGLE = 96
REACH = 2
HIDDEN = 16
ROUNDS = 2
RATE = 0.05
BATCH = 8192
# Log-odds whose exponential is finite.
FAR = np.float32(80)
# Rows of the tables of tokens and splits that a task hands over at a time.
TABLE_ROWS = 4096


def token_ids(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    # A checksum takes no longer than a look-up, and a table of words starts anew over and over once they outgrow it.
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % N_IDS


@dataclass
class Model:
    """``classes`` and ``log_share`` by token number; ``inputs`` by side and class, ``outputs`` by class.

    ``tokens`` are the input vectors by token number, zero for a token with a class of its own. A split has a vector in ``splits``
    and a bias. The splits that lead to token ``i`` are ``path[ends[i] : ends[i + 1]]``, and ``side`` is 1 or -1 for
    the half that it lies in.
    """

    classes: np.ndarray
    log_share: np.ndarray
    inputs: np.ndarray
    hidden_bias: np.ndarray
    outputs: np.ndarray
    output_bias: np.ndarray
    tokens: np.ndarray
    splits: np.ndarray
    split_bias: np.ndarray
    ends: np.ndarray
    path: np.ndarray
    side: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden_bias, self.outputs, self.output_bias]

    def with_weights(self, flat: np.ndarray) -> Model:
        made, at = [], 0
        for own in self.weights():
            made.append(flat[at : at + own.size].reshape(own.shape).astype(np.float32))
            at += own.size
        return replace(self, inputs=made[0], hidden_bias=made[1], outputs=made[2], output_bias=made[3])

    def hidden(self, around: list[np.ndarray], near: list[np.ndarray] | None = None) -> np.ndarray:
        """Hidden values, given the classes around and, where any is shared, the tokens ``near``."""
        summed = self.hidden_bias + sum(table.take(c, axis=0) for table, c in zip(self.inputs, around, strict=True))
        for ids in near or ():
            summed += self.tokens.take(ids, axis=0)
        return np.tanh(summed, out=summed)

    def forward(self, around: list[np.ndarray], near: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and log-probabilities of the classes."""
        hidden = self.hidden(around, near)
        logits = hidden @ self.outputs + self.output_bias
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return hidden, logits

    def turns(self, hidden: np.ndarray, target: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Split, its vectors, side and log-odds of that side, from the first split on the way to the tokens to the last.

        Each yields those of the first tokens of ``target``, which must stand in the order of :meth:`longest_first`.
        """
        at = self.ends.take(target)
        size = self.ends.take(target + 1) - at
        for turn in range(size[0] if len(size) else 0):
            n = np.searchsorted(-size, -turn)
            way = at[:n] + turn
            split, side = self.path.take(way), self.side.take(way)
            # Taking is several times as fast as indexing by rows.
            vectors = self.splits.take(split, axis=0)
            odds = np.einsum("ij,ij->i", hidden[:n], vectors) + self.split_bias.take(split)
            yield split, vectors, side, odds * side

    def longest_first(self, target: np.ndarray) -> np.ndarray:
        """The order of tokens by the number of their splits, most first."""
        return np.argsort((255 - (self.ends.take(target + 1) - self.ends.take(target))).astype(np.uint8), kind="stable")

    def _scored(self, around: list[np.ndarray], near: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        hidden = self.hidden(around, near)
        logits = hidden @ self.outputs + self.output_bias
        logits -= logits.max(axis=1, keepdims=True)
        out = logits[np.arange(len(target)), self.classes[target]]
        out -= np.log(np.exp(logits, out=logits) @ np.ones(N_CLASSES, np.float32))
        order = self.longest_first(target)
        lost = np.zeros(len(target), dtype=np.float32)
        for _, _, _, odds in self.turns(hidden.take(order, axis=0), target.take(order)):
            lost[: len(odds)] += np.log1p(np.exp(np.minimum(-odds, FAR)))
        out[order] -= lost
        return out

    def log_probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Log-probability of each token of one document given its neighbours."""
        return self.scores([ids])

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log-probabilities of the tokens of documents one after another."""
        if not any(len(ids) for ids in docs):
            return np.zeros(0)
        near, target = token_windows(docs)
        known = np.append(self.classes, N_CLASSES)
        out = np.empty(len(target))
        for at in range(0, len(target), BATCH // 4):
            part = [a[at : at + BATCH // 4] for a in near]
            out[at : at + BATCH // 4] = self._scored([known[a] for a in part], part, target[at : at + BATCH // 4])
        return out

    def sums(self, docs: list[np.ndarray]) -> list[float]:
        """The sum of each document."""
        upto = np.cumsum([0, *map(len, docs)])
        return [float(p.sum()) for p in np.split(self.scores(docs), upto[1:-1])] if docs else []


def token_windows(docs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Tokens around each token, outermost left first, and the token itself; ``N_IDS`` stands beyond the ends."""
    edge = np.full(REACH, N_IDS, dtype=np.int64)
    line = np.concatenate([x for d in docs for x in (edge, d)] + [edge])
    places = np.flatnonzero(line != N_IDS)
    return [line[places + k] for k in range(-REACH, REACH + 1) if k], line[places]


def windows(docs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Classes around each token, outermost left first, and the token's own; a mark stands beyond the ends."""
    edge = np.full(REACH, N_CLASSES, dtype=np.int64)
    line = np.concatenate([x for d in docs for x in (edge, d)] + [edge])
    places = np.flatnonzero(line != N_CLASSES)
    steps = [k for k in range(-REACH, REACH + 1) if k]
    return [line[places + k] for k in steps], line[places]


def new_model(counts: np.ndarray) -> Model:
    """Classes, shares and splits from token counts, and a network that predicts the frequencies of classes and tokens."""
    seen = np.maximum(counts, 1).astype(np.float64)
    order = np.lexsort((np.arange(N_IDS), -seen))
    classes = np.empty(N_IDS, dtype=np.int64)
    classes[order[:N_SINGLE]] = np.arange(N_SINGLE)
    rest = order[N_SINGLE:]
    mass = np.cumsum(seen[rest]) / seen[rest].sum()
    n_shared = N_CLASSES - N_SINGLE
    classes[rest] = N_SINGLE + np.minimum((mass * n_shared).astype(np.int64), n_shared - 1)
    total = np.bincount(classes, weights=seen, minlength=N_CLASSES)
    ends, path, side, bias = _splits(order, classes, seen)
    random = np.random.default_rng(7)
    return Model(
        classes=classes,
        log_share=np.log(seen / total[classes]),
        inputs=(random.standard_normal((2 * REACH, N_CLASSES + 1, HIDDEN)) * 0.1).astype(np.float32),
        hidden_bias=np.zeros(HIDDEN, dtype=np.float32),
        outputs=(random.standard_normal((HIDDEN, N_CLASSES)) * 0.1).astype(np.float32),
        output_bias=np.log(np.maximum(total, 1) / total.sum()).astype(np.float32),
        tokens=np.zeros((N_IDS + 1, HIDDEN), dtype=np.float32),
        splits=np.zeros((N_IDS, HIDDEN), dtype=np.float32),
        split_bias=bias,
        ends=ends,
        path=path,
        side=side,
    )


def _splits(order: np.ndarray, classes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The way to each token inside its class: where it ends by token, splits, sides, and the bias of every split.

    The tokens of a class stand in ``order`` next to each other. A run of them is split in the middle, and the split is named
    by the place at which its right half begins. With its bias alone a split gives both halves their corpus shares.
    """
    place = np.empty(N_IDS, dtype=np.int64)
    place[order] = np.arange(N_IDS)
    sums = np.concatenate([[0], np.cumsum(seen[order])])
    first = np.searchsorted(classes[order], np.arange(N_CLASSES + 1))
    low, high = first[classes], first[classes + 1]
    bias = np.zeros(N_IDS, dtype=np.float32)
    who, split, side = [], [], []
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        a, b = low[open_], high[open_]
        middle = (a + b) // 2
        right = place[open_] >= middle
        bias[middle] = np.log((sums[b] - sums[middle]) / (sums[middle] - sums[a]))
        who.append(open_)
        split.append(middle)
        side.append(np.where(right, 1, -1))
        low[open_], high[open_] = np.where(right, middle, a), np.where(right, b, middle)
        open_ = open_[high[open_] - low[open_] > 1]
    whose = np.concatenate([np.zeros(0, np.int64), *who])
    by_token = np.argsort(whose, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=N_IDS))])
    path = np.concatenate([np.zeros(0, np.int64), *split])[by_token].astype(np.int32)
    return ends, path, np.concatenate([np.zeros(0), *side])[by_token].astype(np.float32), bias


def _added(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ``ids``, how often each occurs and the sums of its columns of ``values``."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    line = ids.take(order)
    new = np.diff(line, prepend=-1) != 0
    code = np.empty(len(ids), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    rows = line[new]
    # Counting with weights, value by value, is faster than adding rows up.
    sums = np.stack([np.bincount(code, weights=v, minlength=len(rows)) for v in values])
    return rows, np.bincount(code, minlength=len(rows)), sums.astype(np.float32)


class Trainer:
    """Adagrad on batches of windows."""

    def __init__(self, model: Model) -> None:
        self.model = replace(
            model, inputs=model.inputs.copy(), hidden_bias=model.hidden_bias.copy(),
            outputs=model.outputs.copy(), output_bias=model.output_bias.copy(),
            tokens=model.tokens.copy(), splits=model.splits.copy(), split_bias=model.split_bias.copy(),
        )
        self.squares = [np.full(w.shape, 1e-4, dtype=np.float32) for w in self.model.weights()]
        # For the rows of the tables of tokens and splits, a mean square over each row and how often it was met.
        self.row_squares = [np.full(N_IDS, 1e-4, dtype=np.float32) for _ in range(2)]
        self.met = [np.zeros(N_IDS, dtype=np.float32) for _ in range(2)]
        self.known = np.append(model.classes, N_CLASSES)
        self.n = 0

    def train(self, docs: list[np.ndarray]) -> None:
        near, target = token_windows([ids for ids in docs if len(ids)])
        for at in range(0, len(target), BATCH):
            self._step([a[at : at + BATCH] for a in near], target[at : at + BATCH])

    def _step(self, near: list[np.ndarray], target: np.ndarray) -> None:
        model, n = self.model, len(target)
        around = [self.known[a] for a in near]
        hidden = model.hidden(around, near)
        error = hidden @ model.outputs + model.output_bias
        error -= error.max(axis=1, keepdims=True)
        np.exp(error, out=error)
        error *= (1 / (n * (error @ np.ones(N_CLASSES, np.float32))))[:, None]
        error[np.arange(n), model.classes[target]] -= np.float32(1 / n)
        order = model.longest_first(target)
        back = (error @ model.outputs.T).take(order, axis=0)
        sorted_, of_turn = hidden.take(order, axis=0), []
        across = np.ascontiguousarray(sorted_.T)
        for split, vectors, side, odds in model.turns(sorted_, target.take(order)):
            # What the chosen half lacks to probability 1.
            lack = -side / (1 + np.exp(np.minimum(odds, FAR)))
            of_turn.append((split, lack, across[:, : len(split)] * lack))
            vectors *= (lack / np.float32(n))[:, None]
            back[: len(split)] += vectors
        back *= 1 - sorted_**2
        back = np.ascontiguousarray(back.T)
        sorted_around = [c.take(order) for c in around]
        inputs = np.stack([[np.bincount(c, weights=b, minlength=N_CLASSES + 1) for b in back] for c in sorted_around])
        gradients = [inputs.transpose(0, 2, 1), back.sum(axis=1), hidden.T @ error, error.sum(axis=0)]
        for weight, square, gradient in zip(model.weights(), self.squares, gradients, strict=True):
            square += (gradient**2).astype(np.float32)
            weight -= (RATE * gradient / np.sqrt(square)).astype(np.float32)
        # Sums and not means, as most tokens and splits are rare.
        if of_turn:
            split, lack, values = zip(*of_turn, strict=True)
            rows, met, gradient = _added(np.concatenate(split), np.concatenate([np.concatenate(values, axis=1), np.concatenate(lack)[None]]))
            moved = self._rate(1, rows, met, gradient) * gradient
            model.splits[rows] -= moved[:HIDDEN].T
            model.split_bias[rows] -= moved[HIDDEN]
        seen, which = np.concatenate([a.take(order) for a in near]), np.concatenate(sorted_around)
        shared = np.flatnonzero((which >= N_SINGLE) & (which < N_CLASSES))
        if len(shared):
            rows, met, gradient = _added(seen.take(shared), back.take(shared % n, axis=1))
            gradient *= np.float32(n)
            model.tokens[rows] -= (self._rate(0, rows, met, gradient) * gradient).T
        self.n += n

    def _rate(self, table: int, rows: np.ndarray, met: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        square = self.row_squares[table].take(rows) + (gradient * gradient).mean(axis=0)
        self.row_squares[table][rows] = square
        self.met[table][rows] += met
        return np.float32(RATE) / np.sqrt(square)

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, how often met, and weights: the network first, and the tables in runs of rows."""
        yield 0, np.array([self.n], np.float32), np.concatenate([w.ravel() for w in self.model.weights()])[None]
        tables = [self.model.tokens[:N_IDS], np.column_stack([self.model.splits, self.model.split_bias])]
        for k, (met, table) in enumerate(zip(self.met, tables, strict=True)):
            for at in range(0, N_IDS, TABLE_ROWS):
                yield 1 + (k * N_IDS + at) // TABLE_ROWS, met[at : at + TABLE_ROWS], table[at : at + TABLE_ROWS]


PIECE = "piece int, met binary, weights binary"


def _piece_batch(pieces: list[tuple[int, np.ndarray, np.ndarray]], kind: type) -> pa.RecordBatch:
    columns = [pa.array([p for p, _, _ in pieces], pa.int32())]
    columns += [pa.array([x[k].astype(kind).tobytes() for x in pieces], pa.binary()) for k in (1, 2)]
    return pa.RecordBatch.from_arrays(columns, names=["piece", "met", "weights"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Averages of the pieces of all tasks, weighted by how often each row was met."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for piece, met, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = np.frombuffer(met, np.float32).astype(float)
            w = np.frombuffer(weights, np.float32).reshape(len(n), -1) * n[:, None]
            held = sums.setdefault(piece, [np.zeros(len(n)), np.zeros(w.shape)])
            held[0] += n
            held[1] += w
    made = [(piece, n, w / np.maximum(n, 1)[:, None]) for piece, (n, w) in sums.items()]
    if made:
        yield _piece_batch(made, np.float32)


def _counted(docs: DataFrame) -> np.ndarray:
    """Occurrences of every token number in the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(N_IDS, dtype=np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                held.append(token_ids(text))
                size += len(held[-1])
                # One count over the numbers for many texts.
                if size >= 16 * BATCH:
                    total += np.bincount(np.concatenate(held), minlength=N_IDS)
                    held, size = [], 0
            if size:
                total += np.bincount(np.concatenate(held), minlength=N_IDS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    parts = docs.select("text").mapInArrow(count, "id bigint, n bigint")
    counts = np.zeros(N_IDS, dtype=np.int64)
    for row in parts.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def _trained(docs: DataFrame, model: Model) -> Model:
    """The average of the models that the tasks make of ``model`` on their rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        trainer = Trainer(shared.value)
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                held.append(token_ids(text))
                size += len(held[-1])
                if size >= 16 * BATCH:
                    trainer.train(held)
                    held, size = [], 0
            if size:
                trainer.train(held)
        if trainer.n:
            for piece in trainer.pieces():
                yield _piece_batch([piece], np.float32)

    made = docs.select("text").mapInArrow(train, PIECE)
    tokens, splits = model.tokens.copy(), np.column_stack([model.splits, model.split_bias])
    # The driver gets one row for each run of rows of the model.
    for row in made.repartition(16, "piece").mapInArrow(_summed, PIECE).collect():
        met, flat = np.frombuffer(row["met"], np.float32), np.frombuffer(row["weights"], np.float32)
        if not row["piece"]:
            model = model.with_weights(flat)
            continue
        table, at = divmod((row["piece"] - 1) * TABLE_ROWS, N_IDS)
        held = (tokens, splits)[table][at : at + TABLE_ROWS]
        held[met > 0] = flat.reshape(len(met), -1)[met > 0]
    return replace(model, tokens=tokens, splits=splits[:, :HIDDEN].copy(), split_bias=splits[:, HIDDEN].copy())


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Count and train on all ``docs(text)``; each round takes its own share of the texts."""
    ship(docs.sparkSession)
    model = new_model(_counted(docs))
    turn = F.pmod(F.xxhash64("text"), F.lit(rounds))
    for k in range(rounds):
        model = _trained(docs.where(turn == k), model)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob`` of every row of ``docs(doc_id, text)``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = shared.value
        for batch in batches:
            sums, sizes, held = [], [], []
            for text in batch.column(1).to_pylist():
                held.append(token_ids(text))
                sizes.append(len(held[-1]))
                if sum(sizes[len(sums) :]) >= 16 * BATCH:
                    sums += own.sums(held)
                    held = []
            sums += own.sums(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())],
                names=["doc_id", "n_tokens", "log_prob"],
            )

    made = docs.select("doc_id", "text").mapInArrow(
        scored, f"doc_id {id_type}, n_tokens bigint, log_prob double"
    )
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return made.withColumn("mean_log_prob", mean)
