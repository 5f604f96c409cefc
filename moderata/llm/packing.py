"""Best-fit packing: a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits one sequence. The program
asks for the fewest configurations that hold every piece; multiplicative weights
lower the price of a length the more of it is covered, and a knapsack dynamic
program prices configurations, in whole numbers, until the demand is covered. What no
configuration fills well, or all of it if that takes fewer sequences, is packed best fit first by
length and count, and ranks inside a length tell every piece its place.

Only the histogram (one row per length) reaches the driver, and the plan that comes
back has a bounded number of configurations whatever the number of documents.

Defined results: a null or empty text is one piece that holds the end mark alone; a
text longer than a sequence is cut into full pieces and a rest; repeated rows are
packed one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderata.llm.common import ship
from moderata.llm.tokens import tokens_of
from moderata.operators.joins import checked_broadcast
from moderata.operators.ranking import with_position
from moderata.session import settle

CAPACITY = 2048
END_ID = 0
# Knapsack solutions in a round at most.
RESOLVES = 12
# Unused places that a sequence may have before the last round.
SPARE = 8
ROUNDS = 12
# How fast a covered length loses its price.
RATE = 0.5
BATCH = 256

Config = tuple[tuple[int, int], ...]


def _fills(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over lengths 1 to ``capacity``: best value, and the length chosen, per room."""
    value = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    usable = np.flatnonzero(prices[1:] > 0) + 1
    gain = prices[usable]
    for room in range(1, capacity + 1):
        value[room], choice[room] = value[room - 1], 0
        n = np.searchsorted(usable, room, side="right")
        if n:
            total = value[room - usable[:n]] + gain[:n]
            best = int(total.argmax())
            if total[best] > value[room]:
                value[room], choice[room] = total[best], usable[best]
    return value, choice


def _covering(demand: np.ndarray, capacity: int, rounds: int, rate: float, resolves: int) -> Counter[Config]:
    """Whole numbers of configurations that hold exactly the demand.

    In each round every length may give one share of its demand. Seeds are taken from
    the least covered length on; the knapsack choices fill the room that a seed leaves. When a
    length of the choice is used up, the seeds it leaves open are priced again over the
    lengths that still have a share, up to ``resolves`` times a round. Sequences with more
    than ``SPARE`` unused wait for the next round; the last one goes on, with twice the
    spare room each time, until nothing is left.
    """
    used: Counter[Config] = Counter()
    lengths = np.arange(capacity + 1, dtype=float)
    safe = np.maximum(demand, 1)
    left = demand.copy()

    def priced(budget: np.ndarray, kept_back: np.ndarray, spare: int, used: Counter[Config]) -> bool:
        open_share = (np.minimum(left, kept_back) + budget) / safe
        seeds = np.flatnonzero(budget)[::-1]
        # Lengths that are behind come first, then the longest.
        seeds = seeds[np.argsort(-open_share[seeds], kind="stable")].tolist()
        prices = lengths * np.exp(-rate * (1 - open_share))
        _, choice = _fills(np.where(budget > 0, prices, 0.0), capacity)
        return _filled(budget, seeds, choice.tolist(), capacity, spare, used)

    for turn in range(1, rounds + 1):
        # Shares not used in earlier rounds stay available.
        kept_back = demand - demand * turn // rounds
        budget = np.maximum(left - kept_back, 0)
        for _ in range(resolves):
            if not budget.any() or not priced(budget, kept_back, SPARE, used):
                break
        left = np.minimum(left, kept_back) + budget
    none, spare = np.zeros_like(left), SPARE
    rest: Counter[Config] = Counter()
    simple: Counter[Config] | None = None
    while left.any() and spare < 2 * capacity:
        if simple is None and spare > 8 * SPARE:
            simple = _best_fit(_histogram(left), capacity)
        if not priced(left, none, spare, used if simple is None else rest):
            spare *= 2
    rest += _best_fit(_histogram(left), capacity)
    return used + (rest if simple is None or sum(rest.values()) <= sum(simple.values()) else simple)


def _histogram(counts: np.ndarray) -> Counter[int]:
    return Counter({int(k): int(counts[k]) for k in np.flatnonzero(counts)})


def _filled(
    budget: np.ndarray, seeds: list[int], choice: list[int], capacity: int, spare: int, used: Counter[Config]
) -> bool:
    """Take the configurations of ``choice`` from ``budget`` as far as they go; whether there were any."""
    have = budget.tolist()
    progress = False
    for seed in seeds:
        while have[seed]:
            config = {seed: 1}
            room, waste = capacity - seed, 0
            while room > 0:
                length = choice[room]
                if length and have[length] > config.get(length, 0):
                    config[length] = config.get(length, 0) + 1
                    room -= length
                elif length:
                    # Used up: another choice has to be made for this seed.
                    break
                else:
                    room -= 1
                    waste += 1
            if room > 0 or waste > spare:
                break
            times = min(have[length] // n for length, n in config.items())
            used[tuple(sorted(config.items()))] += times
            progress = True
            for length, n in config.items():
                have[length] -= times * n
    budget[:] = have
    return progress


def _best_fit(left: Counter[int], capacity: int) -> Counter[Config]:
    """Best-fit decreasing over a histogram: equal pieces go into equal sequences together."""
    rooms: list[int] = []
    bins: dict[int, Counter[Config]] = defaultdict(Counter)

    def add(content: Config, room: int, times: int) -> None:
        if room not in bins:
            insort(rooms, room)
        bins[room][content] += times

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            if at < len(rooms):
                content, open_ = bins[room].popitem()
                each = 1
                if room - length >= length and len(rooms) > at:
                    # The rest of the room is the best fit again while no other room is closer.
                    closest = rooms[at + 1] if at + 1 < len(rooms) else capacity + 1
                    each = room // length if room - length < closest else 1
            else:
                content, open_, each = (), n, capacity // length
            each = min(each, n)
            times = min(open_, n // each)
            if at < len(rooms):
                if open_ > times:
                    bins[room][content] = open_ - times
                elif not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            add(tuple(sorted([*content, (length, each)])), room - each * length, times)
            n -= each * times
    packed: Counter[Config] = Counter()
    for contents in bins.values():
        packed.update(contents)
    return packed


def solve(
    histogram: Mapping[int, int],
    capacity: int = CAPACITY,
    rounds: int = ROUNDS,
    rate: float = RATE,
    resolves: int = RESOLVES,
) -> Counter[Config]:
    """How often each configuration is used; together they hold exactly the histogram."""
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        demand[length] = n
    priced = _covering(demand, capacity, rounds, rate, resolves)
    # With much of the mass at one length the plain heuristic can do better.
    simple = _best_fit(_histogram(demand), capacity)
    return priced if sum(priced.values()) <= sum(simple.values()) else simple


def _plan_rows(used: Mapping[Config, int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``length, rank_from, rank_to, sequence_from, per_sequence, offset`` of every configuration's lengths."""
    taken: Counter[int] = Counter()
    sequence = 0
    for config, times in sorted(used.items()):
        offset = 0
        for length, n in config:
            yield length, taken[length], taken[length] + times * n, sequence, n, offset
            taken[length] += times * n
            offset += length * n
        sequence += times


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Token pieces of ``docs(doc_id, text)`` with their length and CRC-32, and ``ids`` if asked for."""
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = tokens_of(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                source, number, start, cuts = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = words.encode(text) + end
                    for piece, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        source.append(i)
                        number.append(piece)
                        start.append(begin // 4)
                        cuts.append(ids[begin : begin + 4 * capacity])
                columns = [
                    part.column(0).take(pa.array(source)),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(c) // 4 for c in cuts], pa.int64()),
                    pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(c, "<i4") for c in cuts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInArrow(encode, schema + (", ids array<int>" if keep_ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with ``sequence_id`` and ``offset``.

    Texts are tokenised once. Building the frame runs jobs.
    """
    cut = settle(pieces(docs, tokenizer, capacity, end_id))
    histogram = {row["length"]: row["n"] for row in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = docs.sparkSession.createDataFrame(
        list(_plan_rows(solve(histogram, capacity))),
        "length bigint, rank_from bigint, rank_to bigint, sequence_from bigint, per_sequence bigint, offset_from bigint",
    )
    ranked = with_position(cut, ["doc_id", "piece"], ["length"], name="_rank")
    at = F.col("_rank") - 1
    placed = ranked.join(checked_broadcast(settle(plan)), "length").where(
        (at >= F.col("rank_from")) & (at < F.col("rank_to"))
    )
    nth = at - F.col("rank_from")
    return placed.select(
        *cut.columns,
        (F.col("sequence_from") + F.floor(nth / F.col("per_sequence")).cast("bigint")).alias("sequence_id"),
        (F.col("offset_from") + nth % F.col("per_sequence") * F.col("length")).alias("offset"),
    )


def sequences(
    docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """``sequence_id, ids`` of packed documents; ``doc_id`` must be unique and not null.

    A group is one sequence, so it holds at most ``capacity`` ids.
    """
    cut = pieces(docs, tokenizer, capacity, end_id, keep_ids=True).select("doc_id", "piece", "ids")
    at = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.join(cut, ["doc_id", "piece"])
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(at, lambda p: p["ids"])).alias("ids"))
    )
