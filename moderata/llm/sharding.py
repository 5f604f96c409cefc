"""Sharding by longest-processing-time scheduling of groups that stay together.

Rows with equal texts form a group. Groups, largest first, go to the shard with the
least bytes so far, through a heap. Only the histogram of group sizes reaches the
driver: a size up to ``1 << PRECISION`` bytes is a class of its own and a larger one
shares its class with sizes that agree in their first ``PRECISION`` bits, so there
are at most about ``30 << PRECISION`` classes however many groups there are. A class counts with
its mean size. Groups of a class are interchangeable; a group's rank in its class
tells its shard.

Defined results: a null text counts as an empty one; a null ``doc_id`` is a value like
any other; repeated rows are rows of one group; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderata.operators.joins import checked_broadcast, lookup_join
from moderata.operators.ranking import with_position
from moderata.session import settle

N_SHARDS = 16
# Bits of a size that count: a class is at most 1/2048 wide.
PRECISION = 12


def _level(loads: Sequence[float], size: float, count: int) -> list[int]:
    """How many of ``count`` equal items go to each shard, by repeated choice of the least load.

    All but the last round of items follow from filling up to a common level; the
    rest goes through the heap.
    """
    low, high = min(loads), max(loads) + size * count
    given = [0] * len(loads)
    if count > 4 * len(loads):
        for _ in range(64):
            level = (low + high) / 2
            trial = [max(0, int((level - load) // size)) for load in loads]
            if sum(trial) <= count:
                low, given = level, trial
            else:
                high = level
    heap = [(load + n * size, shard) for shard, (load, n) in enumerate(zip(loads, given, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(given)):
        load, shard = heap[0]
        given[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return given


def schedule(
    classes: Sequence[tuple[int, int, int]], n_shards: int = N_SHARDS
) -> Iterator[tuple[int, int, int, int]]:
    """``(class, first rank, end rank, shard)`` for classes ``(class, groups, bytes)``.

    Classes are taken by mean size, largest first; ranks of a class are dealt to
    the shards in contiguous ranges.
    """
    loads = [0.0] * n_shards
    for kind, count, total in sorted(classes, key=lambda c: (-c[2] / c[1], c[0])):
        mean, rank = total / count, 0
        for shard, n in enumerate(_level(loads, mean, count)):
            if n:
                yield kind, rank, rank + n, shard
                rank += n
                loads[shard] += n * mean


def shard(docs: DataFrame, n_shards: int = N_SHARDS, precision: int = PRECISION) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs(doc_id, text)``.

    ``size`` is the UTF-8 length of the text plus one; ``slot`` counts from 0 without
    gaps inside a shard. Texts are read once; everything after works on a narrow
    settled table. Building the frame runs jobs.
    """
    text = F.coalesce("text", F.lit(""))
    rows = settle(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(text, 256).alias("group"),
        )
    )
    sized = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    # The low bits beyond the first ``precision`` are cleared.
    spare = F.greatest(F.length(F.bin("bytes")) - precision, F.lit(0))
    cleared = F.call_function("shiftleft", F.call_function("shiftright", F.col("bytes"), spare), spare)
    groups = settle(sized.withColumn("class", cleared))
    classes = groups.groupBy("class").agg(F.count(F.lit(1)), F.sum("bytes")).collect()
    plan = docs.sparkSession.createDataFrame(
        list(schedule([tuple(c) for c in classes], n_shards)),
        "class bigint, rank_from bigint, rank_to bigint, shard int",
    )
    ranked = with_position(groups, ["group"], ["class"], name="rank")
    at = F.col("rank") - 1
    placed = (
        ranked.join(checked_broadcast(settle(plan)), "class")
        .where((at >= F.col("rank_from")) & (at < F.col("rank_to")))
        .select("group", "n_rows", "shard")
    )
    dealt = lookup_join(rows, placed, ["group"], row_id=["doc_id"], matches="n_rows").drop("group")
    slots = with_position(dealt, ["doc_id", "text_crc32"], ["shard"], name="slot")
    return slots.withColumn("slot", F.col("slot") - 1)
