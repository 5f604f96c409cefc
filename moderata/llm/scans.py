"""Running folds along groups of any size: range partitions, and one carried value for each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderata.session import settle

Batches = Iterator[pa.RecordBatch]


def running(
    df: DataFrame,
    group: str,
    order: str,
    values: Sequence[str],
    names: Sequence[str],
    factor: int = 1,
    modulus: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """``state = state * factor + value`` along each group, a column ``names[k]`` for each of ``values``.

    States are decimals of 38 digits; with a ``modulus`` they are reduced by it. Rows are range-partitioned by
    ``(group, order)``, so a huge group spreads over many tasks. A task folds its rows one after
    another in bounded memory and settles them; one row for each task, its last, goes to the driver, which
    joins the states of groups that go on in later tasks. A second pass over the settled rows needs no
    order: it adds ``carried * factor^(rows so far)`` where the group began earlier. ``order`` must be unique in
    a group.
    """
    direction = F.col(order).desc() if descending else F.col(order)
    ordered = df.repartitionByRange(group, direction).sortWithinPartitions(group, direction)
    schema = df.schema
    at_group, at_values = df.columns.index(group), [df.columns.index(v) for v in values]
    states = ", ".join(f"{n} decimal(38,0)" for n in names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    k = len(names)
    step = (lambda s, v: (s * factor + v) % modulus) if modulus else (lambda s, v: s * factor + v)

    def folded(batches: Batches) -> Batches:
        # ``place`` counts the rows of the open run; ``first`` marks the run that may have begun before.
        state, last, place, first, held = [0] * k, None, 0, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            made, places, firsts = [[] for _ in range(k)], [], []
            columns = [batch.column(a).to_pylist() for a in at_values]
            for own, row in zip(batch.column(at_group).to_pylist(), zip(*columns, strict=True), strict=True):
                if last is not None and own != last:
                    state, place, first = [0] * k, 0, False
                last, place = own, place + 1
                state = [step(s, int(v)) for s, v in zip(state, row, strict=True)]
                for out, s in zip(made, state, strict=True):
                    out.append(s)
                places.append(place)
                firsts.append(first)
            held = _out(batch, made, places, firsts, False)
        if held is not None:
            if held.num_rows > 1:
                yield held.slice(0, held.num_rows - 1)
            final = held.slice(held.num_rows - 1)
            yield final.set_column(final.num_columns - 1, "_last", pa.array([True]))

    def _out(batch: pa.RecordBatch, made: list, places: list, firsts: list, last: bool) -> pa.RecordBatch:
        more = [pa.array(m, pa.decimal128(38, 0)) for m in made]
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [*batch.columns, *more, pa.array(places, pa.int64()), pa.array(firsts), pa.array([last] * n)],
            names=[*batch.schema.names, *names, "_place", "_first", "_last"],
        )

    placed = settle(
        ordered.mapInArrow(folded, f"{kinds}, {states}, _place bigint, _first boolean, _last boolean").withColumn(
            "_block", F.spark_partition_id()
        )
    )
    # One row for each task.
    ends = sorted(
        placed.where("_last").select("_block", group, "_place", "_first", *names).collect(), key=lambda r: r["_block"]
    )
    carried, state, last = {}, None, None
    for r in ends:
        if state is not None:
            carried[r["_block"]] = (last, state)
        own = [int(r[n]) for n in names]
        if state is not None and r["_first"] and r[group] == last:
            power = pow(factor, r["_place"], modulus) if modulus else factor ** r["_place"]
            own = [(s * power + v) % modulus if modulus else s * power + v for s, v in zip(state, own, strict=True)]
        state, last = own, r[group]
    shared = df.sparkSession.sparkContext.broadcast(carried)  # one entry for each task

    def joined(batches: Batches) -> Batches:
        at = len(schema.fields)
        for batch in batches:
            place, first = batch.column(at + k).to_pylist(), batch.column(at + k + 1).to_pylist()
            block, own = batch.column(at + k + 3).to_pylist(), batch.column(at_group).to_pylist()
            made = batch.columns[at : at + k]
            if any(first):
                made = [m.to_pylist() for m in made]
                for i, opened in enumerate(first):
                    before = shared.value.get(block[i]) if opened else None
                    if before is not None and before[0] == own[i]:
                        power = pow(factor, place[i], modulus) if factor != 1 else 1
                        for j in range(k):
                            value = before[1][j] * power + int(made[j][i])
                            made[j][i] = value % modulus if modulus else value
                made = [pa.array([int(v) for v in m], pa.decimal128(38, 0)) for m in made]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], *made],
                names=[*batch.schema.names[:at], *names],
            )

    return placed.mapInArrow(joined, f"{kinds}, {states}")
