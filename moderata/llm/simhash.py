"""SimHash near-duplicates: BK-trees over fingerprints, then connected components.

Equal fingerprints are one node. Two fingerprints that differ in at most ``radius``
bits agree in one of ``radius + 1`` blocks of bits, so nodes are dealt by block value
and only nodes of one shard are compared. A shard with more than ``shard_size`` nodes
is dealt again by blocks of its remaining bits; after a few levels too few bits are
left for a large shard, so every shard is bounded without dropping a link. A shard's
fingerprints go into a BK-tree, whose children are keyed by their Hamming distance
to the parent, and a search follows only the edges within the radius. A shard
reports a spanning forest of its links, not all pairs.

Defined results: null, empty and blank texts have fingerprint 0 and are linked like any
other; a null ``doc_id`` is never the smallest of a component unless all are null;
repeated rows share a component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderata.llm.common import fresh, ship
from moderata.operators.joins import checked_broadcast, lookup_join
from moderata.session import settle

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
# Nodes of one BK-tree.
SHARD_SIZE = 4096


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a whole text as an unsigned number."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(shingle, len(tokens))
    spans = zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column, as a signed 64-bit number."""

    @F.pandas_udf(T.LongType())
    def signed(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return signed(text)


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


class Tree:
    """BK-tree over 64-bit numbers under Hamming distance."""

    def __init__(self, root: int) -> None:
        self.values = [root]
        self.children: list[dict[int, int]] = [{}]

    def add(self, value: int) -> None:
        at = 0
        while True:
            distance = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of the values at most ``radius`` away."""
        todo = [0]
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            children = self.children[at]
            if children:
                for edge in range(distance - radius, distance + radius + 1):
                    below = children.get(edge)
                    if below is not None:
                        todo.append(below)


def forest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join every value to the others of its component, at most one per value.

    ``values`` are distinct. Each is looked up in the tree of those before it.
    """
    tree = Tree(values[0])
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(1, len(values)):
        for j in tree.within(values[i], radius):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                yield values[i], values[j]
        tree.add(values[i])


def _parts(bits: tuple[int, ...], n: int) -> list[tuple[int, ...]]:
    """Bit numbers in ``n`` blocks of nearly equal size."""
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(bits: Iterable[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """Spanning links of every shard of ``rows(shard, fp)``; a partition is read in order of its shards."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(shard: list[int]) -> list[tuple[int, int]]:
            return list(forest(shard, radius)) if len(shard) > 1 else []

        current, held = None, []
        for batch in batches:
            links: list[tuple[int, int]] = []
            for shard, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != current:
                    links += made(held)
                    current, held = shard, []
                held.append(value & 0xFFFFFFFFFFFFFFFF)
            yield _as_links(links)
        yield _as_links(made(held))

    ordered = rows.repartition("shard").sortWithinPartitions("shard", "fp")
    return ordered.mapInArrow(link, "a bigint, b bigint")


def _as_links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(nodes: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links ``a, b`` that span all pairs of distinct ``nodes(fp)`` within ``radius`` bits.

    Shards are found level by level, by the value of a block of bits. Shards above
    ``shard_size`` go to the next level with the bits that do not yet agree.
    """
    found: list[DataFrame] = []
    level = [(nodes.select("fp"), tuple(range(BITS)), 0)]
    while level:
        following = []
        for rows, bits, agreed in level:
            for block in _parts(bits, radius + 1):
                mask = _mask(block) | agreed
                left = tuple(b for b in bits if b not in block)
                keyed = rows.select(F.col("fp").bitwiseAND(F.lit(mask)).alias("shard"), "fp")
                sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
                large = settle(sizes.where(F.col("n") > shard_size).select("shard"))
                if left and large.head(1):
                    large = checked_broadcast(large)
                    following.append((settle(keyed.join(large, "shard").select("fp")), left, mask))
                    keyed = keyed.join(large, "shard", "left_anti")
                found.append(_linked(keyed, radius))
        level = following
    return settle(reduce(DataFrame.union, found))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``; ``root`` is the smallest node of its component.

    Large-star and small-star steps in turn until nothing changes; each step joins
    every edge to the smallest neighbour of one of its ends.
    """
    ends = edges.where("a != b")
    current = settle(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(current)
    while state[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        near = _with_smallest(settle(large))
        own = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        current = settle(near.select(own.alias("a"), F.col("m").alias("b")).distinct())
        before, state = state, _state(current)
        if state == before:
            break
    return settle(
        current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
            current.select("b", "b").distinct()
        )
    )


def _with_smallest(edges: DataFrame) -> DataFrame:
    """Edges with ``m``, the smallest of ``a`` and all its neighbours; a hub's edges are dealt over tasks."""
    smallest = edges.groupBy("a").agg(
        F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    return lookup_join(edges, smallest, ["a"], row_id=["b"], matches="n")


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free digest of the edges."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def group(rows: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``rows`` (settled, with ``doc_id`` and ``fp``) plus ``root`` and ``component_id`` of their component.

    ``root`` names the component by its smallest fingerprint, ``component_id`` by its smallest ``doc_id``.
    """
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    members = components(links(nodes, radius, shard_size))
    named = members.join(nodes, members["node"] == nodes["fp"]).select("node", "root", "first")
    smallest = named.groupBy("root").agg(
        F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")
    )
    of_node = lookup_join(named.drop("first"), smallest, ["root"], row_id=["node"], matches="n")
    whole = nodes.join(of_node, nodes["fp"] == of_node["node"], "left").select(
        "fp",
        "n",
        F.coalesce("root", "fp").alias("root"),
        F.coalesce("component_id", "first").alias("component_id"),
    )
    return lookup_join(rows, whole, ["fp"], row_id=["doc_id"], matches="n")


def near_duplicates(
    docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, shard_size: int = SHARD_SIZE
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    Texts are read once; everything after works on numbers. Building the frame runs jobs.
    """
    ship(docs.sparkSession)
    rows = settle(docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")))
    return group(rows, radius, shard_size).select(
        "doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id"
    )


def deduplicate(
    docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, shard_size: int = SHARD_SIZE
) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest ``doc_id``.

    The rows are settled with a number of their own, so repeated rows and null ids
    are told apart. All columns of ``docs`` are kept in their order.
    """
    ship(docs.sparkSession)
    row, fp = fresh(docs, "_row"), fresh(docs, "_fp")
    marked = settle(
        docs.withColumn(fp, fingerprints(F.col("text"), shingle)).withColumn(row, F.monotonically_increasing_id())
    )
    narrow = marked.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    grouped = group(narrow, radius, shard_size)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row"))
    kept = settle(grouped.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias(row)))
    return marked.join(checked_broadcast(kept), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
