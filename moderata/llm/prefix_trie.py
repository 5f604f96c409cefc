"""Prefix tree of conversations by double-array tries.

Turns are named by two independent 64-bit hashes of role and text. A running polynomial hash modulo a
prime of 126 bits along each conversation names every prefix; it is a fold in range partitions, so one
conversation may be of any length. Conversations are cut into bands of ``BAND`` turns, equal segments below
the same prefix are counted, and the distinct segments are range-partitioned in the order of their turns.
So a partition is a contiguous piece of the tree: a shard of prefixes. Copies do not add to it, and only
the nodes on its two borders can also stand in other shards.

A shard numbers its turns densely, packs its segments into double arrays (``BASE`` and ``CHECK``; the child of
state ``s`` by turn ``t`` stands at ``BASE[s] + t`` if ``CHECK`` there names ``s``) and walks every
segment down, adding its members to the states it meets. The states are the nodes. Nodes of one name,
upper ones that several shards share, are merged over all shards; sums over subtrees are taken along the paths
of the smallest members, each node being counted once, by a fold from the last turn to the first.

Defined results: turns of equal number are ordered by the hash of their role and text, equal ones among them by
nothing, being equal; null role or text is empty, a null turn comes first. Rows without ``conv_id`` belong to no
conversation and are left out. A table without conversations gives no rows, not even the root.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.llm.common import ship
from moderata.llm.scans import running
from moderata.operators.joins import lookup_join
from moderata.operators.ranking import with_position
from moderata.session import settle

BAND = 32
# A double array takes this many turns of segments at most; then the shard begins another.
ARRAY_TURNS = 1 << 17
# Free cells that are tried for the children of a state before they go to the end of the arrays.
TRIES = 64
# Conversations of one family of ``FAMILY`` ids begin alike, with up to ``HEAD - 1`` turns of its first.
FAMILY = 5
HEAD = 9
# Fixed values of the prefix names: a prime below 10^38 and a factor below it.
PRIME = (1 << 126) - 137
FACTOR = 0x2545F4914F6CDD1D_9E3779B97F4A7C15 % PRIME
# Bytes of decimal ids that go into one row of the ordered id lists.
PIECE = 1 << 16

Batches = Iterator[pa.RecordBatch]


def turn_value(a: int, b: int) -> int:
    """One number of 126 bits for the two hashes of a turn."""
    return (((a & ((1 << 63) - 1)) << 63) | (b & ((1 << 63) - 1))) % PRIME


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, a, b, bytes``: positions from 1, hashes of role and text, UTF-8 length of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    return with_position(rows, ["turn", "a", "b"], ["conv_id"], "pos").drop("turn")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations after the families' common beginnings, from the settled :func:`turns`.

    Gives ``conv_id, depth, a, b, bytes`` and ``conv_id, n_turns`` with all conversations, turnless ones too.
    """
    n_head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    # At most HEAD - 1 turns of a conversation.
    heads = own.where(F.col("pos") < HEAD).groupBy(F.col("conv_id").alias("_first")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "bytes"))).alias("_head")
    )
    counts = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    convs = settle(
        counts.withColumn("_h", n_head)
        .withColumn("_first", first)
        .join(heads, "_first", "left")
        .withColumn("_head", F.slice(F.coalesce("_head", F.array()), F.lit(1), F.col("_h")))
        .withColumn("_m", F.size("_head"))
        .drop("_first")
    )
    common = convs.select("conv_id", F.posexplode("_head").alias("_at", "_turn")).select(
        "conv_id", (F.col("_at") + 1).cast("bigint").alias("depth"), "_turn.a", "_turn.b", "_turn.bytes"
    )
    tails = own.where(F.col("pos") > n_head)
    lookup = convs.select("conv_id", "_h", "_m", "_n")
    moved = lookup_join(tails, settle(lookup), ["conv_id"], row_id=["pos"], matches="_n", settled=True)
    rest = moved.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_m")).alias("depth"), "a", "b", "bytes")
    lengths = convs.select("conv_id", (F.col("_m") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).alias("n_turns"))
    return common.unionByName(rest), lengths


class DoubleArray:
    """A trie of sequences of dense numbers 1, 2, ... in two arrays."""

    def __init__(self, sequences: list[list[int]]) -> None:
        """``sequences`` in ascending order, so that equal beginnings stand together."""
        self.base, self.check, self.free = [0], [0], 1
        # Ranges of sequences that share their first ``depth`` numbers, with their state.
        open_ = [(0, 0, len(sequences), 0)]
        while open_:
            state, at, stop, depth = open_.pop()
            children = []
            while at < stop:
                if len(sequences[at]) == depth:
                    at += 1
                    continue
                number, begin = sequences[at][depth], at
                while at < stop and sequences[at][depth] == number:
                    at += 1
                children.append((number, begin, at))
            if children:
                base = self.base[state] = self._fit([c[0] for c in children])
                for number, begin, end in children:
                    self.check[base + number] = state
                    open_.append((base + number, begin, end, depth + 1))

    def _fit(self, numbers: list[int]) -> int:
        """A base where all children find free cells, among the first ``TRIES`` free ones or else at the end."""
        least, span = numbers[0], numbers[-1] - numbers[0]
        at = self.free = self._next(self.free)
        for _ in range(TRIES):
            self._grow(at + span + 1)
            if all(self.check[at + x - least] < 0 for x in numbers):
                return at - least
            at = self._next(at + 1)
        at = len(self.check)
        self._grow(at + span + 1)
        return at - least

    def _next(self, at: int) -> int:
        """The first free cell from ``at`` on."""
        while at < len(self.check) and self.check[at] >= 0:
            at += 1
        return at

    def _grow(self, least: int) -> None:
        more = least - len(self.check)
        if more > 0:
            self.base.extend([0] * more)
            self.check.extend([-1] * more)

    def child(self, state: int, number: int) -> int:
        """The state after ``number``, or -1."""
        at = self.base[state] + number
        return at if 0 < at < len(self.check) and self.check[at] == state else -1


def _shard_nodes(rows: list[dict]) -> dict[tuple[int, int], list]:
    """Nodes of one double array: ``(depth, name) -> [parent's name, members, smallest member, bytes]``.

    A row is a distinct segment: ``start`` (name of the prefix above it), ``depth`` of that, its ``turns`` and
    how many conversations have it.
    """
    numbers: dict[tuple, int] = {}
    for r in rows:
        for word in (("start", r["depth"], r["start"]), *((t["a"], t["b"]) for t in r["turns"])):
            numbers.setdefault(word, len(numbers) + 1)
    coded = [
        [numbers["start", r["depth"], r["start"]], *(numbers[t["a"], t["b"]] for t in r["turns"])] for r in rows
    ]
    trie = DoubleArray(sorted(coded))
    found: dict[int, tuple[tuple[int, int], list]] = {}
    for r, sequence in zip(rows, coded, strict=True):
        state, name = trie.child(0, sequence[0]), int(r["start"])
        for step, (turn, number) in enumerate(zip(r["turns"], sequence[1:], strict=True), 1):
            state, above = trie.child(state, number), name
            if state in found:
                (_, name), node = found[state]
                node[1] += r["n"]
                node[2] = min(node[2], r["conv_id"])
            else:
                name = (above * FACTOR + turn_value(turn["a"], turn["b"])) % PRIME
                found[state] = ((r["depth"] + step, name), [above, r["n"], r["conv_id"], turn["bytes"]])
    return dict(found.values())


def _walked(batches: Batches) -> Batches:
    """Segments of one shard to the nodes of its double arrays."""

    def out(rows: list[dict]) -> pa.RecordBatch:
        nodes = _shard_nodes(rows)
        name = lambda values: pa.array(values, pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in nodes], pa.int64()),
                name([k for _, k in nodes]),
                name([v[0] for v in nodes.values()]),
                *[pa.array([v[i] for v in nodes.values()], pa.int64()) for i in (1, 2, 3)],
            ],
            names=["depth", "name", "above", "n_convs", "conv_id", "bytes"],
        )

    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            for row in batch.slice(start, 1024).to_pylist():
                held.append(row)
                size += len(row["turns"])
                if size >= ARRAY_TURNS:
                    yield out(held)
                    held, size = [], 0
    if held:
        yield out(held)


def _pieces(batches: Batches) -> Batches:
    """Ids in order, a row each, to comma-joined runs of one node."""
    name, ids, size = None, [], 0
    made: list[tuple] = []
    for batch in batches:
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (own != name or size >= PIECE):
                made.append((name, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            name = own
            ids.append(conv)
            size += 8
        yield _piece_rows(made)
        made = []
    if ids:
        yield _piece_rows([(name, ids[0], ",".join(map(str, ids)))])


def _piece_rows(made: list[tuple]) -> pa.RecordBatch:
    names, firsts, texts = zip(*made, strict=True) if made else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.decimal128(38, 0)), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())],
        names=["name", "first", "ids"],
    )


def _digests(batches: Batches) -> Batches:
    """Ordered runs of ids to one SHA-256 for each node; a run at a time is in memory."""
    name, state = None, hashlib.sha256()
    for batch in batches:
        names, hexes = [], []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if name is not None and own != name:
                names.append(name)
                hexes.append(state.hexdigest())
                state = hashlib.sha256()
            elif name is not None:
                state.update(b",")
            name = own
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.decimal128(38, 0)), pa.array(hexes, pa.string())], ["name", "sha256"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.decimal128(38, 0)), pa.array([state.hexdigest()])], ["name", "sha256"])


def member_digests(ends: DataFrame) -> DataFrame:
    """``name, sha256`` of the ascending ids of ``ends(name, conv_id)``.

    Ids are ordered over all tasks and joined to runs first; a hash reads its message from front to back, so
    the runs of one node then go through one task, a few bytes an id.
    """
    runs = settle(
        ends.select("name", "conv_id")
        .repartitionByRange("name", "conv_id")
        .sortWithinPartitions("name", "conv_id")
        .mapInArrow(_pieces, "name decimal(38,0), first bigint, ids string")
    )
    return runs.repartition("name").sortWithinPartitions("name", "first").mapInArrow(
        _digests, "name decimal(38,0), sha256 string"
    )


def segments(paths: DataFrame) -> DataFrame:
    """Distinct segments of ``conv_id, depth, a, b, bytes, name``: ``start, depth, turns, n, conv_id``."""
    band = F.floor((F.col("depth") - 1) / BAND)
    # At most BAND turns of a conversation.
    cut = paths.groupBy("conv_id", band.alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "a", "b", "bytes", "name"))).alias("all")
    )
    zero = F.lit(0).cast("decimal(38,0)")
    ends = cut.select("conv_id", "band", F.element_at("all", -1)["name"].alias("end"))
    above = ends.select("conv_id", (F.col("band") + 1).alias("band"), F.col("end").alias("_start"))
    started = cut.join(above, ["conv_id", "band"], "left")
    plain = F.transform("all", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["bytes"].alias("bytes")))
    # Start and end name the whole content, so copies meet in the map side of this grouping.
    return (
        started.groupBy(
            F.coalesce("_start", zero).alias("start"),
            (F.col("band") * BAND).alias("depth"),
            F.element_at("all", -1)["name"].alias("end"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first(plain).alias("turns"))
        .drop("end")
    )


def _order(turn_list: Column) -> Column:
    """Turn hashes one after another, so that the order of the texts is that of the tree."""
    return F.array_join(F.transform(turn_list, lambda t: F.lpad(F.hex(t["a"]), 16, "0")), "")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix tree of ``conversations(conv_id, turn, role, text)``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.
    """
    ship(conversations.sparkSession)
    rows, lengths = rebuilt(turns(conversations))
    lengths = settle(lengths)
    mask = F.lit((1 << 63) - 1)
    value = (
        F.col("a").bitwiseAND(mask).cast("decimal(38,0)") * F.lit(str(1 << 63)).cast("decimal(38,0)")
        + F.col("b").bitwiseAND(mask).cast("decimal(38,0)")
    ).cast("decimal(38,0)")
    valued = rows.withColumn("_value", value)
    paths = settle(running(valued, "conv_id", "depth", ["_value"], ["name"], FACTOR, PRIME).drop("_value"))

    shards = segments(paths)
    ordered = shards.repartitionByRange("depth", "start", _order(F.col("turns"))).select(
        "start", "depth", "turns", "n", "conv_id"
    )
    walked = ordered.mapInArrow(
        _walked, "depth bigint, name decimal(38,0), above decimal(38,0), n_convs bigint, conv_id bigint, bytes bigint"
    )
    merged = walked.groupBy("depth", "name").agg(
        F.first("above").alias("above"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.first("bytes").alias("bytes"),
    )
    root = lengths.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("decimal(38,0)")
    top = root.select(
        F.lit(0).cast("bigint").alias("depth"), zero.alias("name"), F.lit(None).cast("decimal(38,0)").alias("above"),
        "n_convs", "conv_id", F.lit(0).cast("bigint").alias("bytes"),
    )
    nodes = settle(merged.unionByName(top))

    children = nodes.where("depth > 0").groupBy(F.col("above").alias("name"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    grown = settle(nodes.join(children, ["name", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    # Every node lies on the path of its smallest member and is counted there, once.
    own = grown.where("depth > 0").select(
        "conv_id", "depth",
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("_saved"), (F.col("n_children") == 0).cast("int").alias("_leaf"),
    )
    worth = paths.select("conv_id", "depth", "name").join(own, ["conv_id", "depth"], "left")
    worth = worth.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("_saved", "_leaf")})
    below = running(worth, "conv_id", "depth", ["_saved", "_leaf"], ["saved", "leaves"], descending=True)
    below = settle(below.select("conv_id", "depth", "name", "saved", "leaves"))
    sums = [F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")]
    subtrees = below.groupBy("name", "depth").agg(*sums)
    # The root's subtree is all of them; a root without children is its only leaf.
    whole = below.where("depth = 1").agg(*sums).select(
        zero.alias("name"), F.lit(0).cast("bigint").alias("depth"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
    )

    ends = paths.join(lengths, (paths["conv_id"] == lengths["conv_id"]) & (paths["depth"] == lengths["n_turns"])).select(
        "name", paths["conv_id"]
    )
    digests = member_digests(ends.unionByName(lengths.where("n_turns = 0").select(zero.alias("name"), "conv_id")))

    parents = grown.select(
        F.col("name").alias("above"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("_matches"),
    )
    full = grown.join(subtrees.unionByName(whole), ["name", "depth"]).join(digests, "name", "left")
    placed = lookup_join(full, parents, ["above", "depth"], row_id=["name"], matches="_matches", how="left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return placed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", long("n_children"), long("n_leaves"), long("saved_tokens"),
        F.coalesce("sha256", nothing).alias("ends_sha256"),
    )
