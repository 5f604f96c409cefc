"""Line deduplication by an exact set-similarity join.

A line is the set of its shingles of five words (a shorter line is one shingle), and
equal sets are one from here on. The shingles of a line are put in one order for the whole corpus; two lines with Jaccard
similarity of 0.8 or more have their first common shingles among the first few of both, their prefixes. Prefixes
are first taken by hash alone, so long that they hold the first ``SHARED`` common shingles (all, if there are fewer), and a set
that shares fewer shingles of its prefix with other prefixes is done with: only the others and their lines go on.
Theirs are the prefixes of the first common shingle, in an order of
rare before frequent: the lines with a shingle that ``FREQUENT`` prefixes have are counted in full, and the shingles that
``FREQUENT`` of these lines have follow all others, by that count. Every line with such a
shingle in its prefix is ordered anew; for the others the prefix by hash is the same. Prefix shingles that only one
set has are dropped, the others are joined, pairs pass filters on length and on the position of the shared shingle, and
the shingles themselves are compared. A line goes if an earlier line, in order of
``doc_id`` and line number, is that similar to it.

Only whether a line has an earlier match is asked, so of a dense group every line is
first compared with the group's earliest, and only lines still open go into the join
of all pairs. Only column expressions and joins are used.

Defined results: a null text stays null and has no lines; a line without words stays;
equal lines of one document are matches too; rows that agree in ``doc_id`` and text
get the same result; a null ``doc_id`` comes before all others; a document that loses
all its lines has an empty text; an empty table gives no rows; all other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moderata.llm.common import BLANKS, fresh, let, words
from moderata.operators.joins import checked_broadcast, lookup_join
from moderata.session import settle

SHINGLE = 5
# Similarity as a fraction, so that its comparison is exact.
SIMILARITY = (4, 5)
FREQUENT = 50
# Shingles that the prefixes of similar sets have in common, if the sets have as many.
SHARED = 4
HERE = ("doc_id", "doc", "line_no")


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)) != ""


def shingles(line: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words of a line, without repeats; none for a line without words."""
    steps = _run_steps(size)

    def run(at: int, value: Column) -> Column:
        return let(value, lambda v: run(at + 1, steps[at](v))) if at < len(steps) else value

    return run(0, words(line))


def _run_steps(size: int) -> list[Callable[[Column], Column]]:
    """The way from the words of a line to its shingles, in order of their hashes.

    A line of fewer words is one run of them all. Every step uses its argument more than
    once, so it has to be bound.
    """

    def hashed(w: Column) -> Column:
        return F.transform(w, lambda word: F.xxhash64(word))

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        few = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= size, many).otherwise(few)

    return [hashed, runs, F.array_distinct, F.sort_array]


def _shingle_texts(line: Column, size: int = SHINGLE) -> Column:
    """The runs themselves, to compare two lines exactly."""

    def runs(w: Column) -> Column:
        at = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)])
        many = F.transform(F.sequence(F.lit(0), F.size(w) - size), at)
        return F.when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(many))

    return let(words(line), runs)


def _spaced(text: Column) -> Column:
    """``text`` with a space for every blank but line ends; a text without such a blank is not searched again to replace it."""
    others = [F.lit(blank) for blank in BLANKS if blank not in " \n"]
    spaced = reduce(lambda t, blank: F.replace(t, blank, F.lit(" ")), others, text)
    return F.when(reduce(or_, [F.contains(text, blank) for blank in others]), spaced).otherwise(text)


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, doc, line_no, line`` with ``doc`` a hash of id and text, and spaces as the only blanks of a line."""
    doc = F.xxhash64("doc_id", "text").alias("doc")
    return docs.select("doc_id", doc, F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line_no", "line"))


def _least(n: Column) -> Column:
    """Shingles that a set of ``n`` has in common with any similar set, at least."""
    num, den = SIMILARITY
    return F.floor((n * num + (den - 1)) / den).cast("int")


def _need(n: Column) -> Column:
    """Shingles of its prefix that a set of ``n`` has in common with the prefix of any similar set, at least."""
    return F.least(F.lit(SHARED), _least(n))


def _prefix(n: Column, common: Column | int = 1) -> Column:
    """Length of the prefix of a set of ``n`` shingles that holds the first ``common`` it has in common with a similar set.

    Behind the ``k``-th common shingle there are at least ``_least(n) - k`` others of the set.
    """
    return n - _least(n) + common


def line_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, doc, line_no, set_key, n, prefix`` of every line with a word, prefixes by hash."""

    # Decided by the line itself: a filter on the shingles would compute them twice.
    line_words = F.array_remove(F.split("line", " "), "")
    found = _lines(docs).where(F.ltrim("line") != "").select(*HERE, line_words.alias("keys"))
    for step in _run_steps(size):
        found = found.select(*HERE, step(F.col("keys")).alias("keys"))
    n = F.size("keys")
    return found.select(
        *HERE, F.xxhash64("keys").alias("set_key"), n.alias("n"), F.slice("keys", F.lit(1), _prefix(n, _need(n))).alias("prefix")
    )


def _at(*columns: str) -> Column:
    return F.struct(*(columns or HERE))


def distinct_sets(sets: DataFrame) -> DataFrame:
    """One row per set of :func:`line_sets`: ``set_key``, its first line ``at`` and its number of lines."""
    return sets.groupBy("set_key").agg(F.min(_at()).alias("at"), F.count(F.lit(1)).alias("n_lines"))


def _met(rows: DataFrame) -> DataFrame:
    """The prefix ``rows(set_key, token, ...)`` whose shingle another set's prefix has too."""
    # A set has a shingle once, so rows are sets.
    n_rows = F.count(F.lit(1)).over(Window.partitionBy("token"))
    return rows.withColumn("n_rows", n_rows).where("n_rows > 1").drop("n_rows")


def _enough(met: DataFrame) -> DataFrame:
    """``set_key`` of the sets with as many rows of ``met(set_key, need)`` as they need to be similar to any."""
    hits = met.groupBy("set_key").agg(F.count(F.lit(1)).alias("hits"), F.max("need").alias("need"))
    return hits.where("hits >= need").select("set_key")


def connected(sets: DataFrame) -> DataFrame:
    """``set_key`` of the :func:`line_sets` that share enough shingles with others; the rest is similar to none."""
    firsts = sets.select("set_key", "n", "prefix").dropDuplicates(["set_key"])
    return _enough(_met(firsts.select("set_key", _need(F.col("n")).cast("tinyint").alias("need"), F.explode("prefix").alias("token"))))


def _fetched(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``set_key, at, line, hashes, n`` of the lines at ``wanted(set_key, at)``, one per set."""
    places = settle(
        wanted.groupBy(F.col("at.doc").alias("doc"))
        .agg(F.collect_set(F.struct("set_key", F.col("at.line_no").alias("line_no"))).alias("places"))
    )
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), "text")
    held = keyed.join(checked_broadcast(places), "doc").select("doc_id", "doc", F.split("text", "\n").alias("lines"), "places")
    asked = held.select("doc_id", "doc", "lines", F.explode("places").alias("p"))
    asked = asked.select("p.set_key", "doc_id", "doc", "p.line_no", F.get("lines", F.col("p.line_no")).alias("line"))
    asked = asked.select("set_key", _at().alias("at"), "line").dropDuplicates(["set_key"])
    return settle(asked.select("*", shingles(F.col("line"), size).alias("hashes")).withColumn("n", F.size("hashes")))


def _prefix_rows(held: DataFrame, keys: str) -> DataFrame:
    """``set_key, at, n, place, token``: the first of the ordered ``keys`` of each set."""
    first = F.slice(keys, F.lit(1), _prefix(F.col("n")))
    return held.select("set_key", "at", "n", F.posexplode(first).alias("place", "token"))


def _tokens(held: DataFrame) -> DataFrame:
    return held.select("set_key", F.explode("hashes").alias("token"))


def _at_least(rows: DataFrame, frequent: int) -> DataFrame:
    """``token, n_rows`` of the tokens that ``frequent`` of ``rows`` have."""
    return settle(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= frequent))


def _holding(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``set_key`` of the sets whose prefix has one of ``tokens(token, n_rows)``."""
    rows = rows.select("set_key", "token")
    met = lookup_join(rows, tokens, ["token"], row_id=["set_key"], matches="n_rows", settled=True)
    return met.select("set_key").distinct()


def _reordered(held: DataFrame, many: DataFrame) -> DataFrame:
    """Prefix rows of the sets with the shingles of ``many`` last, by their number."""
    ranked = lookup_join(
        _tokens(held), many.withColumn("rank", F.col("n_rows")), ["token"],
        row_id=["set_key"], matches="n_rows", how="left", settled=True,
    )
    # One line's shingles form a group.
    keys = F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), "token")))
    ordered = ranked.groupBy("set_key").agg(F.transform(keys, lambda k: k["token"]).alias("keys"))
    return _prefix_rows(held.select("set_key", "at", "n").join(ordered, "set_key"), "keys")


def _index(held: DataFrame, frequent: int) -> DataFrame:
    """One row per set and prefix shingle that another set's prefix has too."""
    rows = _prefix_rows(held, "hashes")
    crowded = _at_least(rows, frequent)
    if crowded.head(1):
        chosen = settle(_holding(rows, crowded))
        many = _at_least(_tokens(held.join(checked_broadcast(chosen), "set_key", "left_semi")), frequent)
        # One order for all lines: whoever has a shingle of ``many`` in the prefix is ordered anew.
        anew = checked_broadcast(settle(chosen.union(_holding(rows, many)).distinct()))
        rest = rows.join(anew, "set_key", "left_anti")
        rows = rest.unionByName(_reordered(held.join(anew, "set_key", "left_semi"), many))
    return settle(_met(rows))


def _candidates(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Pairs on a shared prefix shingle that pass the order, length and position filters."""
    num, den = SIMILARITY
    own = ("set_key", "n", "place", "at")
    a = earlier.select("token", *[F.col(c).alias(f"a_{c}") for c in own])
    b = later.select("token", *[F.col(c).alias(f"b_{c}") for c in own])
    n_a, n_b = F.col("a_n"), F.col("b_n")
    must = F.ceil((n_a + n_b) * num / (num + den))
    left = F.least(n_a - F.col("a_place"), n_b - F.col("b_place"))
    passes = (
        (F.col("a_set_key") != F.col("b_set_key"))
        & (F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num)
        & (left >= must)
        & (F.col("a_at") < F.col("b_at"))
    )
    return a.join(b, "token").where(passes).select("a_set_key", "b_set_key").distinct()


def _verified(held: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``set_key`` of the later lines whose shingles are as similar as asked to the earlier line's."""
    num, den = SIMILARITY
    pairs = settle(pairs)

    def beside(found: DataFrame, table: DataFrame, column: str) -> DataFrame:
        for s in "ab":
            named = table.select(F.col("set_key").alias(f"{s}_set_key"), F.col(column).alias(f"{s}_{column}"))
            found = found.join(named, f"{s}_set_key")
        return found

    def similar(a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(a, b)) * (num + den) >= (F.size(a) + F.size(b)) * num

    # Hashes leave few pairs; those are compared word by word.
    likely = beside(pairs, held, "hashes").where(similar(F.col("a_hashes"), F.col("b_hashes")))
    likely = settle(likely.select("a_set_key", "b_set_key"))
    asked = settle(likely.select(F.explode(F.array("a_set_key", "b_set_key")).alias("set_key")).distinct())
    lines = held.select("set_key", "line").join(checked_broadcast(asked), "set_key", "left_semi")
    test = let(
        _shingle_texts(F.col("a_line"), size),
        lambda a: let(_shingle_texts(F.col("b_line"), size), lambda b: similar(a, b)),
    )
    both = beside(likely, lines, "line").where(test)
    return settle(both.select(F.col("b_set_key").alias("set_key")).distinct())


def later_matches(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE, frequent: int = FREQUENT) -> DataFrame:
    """``set_key`` of the sets with their first lines at ``wanted(set_key, at)`` that are similar to one with an earlier one."""
    held = _fetched(docs, wanted, size)
    rows = _index(held, frequent)
    earliest = rows.groupBy("token").agg(F.min(F.struct("at", "set_key", "n", "place")).alias("e"))
    pivots = earliest.select("token", "e.*")
    first = _verified(held, _candidates(pivots, rows), size)
    still_open = rows.join(checked_broadcast(first), "set_key", "left_anti")
    rest = _verified(held, _candidates(rows, still_open), size)
    return settle(first.union(rest).distinct())


def removed_lines(docs: DataFrame, size: int = SHINGLE, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, doc, removed``: the numbers of the lines that go, of the documents that lose any."""
    source = docs.select("doc_id", "text")
    sets = settle(line_sets(source, size))
    found = checked_broadcast(settle(connected(sets)))
    firsts = settle(distinct_sets(sets))
    matched = later_matches(source, firsts.join(found, "set_key", "left_semi"), size, frequent)
    told = checked_broadcast(matched.withColumn("_matched", F.lit(True)))
    # Only a line of a matched set, or of a set with several lines, can go.
    goes = firsts.join(told, "set_key", "left").where("_matched OR n_lines > 1")
    narrow = sets.select("doc_id", "doc", "line_no", "set_key")
    judged = lookup_join(narrow, goes, ["set_key"], row_id=["doc", "line_no"], matches="n_lines")
    gone = judged.where(F.col("_matched").isNotNull() | ~_at().eqNullSafe(F.col("at")))
    return gone.groupBy("doc_id", "doc").agg(F.collect_set("line_no").alias("removed"))


def deduplicate(
    docs: DataFrame, size: int = SHINGLE, drop_emptied: bool = False, frequent: int = FREQUENT
) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay, and ``n_lines``, ``n_removed``.

    With ``drop_emptied`` a document that had lines and lost them all is left out.
    Building the frame runs jobs.
    """
    gone = settle(removed_lines(docs, size, frequent))
    names = {c: fresh(docs, f"_{c}") for c in ("doc", "id", "removed")}
    lookup = checked_broadcast(
        gone.select(*[F.col(c).alias(names[k]) for k, c in (("id", "doc_id"), ("doc", "doc"), ("removed", "removed"))])
    )
    same = (F.xxhash64("doc_id", "text") == F.col(names["doc"])) & F.col("doc_id").eqNullSafe(F.col(names["id"]))
    joined = docs.join(lookup, same, "left")
    n_removed = F.coalesce(F.size(names["removed"]), F.lit(0))

    def without(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(names["removed"]))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    text = F.when(n_removed > 0, let(F.split("text", "\n"), without)).otherwise(F.col("text"))
    with_word = F.filter(F.split("text", "\n"), _has_word)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(with_word))
    if drop_emptied:
        joined = joined.where(~((n_removed > 0) & (n_lines == n_removed)))
    kept = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, n_lines.cast("bigint").alias("n_lines"), n_removed.cast("bigint").alias("n_removed"))
