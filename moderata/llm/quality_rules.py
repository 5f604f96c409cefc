"""Quality rules: repetition counts and the distance of a text from its language.

A document's histogram of character classes and its histogram of common words are
compared with those of its language by Jensen-Shannon distance. The references are
measured on all documents of the language. Everything is a column expression: the
texts are read once and never moved, and only sums per language are shuffled.

Defined results: a null or empty text has no words and fails the base rules; a null
language is a language of its own; a language with fewer than ``min_reference_words``
words has no reference and one without a word list no word histogram, and their
documents are judged by what is left; repeated rows are judged one by one; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.llm.common import count_chars, let, n_chars, words
from moderata.operators.joins import checked_broadcast
from moderata.session import settle

# Frequent function words of a language, the bins of its word histogram.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by this from at not or have an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus avec ce il ne".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}

# Character classes: lower case and blanks are cut out first, the others are counted in the rest.
PLAIN = r"a-z\x20\x09-\x0D"
REST = {"upper": "A-Z", "digit": "0-9", "wide": r"^\x00-\x7F"}
CLASSES = ("lower", "blank", *REST)
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_REFERENCE_WORDS = 10_000
# A histogram of few counts is far from any reference by chance alone, so a limit is
# ``first + second / sqrt(words)``.
CLASS_LIMIT = (0.2, 0.8)
# ``n`` words drawn from a reference of 25 words and a rest are about 2.12 / sqrt(n) from it.
WORD_LIMIT = (0.08, 2.2)


def _term(p: Column, q: Column) -> Column:
    """One bin's part of twice the Jensen-Shannon divergence, in nats."""
    side = lambda x: F.when(x > 0, x * F.log(2 * x / (p + q))).otherwise(F.lit(0.0))
    return side(p) + side(q)


def _distance(twice_nats: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, from twice the divergence in nats."""
    return F.round(F.sqrt(F.greatest(twice_nats, F.lit(0.0)) / F.lit(2.0) / F.log(F.lit(2.0))), 6)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    with_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), with_word)
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def repeated_window_words(tokens: Column, size: int = 3) -> Column:
    """Words inside a window of ``size`` words that occurs twice or more, the first included.

    Only a text in which some window repeats goes further: its windows are sorted
    by their hash, so equal ones are neighbours, and the words under the marked
    windows are the union of their intervals.
    """

    def hash_at(i: Column) -> Column:
        return F.xxhash64(*[F.get(tokens, i + k) for k in range(size)])

    def under(starts: Column) -> Column:
        step = lambda s, k: F.least(F.lit(size), F.get(starts, k + 1) - s)  # noqa: E731  the last has no next
        return F.aggregate(F.transform(starts, step), F.lit(0), lambda total, n: total + n)

    def marked(ordered: Column) -> Column:
        at = lambda k: F.get(ordered, k)["h"]
        again = lambda w, k: w["h"].eqNullSafe(at(k - 1)) | w["h"].eqNullSafe(at(k + 1))
        return F.sort_array(F.transform(F.filter(ordered, again), lambda w: w["i"]))

    def found(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        total = let(F.sort_array(placed), lambda ordered: let(marked(ordered), under))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(F.lit(0))

    hashes = F.transform(F.sequence(F.lit(0), F.size(tokens) - size), hash_at)
    return F.when(F.size(tokens) < size, F.lit(0)).otherwise(let(hashes, found))


def bin_counts(tokens: Column, bins: Sequence[str]) -> Column:
    """How often each word of ``bins`` occurs among ``tokens``."""
    known = F.array(*[F.lit(b) for b in bins])
    longest = max(len(b.encode()) for b in bins)
    short = F.filter(tokens, lambda w: F.octet_length(w) <= longest)
    places = F.array_remove(F.transform(short, lambda w: F.array_position(known, w).cast("int")), 0)

    def counts(ordered: Column) -> Column:
        # After sorting, a bin's count is the distance between its first place and the next bin's.
        first = F.transform(
            F.sequence(F.lit(1), F.lit(len(bins))), lambda b: F.array_position(ordered, b).cast("int")
        )
        until = lambda f, k: F.array_min(
            F.filter(F.slice(f, k + 2, len(bins)), lambda x: x > 0)
        )
        return let(
            first,
            lambda f: F.transform(
                f,
                lambda start, k: F.when(
                    start > 0, F.coalesce(until(f, k), F.size(ordered) + 1) - start
                ).otherwise(F.lit(0)),
            ),
        )

    return let(F.sort_array(places), counts)


def counts(docs: DataFrame, common_words: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """Word, repetition, character-class and common-word counts of ``docs(doc_id, text, lang)``."""
    text, lang = F.col("text"), F.coalesce("lang", F.lit(""))
    histogram = lambda w: F.coalesce(
        *[F.when(lang == name, bin_counts(w, bins)) for name, bins in common_words.items()],
        F.array().cast("array<int>"),
    )
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            n_chars(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_window_words(w).cast("bigint").alias("n_repeat_words"),
            histogram(w).alias("bin_counts"),
        ),
    )
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{PLAIN}]+", "")
    of_rest = let(
        rest,
        lambda r: F.struct(
            n_chars(r).cast("bigint").alias("n_rest"),
            count_chars(r, SYMBOLS).cast("bigint").alias("n_symbols"),
            *[count_chars(r, c).cast("bigint").alias(f"n_{name}") for name, c in REST.items()],
        ),
    )
    made = docs.select(
        "doc_id",
        lang.alias("lang"),
        n_chars(text).cast("bigint").alias("n_chars"),
        repeated_lines(text).cast("bigint").alias("n_dup_lines"),
        of_words.alias("of_words"),
        of_rest.alias("of_rest"),
    )
    blank = F.col("n_chars") - F.col("word_chars")
    return (
        made.select("doc_id", "lang", "n_chars", "n_dup_lines", "of_words.*", "of_rest.*")
        .withColumn("n_blank", blank)
        .withColumn("n_lower", F.col("word_chars") - F.col("n_rest"))
        .drop("n_rest")
    )


def references(
    counted: DataFrame,
    common_words: Mapping[str, Sequence[str]] = COMMON_WORDS,
    min_reference_words: int = MIN_REFERENCE_WORDS,
) -> DataFrame:
    """Per language the shares of the character classes and of its common words."""
    width = max(map(len, common_words.values()), default=0)
    total = F.nullif(F.sum("n_chars"), F.lit(0))
    classes = [(F.sum(f"n_{name}") / total).alias(f"q_{name}") for name in CLASSES]
    n_words = F.sum("n_words")
    bins = F.array(*[F.coalesce(F.sum(F.get("bin_counts", F.lit(i))), F.lit(0)) for i in range(width)])
    return (
        counted.groupBy("lang")
        .agg(n_words.alias("q_words"), bins.alias("q_counts"), *classes)
        .where(F.col("q_words") >= min_reference_words)
        .withColumn("q_bins", F.transform("q_counts", lambda n: n / F.col("q_words")))
        .drop("q_words", "q_counts")
    )


def class_distance() -> Column:
    """Distance of the character classes, over the ``n_*`` and ``q_*`` columns."""
    total = F.col("n_chars").cast("double")
    pairs = [(F.col(f"n_{name}") / total, F.col(f"q_{name}")) for name in CLASSES]
    left = [F.greatest(1 - sum(side, F.lit(0.0)), F.lit(0.0)) for side in zip(*pairs, strict=True)]
    terms = [_term(p, q) for p, q in [*pairs, tuple(left)]]
    known = F.col(f"q_{CLASSES[0]}").isNotNull()
    return F.when((F.col("n_words") >= MIN_WORDS) & known, _distance(sum(terms, F.lit(0.0))))


def word_distance() -> Column:
    """Distance of the common words; all other words are one more bin."""
    zero = F.struct(*[F.lit(0.0).alias(name) for name in ("js", "p", "q")])

    def add(acc: Column, bin_: Column) -> Column:
        p, q = bin_["n"] / F.col("n_words"), bin_["q"]
        return F.struct(
            (acc["js"] + _term(p, q)).alias("js"), (acc["p"] + p).alias("p"), (acc["q"] + q).alias("q")
        )

    rest = lambda x: F.greatest(1 - x, F.lit(0.0))
    paired = F.transform("bin_counts", lambda n, i: F.struct(n.alias("n"), F.get("q_bins", i).alias("q")))
    found = F.aggregate(
        paired, zero, add, lambda acc: _distance(acc["js"] + _term(rest(acc["p"]), rest(acc["q"])))
    )
    return F.when((F.col("n_words") >= MIN_WORDS) & (F.size("bin_counts") > 0) & F.col("q_bins").isNotNull(), found)


def judge(
    docs: DataFrame,
    *,
    common_words: Mapping[str, Sequence[str]] = COMMON_WORDS,
    min_reference_words: int = MIN_REFERENCE_WORDS,
    class_limit: tuple[float, float] = CLASS_LIMIT,
    word_limit: tuple[float, float] = WORD_LIMIT,
) -> DataFrame:
    """Counts, distances and the verdict ``kept`` for every row of ``docs(doc_id, text, lang)``.

    Building the frame runs jobs: the counts of every document go to a narrow
    settled table, which feeds the references and the verdicts.
    """
    counted = settle(counts(docs, common_words))
    known = settle(references(counted, common_words, min_reference_words))

    def within(distance: str, limit: tuple[float, float]) -> Column:
        allowed = F.lit(limit[0]) + F.lit(limit[1]) / F.sqrt(F.col("n_words").cast("double"))
        return F.col(distance).isNull() | (F.col(distance) <= allowed)

    repeats = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    usual = within("class_distance", class_limit) & within("word_distance", word_limit)
    return (
        counted.join(checked_broadcast(known), "lang", "left")
        .withColumn("class_distance", class_distance())
        .withColumn("word_distance", word_distance())
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeats)
        .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(usual))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "class_distance", "word_distance",
        )
    )
