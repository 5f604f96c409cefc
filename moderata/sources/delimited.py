"""Delimited text in parallel, with line breaks inside quoted fields.

A byte range of a file cannot tell by itself whether it begins inside a quoted field. So every physical line
is a small function: where a reader ends that begins the line outside a quoted field, and where one that begins
inside. The functions of a range are composed, the ranges' compositions are folded in file order, and then
every line knows how it begins. Lines that begin outside start a record; the others are joined to the record
before them, also over the border of a range. All of it is scans, windows inside a byte range and one row for
each range; only records of several lines are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPTIONS = {"sep": "\t", "quote": '"', "escape": '"'}
# After pairs of quotes are taken out. A field that begins with a quote runs to the next one.
_FIELD = r'(?:"[^"]*+"[^\t]*+|[^"\t][^\t]*+|)'
_FROM_OUTSIDE = rf"^{_FIELD}(?:\t{_FIELD})*+$"
_FROM_INSIDE = rf'^[^"]*+"[^\t]*+(?:\t{_FIELD})*+$'
_RANGE = ["file", "range"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, range, at, line, outside, inside``: 1 if a reader that began so ends the line inside a quoted field."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    single = F.replace("line", F.lit('""'), F.lit(""))
    quoted = F.contains("line", F.lit('"'))
    ends_inside = lambda pattern: (~single.rlike(pattern)).cast("int")
    return lines.withColumns(
        {
            "outside": F.when(quoted, ends_inside(_FROM_OUTSIDE)).otherwise(F.lit(0)),
            "inside": F.when(quoted, ends_inside(_FROM_INSIDE)).otherwise(F.lit(1)),
        }
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """``file, range, begins``: 1 if a range begins inside a quoted field; one row for each range."""
    is_swap = (F.col("outside") == 1) & (F.col("inside") == 0)
    is_fixed = F.col("outside") == F.col("inside")
    # The last line that ends alike from both sides, and the parity of the swaps after it.
    last = F.max(F.when(is_fixed, F.struct("at", "outside")))
    swaps = F.collect_list(F.when(is_swap, F.col("at")))
    folded = lines.groupBy(*_RANGE).agg(last.alias("last"), swaps.alias("swaps")).select(
        *_RANGE,
        F.col("last.outside").alias("fixed"),
        (F.size(F.filter("swaps", lambda s: F.col("last").isNull() | (s > F.col("last.at")))) % 2).alias("odd"),
    )
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("odd").over(before), F.lit(0))
    # Swaps count from the last range that fixes the state on.
    marked = folded.withColumn("upto", F.sum("odd").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "odd", "upto")), ignorenulls=True).over(before)
    known = marked.withColumn("total", total).withColumn("known", fixed)
    since = F.when(F.col("known").isNull(), F.col("total")).otherwise(F.col("total") - F.col("known.upto") + F.col("known.odd"))
    begins = (F.coalesce(F.col("known.fixed"), F.lit(0)) + since) % 2
    return known.select(*_RANGE, begins.cast("int").alias("begins"))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``is_first, record``: the records of the files, whole, and which is the first of its file."""
    lines = _lines(spark, path)
    begun = lines.join(_ranges(lines).withColumnsRenamed({"file": "_file", "range": "_range"}),
                       (F.col("file") == F.col("_file")) & (F.col("range") == F.col("_range"))).drop("_file", "_range")
    inside_range = Window.partitionBy(*_RANGE).orderBy("at")
    before = inside_range.rowsBetween(Window.unboundedPreceding, -1)
    is_swap = ((F.col("outside") == 1) & (F.col("inside") == 0)).cast("int")
    swapped = F.coalesce(F.sum(is_swap).over(before), F.lit(0))
    counted = begun.withColumn("swapped", swapped)
    fixed = F.last(
        F.when(F.col("outside") == F.col("inside"), F.struct("outside", "swapped")), ignorenulls=True
    ).over(before)
    state = (F.coalesce(F.col("fixed.outside"), F.col("begins")) + F.col("swapped") - F.coalesce(F.col("fixed.swapped"), F.lit(0))) % 2
    started = counted.withColumn("fixed", fixed).withColumn("starts", (state == 0).cast("int"))
    number = F.sum("starts").over(inside_range.rowsBetween(Window.unboundedPreceding, 0))
    numbered = started.select(
        *_RANGE, "at", "line", "starts", number.alias("number"), F.lead("starts").over(inside_range).alias("next_starts")
    )
    alone = (F.col("starts") == 1) & (F.coalesce("next_starts", F.lit(0)) == 1)
    is_first = (F.col("range") == 0) & (F.col("number") == 1)
    single = numbered.where(alone).select(is_first.alias("is_first"), F.col("line").alias("record"))

    # A range without a start of its own, or lines before its first, go on with the last record before.
    parts = numbered.where(~alone)
    last_of = numbered.groupBy(*_RANGE).agg(F.max("number").alias("last"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    owner = last_of.withColumn(
        "owner", F.last(F.when(F.col("last") > 0, F.struct("range", "last")), ignorenulls=True).over(earlier)
    ).select(F.col("file").alias("_file"), F.col("range").alias("_range"), "owner")
    owned = parts.join(owner, (F.col("file") == F.col("_file")) & (F.col("range") == F.col("_range")))
    mine = F.col("number") > 0
    keyed = owned.select(
        "file",
        F.when(mine, F.col("range")).otherwise(F.col("owner.range")).alias("home"),
        F.when(mine, F.col("number")).otherwise(F.col("owner.last")).alias("record_no"),
        F.struct("range", "at", "line").alias("part"),
    )
    # One record's lines.
    joined = keyed.groupBy("file", "home", "record_no").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    several = joined.select(((F.col("home") == 0) & (F.col("record_no") == 1)).alias("is_first"), text.alias("record"))
    return single.unionByName(several)


def _parsed(record: Column, n: int) -> Column:
    return F.from_csv(record, ", ".join(f"c{k} string" for k in range(n)), OPTIONS)


def read_delimited(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns of tab-separated files as text, named by their header, which must be the same in all files."""
    found = records(spark, path).where(F.col("record") != "")
    headers = [r["record"] for r in found.where("is_first").select("record").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"the files in {path} have {'different headers' if headers else 'no header'}")
    # Quoted names may hold tabs, so the line's own parts are an upper bound.
    header = headers[0].lstrip("﻿")
    most = header.count("\t") + 1
    row = spark.range(1).select(_parsed(F.lit(header), most).alias("h")).select("h.*").first()
    names = [value for value in row]
    while names and names[-1] is None:
        names.pop()
    parsed = found.where(~F.col("is_first")).select(_parsed(F.col("record"), len(names)).alias("row"))
    return parsed.select(*[F.col(f"row.c{k}").alias(name or f"_c{k}") for k, name in enumerate(names)])
