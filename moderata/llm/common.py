"""Words, row-bound sub-expressions and small checks shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than ASCII white space.
BLANKS = " \t\n\x0b\f\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    An expression named twice, or named inside a lambda, may be computed at every
    mention; bound as the element of a one-element array it is computed once.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text in order; none for a null or blank text.

    Blanks become spaces first: splitting at one literal character needs no
    regular expression.
    """
    spaced = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def n_chars(text: Column) -> Column:
    """Code points of a text, 0 for null."""
    return F.coalesce(F.char_length(text), F.lit(0))


def count_chars(text: Column, chars: str) -> Column:
    """Code points of ``text`` inside the character class ``chars`` (written without brackets)."""
    outside = F.regexp_replace(text, f"[{chars}]+", "")
    return n_chars(text) - n_chars(outside)


def fresh(df: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_KEPT: dict[str, dict[object, object]] = {}


def kept(kind: str, key: object, make: Callable[[], object], limit: int = 4) -> object:
    """``make()``, kept in the worker between its tasks, at most ``limit`` of a kind.

    A worker outlives the stage it was started for. When a stage asks for another kind,
    what the stages before it kept is given up first, so the tables of several
    operators are never held together.
    """
    if kind not in _KEPT:
        forget()
    tables = _KEPT.setdefault(kind, {})
    if key not in tables:
        if len(tables) >= limit:
            tables.clear()
        tables[key] = make()
    return tables[key]


# Bytes of the values that one table of a worker remembers, and what an entry takes beside its key and value.
REMEMBERED_BYTES = 16 << 20
ENTRY_BYTES = 180


class Remembered(dict):
    """Values made at their first look-up; beyond ``REMEMBERED_BYTES`` the table starts anew."""

    def __init__(self, make: Callable[[Any], Any]) -> None:
        self.make = make
        self.size = 0

    def __missing__(self, key: Any) -> Any:
        value = self.make(key)
        self.size += ENTRY_BYTES + len(key) + (len(value) if isinstance(value, bytes) else 0)
        if self.size > REMEMBERED_BYTES:
            self.clear()
            self.size = ENTRY_BYTES
        self[key] = value
        return value


def forget() -> None:
    """Give up what the worker keeps for the operators of earlier stages, and the memory it stood in."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # not this C library
            ctypes.CDLL(None).malloc_trim(0)


_SHIPPED: set[str] = set()


# Rows of an Arrow batch: texts are long, and a worker holds a batch in several forms at a time.
BATCH_ROWS = 1024
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Functions that keep tables between tasks must be imported there, not pickled. The session's Arrow
    batches are limited to ``BATCH_ROWS`` rows, or fewer if it asks for fewer.
    """
    if not 0 < int(spark.conf.get(_ROWS_CONF)) <= BATCH_ROWS:
        spark.conf.set(_ROWS_CONF, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
