"""WARC archives and their merged capture index.

Every task writes its records to archive files and returns them as a run of index
entries sorted by URL key and capture time. The runs are merged: entries are dealt
by range of that key, and a task merges the k runs of its range with a loser tree,
so the parts put one after the other are one globally ordered index. A record
whose payload occurred before (in order of ``page_id``) is written as a revisit.

Files are written below the shared folder under a temporary name and renamed when
whole, named by partition: a task that runs again writes the same file. Records are
compressed one by one; files are rolled at ``max_bytes``, so reading is bounded.

Defined results: a null ``html`` is an empty payload; a null ``url`` is written without a
target and has an empty key; a null ``page_id`` is an original only if all rows with
its payload have none; repeated rows are records of their own, and all rows with the
smallest id of a payload are originals; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderata.llm.common import ship
from moderata.operators.joins import lookup_join
from moderata.session import new_folder, settle

# Smaller payloads are always written as responses.
MIN_REVISIT_BYTES = 0
MAX_FILE_BYTES = 64 << 20
# Pages carry no capture time, so a page's number gives one.
FIRST_CAPTURE = datetime(2020, 1, 1, tzinfo=UTC)

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def _columns(schema: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [c.split() for c in schema.split(", ")]
    return [name for name, _ in pairs], [_ARROW[kind] for _, kind in pairs]


INDEX = (
    "url_key string, captured string, page_id bigint, record_type string, payload_digest string, "
    "payload_bytes bigint, file string, position bigint, length bigint"
)
RECORD = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "url string, captured string"
)
INDEX_NAMES, INDEX_TYPES = _columns(INDEX)
MERGED_NAMES, MERGED_TYPES = _columns(f"{INDEX}, range int, place bigint")
RECORD_NAMES, RECORD_TYPES = _columns(RECORD)


def url_key(url: str | None) -> str:
    """Sortable key of a URL: host labels from the right, then path and query; no fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.strip().lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    path = (parts.path or "/").lower()
    return ",".join(reversed(host.split("."))) + ")" + path + (f"?{query.lower()}" if query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


class LoserTree:
    """Merge of sorted runs: inner nodes keep the loser of their match, the winner is on top."""

    def __init__(self, runs: Sequence[Iterator[Any]]) -> None:
        self.runs = list(runs)
        self.heads: list[Any] = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, len(self.runs))
        self.top = -1
        for run in range(len(self.runs)):
            self._enter(run)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run ``a`` goes first; an empty run loses, ties go to the lower run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _enter(self, run: int) -> None:
        at, winner = (run + len(self.runs)) // 2, run
        while at > 0:
            other = self.losers[at]
            if other < 0:
                self.losers[at] = winner
                return
            if self._beats(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.top = winner

    def __iter__(self) -> Iterator[Any]:
        while self.runs and self.heads[self.top] is not None:
            yield self.heads[self.top]
            run = self.top
            self.heads[run] = next(self.runs[run], None)
            at, winner = (run + len(self.runs)) // 2, run
            while at > 0:
                if self._beats(self.losers[at], winner):
                    self.losers[at], winner = winner, self.losers[at]
                at //= 2
            self.top = winner


def _block(fields: dict[str, str | None], content: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"


def _record(page: int | None, url: str | None, html: str | None, first: int | None) -> tuple[bytes, tuple]:
    """A page's record and its index entry up to the file; ``first`` is the page it revisits, if any."""
    payload = (html or "").encode()
    revisit = first is not None and len(payload) >= MIN_REVISIT_BYTES
    captured = (FIRST_CAPTURE + timedelta(seconds=(page or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
    digest, kind = digest_of(payload), "revisit" if revisit else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{page}>",
        "WARC-Date": captured,
        "WARC-Target-URI": None if url is None else re.sub(r"[\r\n]+", " ", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": f"<urn:page:{first}>" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
    }
    block = _block(fields, http.encode() + (b"" if revisit else payload))
    return block, (url_key(url), captured, page, kind, digest, len(payload))


def _order(entry: tuple) -> tuple:
    """Sort key of an index entry: URL key, capture time, page, place."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[6], entry[7]


def write(pages: DataFrame, folder: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` in ``folder``; returns the settled runs of index entries.

    Each file's entries are one run, sorted. Pages move only if the table of repeated
    payloads is too large to broadcast. Building the frame runs the jobs.
    """
    ship(pages.sparkSession)
    payload = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    keyed = pages.select("page_id", "url", "html", payload.alias("payload"))
    repeated = (
        keyed.groupBy("payload")
        .agg(F.min("page_id").alias("smallest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    joined = lookup_join(keyed, repeated, ["payload"], row_id=["page_id"], matches="n", how="left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("smallest")), F.col("smallest"))
    rows = joined.select("page_id", "url", "html", first.alias("first"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files = _Files(folder, context.partitionId(), context.taskAttemptId(), max_bytes)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                run = files.add(*_record(*row))
                if run:
                    yield _as_batch(run, INDEX_NAMES, INDEX_TYPES)
        yield _as_batch(files.close(), INDEX_NAMES, INDEX_TYPES)

    return settle(rows.mapInArrow(archive, INDEX))


class _Files:
    """Archive files of one task, rolled at a size."""

    def __init__(self, folder: str, part: int, attempt: int, max_bytes: int) -> None:
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.part, self.attempt, self.max_bytes, self.number = part, attempt, max_bytes, 0
        self.out: Any = None
        self.run: list[tuple] = []
        self.position = 0

    def _path(self) -> str:
        return f"{self.folder}/part-{self.part:06d}-{self.number:04d}.warc.gz"

    def add(self, record: bytes, entry: tuple) -> list[tuple]:
        """Append a record; returns the run of the file if that is now full."""
        if self.out is None:
            self.out = self.system.open_output_stream(f"{self._path()}.{self.attempt}", compression=None)
            self.position = 0
        packed = gzip.compress(record, compresslevel=5, mtime=0)
        self.out.write(packed)
        self.run.append((*entry, self._path(), self.position, len(packed)))
        self.position += len(packed)
        return self.close() if self.position >= self.max_bytes else []

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self.out.close()
        self.system.move(f"{self._path()}.{self.attempt}", self._path())
        run, self.run, self.out = sorted(self.run, key=_order), [], None
        self.number += 1
        return run


def _as_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
    )


def merge(runs: DataFrame) -> DataFrame:
    """One globally ordered index of all runs, with ``range`` and ``place`` as its order.

    Entries are dealt by ranges of URL key, time and page, so one URL's captures can
    spread over several tasks. Rows of a run arrive in blocks; a block out of order is
    sorted, and the runs are merged by a loser tree.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[tuple]] = {}
        for batch in batches:
            for entry in zip(*(batch.column(i).to_pylist() for i in range(len(INDEX_NAMES))), strict=True):
                by_run.setdefault(entry[6], []).append(entry)
        keyed = [sorted((_order(e), e) for e in run) for _, run in sorted(by_run.items())]
        part, block = TaskContext.get().partitionId(), []
        for place, (_, entry) in enumerate(LoserTree([iter(run) for run in keyed])):
            block.append((*entry, part, place))
            if len(block) >= 10_000:
                yield _as_batch(block, MERGED_NAMES, MERGED_TYPES)
                block = []
        yield _as_batch(block, MERGED_NAMES, MERGED_TYPES)

    dealt = runs.repartitionByRange("url_key", "captured", "page_id", "file", "position")
    return settle(dealt.mapInArrow(merged, f"{INDEX}, range int, place bigint"))


def histories(index: DataFrame) -> DataFrame:
    """Captures of each URL key: how many, of how many payloads, the first and the last."""
    return index.groupBy("url_key").agg(
        F.count(F.lit(1)).alias("n_captures"),
        F.sum((F.col("record_type") == "response").cast("bigint")).alias("n_responses"),
        F.min("captured").alias("first_captured"),
        F.max("captured").alias("last_captured"),
    )


def read(index: DataFrame, folder: str) -> DataFrame:
    """Records of the archives, by the files and places of an index.

    Payload digests and lengths of responses are taken from the payload read and
    must agree with the record's header.
    """
    ship(index.sparkSession)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, position, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if file != name:
                    name, source = file, system.open_input_file(file)
                source.seek(position)
                rows.append(parse(gzip.decompress(source.read(length))))
            yield _as_batch(rows, RECORD_NAMES, RECORD_TYPES)

    # As many parts as files: entries are few bytes, but each stands for a record to read.
    n_files = index.select(F.count_distinct("file")).first()[0]
    by_file = index.select("file", "position", "length").repartition(max(1, n_files), "file")
    return by_file.sortWithinPartitions("file", "position").mapInArrow(records, RECORD)


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").rstrip(">")
    return None if number in ("", "None") else int(number)


def parse(record: bytes) -> tuple:
    """``RECORD`` columns of one uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    fields = dict(line.split(": ", 1) for line in lines)
    content = rest[: int(fields["Content-Length"])]
    digest, n_bytes = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = content.partition(b"\r\n\r\n")[2]
        if (digest_of(payload), len(payload)) != (digest, n_bytes):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its header")
    return (
        _page(fields["WARC-Record-ID"]), n_bytes, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")),
        fields.get("WARC-Target-URI"), fields["WARC-Date"],
    )


def archive_and_read(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the archives of ``pages``, merge their index and read every record back: ``(records, index)``."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    index = merge(write(pages, folder))
    return read(index, folder), index
