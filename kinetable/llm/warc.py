"""WARC archives: writing, reading, and a globally ordered index by external merge.

Records are made by built-in functions and written by Spark's text writer (one gzip stream
an archive, records parted by the two line ends that the format asks for), so the commit
protocol and any file system that Spark knows apply. Archives hold about ARCHIVE_BYTES, by
the mean size of a page. Reading streams each archive: Spark's text reader parts it at the
words that begin a record, the parser puts parts together until a record has its
Content-Length, so a task holds one record at a time, and every payload is checked against
its digest. A task sorts its index entries in runs of at most RUN entries.

Runs are dealt by ranges of (URL key, timestamp, page), so that even one URL's captures
spread over tasks, and each task merges its parts of the runs externally: what comes in is
laid on the task's disk run by run, and a loser tree reads the runs batch by batch, in
several passes if they are more than FAN. The order of the result is global: ``position``
increases with (URL key, timestamp, page) over all partitions.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest
page id is a response and the others revisit it.

Rows: null html is an empty payload; a null or odd URL is written as ``urn:page:<id>`` or
percent-encoded; rows that repeat a page id all get a record, of the same type; a page whose
id is null never is a first one (unless alone), and refers to the smallest id of its payload.
A page's capture time is EPOCH and its id in seconds, modulo SECONDS, so that every id has a
time of four digits for the year. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, materialize, prepare, shared_dir, small, with_groups

#: Bytes of pages in an archive, the moment of page 0's capture, and seconds after which times repeat.
ARCHIVE_BYTES, EPOCH, SECONDS = 32 << 20, 1_704_067_200, 10**9
#: Entries in a run, in a batch of a run on disk, and runs that are merged at once.
RUN, BATCH, FAN = 50_000, 500, 128
#: What every record begins with.
BEGIN = b"WARC/1.1\r\n"
RUNS = "page_id long, url string, url_key string, captured_at string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, record_offset long, record_length long, run long"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data: five hexadecimal digits make four."""
    x = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(x, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _head(lines: list[Column]) -> Column:
    """Header lines; a null one is left out."""
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def write_archives(pages: DataFrame, min_bytes: int = 0) -> str:
    """Write one record for each row (page_id, url, html); returns the folder."""
    spark = prepare(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    facts = materialize(pages.select("page_id", base32_sha1(payload).alias("digest"), F.length(payload).alias("n")), "facts")
    first = facts.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    first = materialize(first.where("copies > 1"), "first", few=True)
    rows, size = facts.agg(F.count("*"), F.sum("n")).first()
    again = with_groups(facts.where(F.col("n") >= min_bytes), first, ["digest"], "copies", rows).where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = materialize(again.select(F.col("page_id").alias("again"), "first").distinct(), "again", few=True)
    discard(facts, first)

    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).join(small(again), F.col("page_id").eqNullSafe(F.col("again")), "left")
    revisit = F.col("first").isNotNull()
    body = F.col("html").cast("binary")
    http = _head([F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.octet_length("html"))])
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uri = F.coalesce(F.regexp_replace(F.col("url"), "[\\x00-\\x20\\x7F]", "%20"), F.concat(F.lit("urn:page:"), own))
    # without a zone, so that the session's has no say
    begin = F.lit(datetime.fromtimestamp(EPOCH, UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    moment = F.timestamp_add("SECOND", F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(SECONDS)), begin)
    record = F.concat(
        _head([
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: <urn:page:"), own, F.lit(">")),
            F.concat(F.lit("WARC-Date: "), F.translate(moment.cast("string"), " ", "T"), F.lit("Z")),
            F.concat(F.lit("WARC-Target-URI: "), uri),
            F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">"))),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(body)),
            F.lit("Content-Type: application/http;msgtype=response"),
            F.concat(F.lit("Content-Length: "), F.octet_length(block)),
        ]),
        block,
    )
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    p.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE_BYTES * (rows or 1) // ((size or 0) + 500 * (rows or 1)))).text(folder)
    return folder


def records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Header, block, offset and length (uncompressed) of each record, from an archive's parts
    between the words that begin a record, of which a payload may hold some as well."""
    at, held = 0, None
    for i, part in enumerate(parts):
        if i == 0:  # before the first record
            if part:
                raise ValueError("no WARC record at byte 0")
            continue
        held = part if held is None else held + BEGIN + part
        end = held.find(b"\r\n\r\n")
        if end < 0:
            continue
        head = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in held[:end].split(b"\r\n"))}
        n = int(head["content-length"])
        length = end + 4 + n + 4
        if len(held) < length:
            continue
        if len(held) > length or held[-4:] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has a wrong length")
        yield head, held[end + 4 : end + 4 + n], at, length + len(BEGIN)
        at, held = at + length + len(BEGIN), None
    if held is not None:
        raise ValueError(f"record at byte {at} is cut short")


def url_key(url: str) -> str:
    """Host reversed and parted by commas, then port and path in lower case: sorts by site."""
    try:
        u = urlsplit(url)
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    port = "" if port in (None, 80, 443) else f":{port}"
    return (",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")).lower()


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_archives(spark, folder: str) -> DataFrame:
    """Index entries of all archives in sorted runs; ``run`` numbers those of a task."""

    def entry(head: dict[str, str], block: bytes, archive: str, at: int, length: int) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, n = head["warc-payload-digest"].removeprefix("sha1:"), len(payload)
        if head["warc-type"] == "response":
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload digest of {head['warc-record-id']} in {archive} is wrong")
        else:
            n = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
        url = head["warc-target-uri"]
        return (_number(head["warc-record-id"]), url, url_key(url), head["warc-date"], head["warc-type"], n, digest, _number(head.get("warc-refers-to")), archive, at, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, bytes]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

        def sorted_run(entries: list[tuple]) -> pa.RecordBatch:
            entries.sort(key=lambda r: _order((r[2], r[3], r[0])))
            return _batch([(*r, number) for r in entries], arrow_schema(RUNS))

        held, number, base = [], 0, TaskContext.get().partitionId() << 32
        number = base
        for path, group in itertools.groupby(rows(), key=lambda r: r[0]):
            archive = path.rpartition("/")[2]
            for head, block, at, length in records(x[1] for x in group):
                held.append(entry(head, block, archive, at, length))
                if len(held) >= RUN:
                    yield sorted_run(held)
                    held, number = [], number + 1
        if held:
            yield sorted_run(held)

    files = spark.read.option("lineSep", BEGIN.decode()).option("pathGlobFilter", "part-*").text(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value")).mapInArrow(frugal(run), RUNS)


def _order(row: tuple) -> tuple:
    """By key, time and page; a null page comes first, as Spark sorts it."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def arrow_schema(spec: str) -> pa.Schema:
    return pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in spec.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next row
    costs one comparison a level, and one row of each run is held."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.tree = [-1] * self.k
        self.rows: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(self.k):
            self._next(i)
            self._replay(i)

    def _next(self, i: int) -> None:
        self.rows[i] = row = next(self.runs[i], None)
        self.keys[i] = None if row is None else _order(row)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.tree[node]
            if other == -1:  # while the tree fills: wait here for the other side
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[w := self.tree[0]] is not None:
            yield self.rows[w]
            self._next(w)
            self._replay(w)


class Spool:
    """Sorted runs on the disk of one task, written and read batch by batch."""

    def __init__(self, file, schema: pa.Schema):
        self.file, self.schema, self.size = file, schema, 0
        self.runs: list[list[tuple[int, int]]] = []

    def append(self, run: list[tuple[int, int]], batch: pa.RecordBatch) -> None:
        data = memoryview(batch.serialize())
        self.file.seek(self.size)
        self.file.write(data)
        run.append((self.size, len(data)))
        self.size += len(data)

    def read(self, run: list[tuple[int, int]]) -> Iterator[tuple]:
        for at, n in run:
            self.file.seek(at)
            batch = pa.ipc.read_record_batch(pa.py_buffer(self.file.read(n)), self.schema)
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def add_sorted(self, rows: Iterator[tuple]) -> list[tuple[int, int]]:
        run: list[tuple[int, int]] = []
        while part := list(itertools.islice(rows, BATCH)):
            self.append(run, _batch(part, self.schema))
        return run

    def merged(self) -> Iterator[tuple]:
        """All rows in order; as many passes as leave at most FAN runs for the last."""
        while len(self.runs) > FAN:
            self.runs = [self.add_sorted(iter(LoserTree([self.read(r) for r in self.runs[i : i + FAN]]))) for i in range(0, len(self.runs), FAN)]
        yield from LoserTree([self.read(r) for r in self.runs])


def merge_index(index: DataFrame) -> DataFrame:
    """The entries in global order, with ``position``; a task merges one range of keys."""
    lead = ["url_key", "captured_at", "page_id"]
    order = [*lead, *[c for c in index.columns if c not in lead]]
    kinds = dict(x.split() for x in RUNS.split(", "))
    came, gone = ", ".join(f"{c} {kinds[c]}" for c in order), ", ".join(f"{c} {kinds[c]}" for c in order if c != "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, schema, at = TaskContext.get().partitionId() << 40, arrow_schema(gone + ", position long"), order.index("run")
        with tempfile.TemporaryFile() as f:
            spool, open_runs = Spool(f, arrow_schema(came)), {}
            for b in batches:
                numbers = b.column(at).to_numpy()
                edges = np.r_[0, np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, len(numbers)]
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    for k in range(x, y, BATCH):
                        part = b.slice(k, min(BATCH, y - k))
                        first, last = (_order(tuple(c[i].as_py() for c in part.columns[:3])) for i in (0, part.num_rows - 1))
                        known = open_runs.get(int(numbers[x]))
                        if known is None or known[1] > first:  # the shuffle moved blocks of a run: one more run
                            known = open_runs[int(numbers[x])] = [[], last]
                            spool.runs.append(known[0])
                        spool.append(known[0], part)
                        known[1] = last
            rows = ((*r[:at], *r[at + 1 :], base + i) for i, r in enumerate(spool.merged()))
            while part := list(itertools.islice(rows, 5000)):
                yield _batch(part, schema)

    return index.select(*order).repartitionByRange(*lead).mapInArrow(frugal(run), gone + ", position long")


def capture_history(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back and return their merged index."""
    spark = prepare(pages.sparkSession)
    return merge_index(materialize(read_archives(spark, write_archives(pages, min_bytes)), "runs"))
