"""WARC archives in a binary column, revisit records for equal payloads, and capture histories by an external merge.

Archives are rows of a table, so any store that Spark reaches can hold them. Each record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import BATCH_BYTES, Rows, as_bytes, bounded, partitions, releasing, text_or_empty, written

#: Bytes of an archive, after which the next one begins.
ARCHIVE_BYTES = 4 << 20
#: Shared payloads whose digests go to every task.
FEW_SHARED = 1 << 18
#: Rows of a sorted run, and runs of a task that stay in memory; more are kept in a scratch file of the task.
RUN_ROWS, RUNS_IN_MEMORY = 20_000, 8
#: Fixed values of the format.
VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Captures without a date of their own are dated from here on, a second for each page id.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)

_ESCAPED = re.compile(r"[\x00-\x20\x7f]")
_NO_ID = "<urn:uuid:ffffffff-ffff-ffff-ffff-ffffffffffff>"


class WarcError(ValueError):
    """The bytes are not a whole, undamaged archive."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    if page_id is None:
        return _NO_ID
    h = f"{page_id & (1 << 64) - 1:016x}"
    return f"<urn:uuid:00000000-0000-4000-{h[:4]}-{h[4:]}>"


def page_of(identifier: str) -> int | None:
    if identifier == _NO_ID:
        return None
    n = int(identifier[-18:-1].replace("-", ""), 16)
    return n - (1 << 64) if n >> 63 else n


def capture_time(page_id: int | None) -> str:
    seconds = (page_id or 0) % (1 << 31)
    return (EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head alone; its length field is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", capture_time(page_id)),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def records(archive: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) for each record; raises WarcError for damage."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        unpack, parts, to = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof and to < len(archive):
                parts.append(unpack.decompress(view[to : to + (1 << 14)]))
                to = min(len(archive), to + (1 << 14))
        except zlib.error as e:
            raise WarcError(f"no record begins at byte {at}") from e
        if not unpack.eof:
            raise WarcError("a record is cut off")
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        try:
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            size = int(fields["Content-Length"])
        except (UnicodeDecodeError, ValueError, KeyError) as e:
            raise WarcError(f"the head of the record at byte {at} is damaged") from e
        if lines[0] != VERSION or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise WarcError(f"the record at byte {at} is damaged")
        block = rest[:size]
        if fields.get("WARC-Block-Digest") != f"sha1:{digest(block)}":
            raise WarcError(f"the block at byte {at} doesn't match its digest")
        yield at, fields, block
        at = to - len(unpack.unused_data)


def url_key(url: str) -> str:
    """A key that puts a host's pages together: labels of the host reversed, then path and query."""
    try:
        parts = urlsplit(url.lower())
        host, port = parts.hostname or "", f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def write_archives(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """(archive, content): a WARC record for every row of pages (page_id, url, html), in archives of bounded size.

    Of the rows with equal payloads of at least ``smallest`` bytes, those with the largest page_id are responses and the
    others revisit it; rows without an id never are that one unless all are. A null html is an empty payload, a null
    url an empty target. Payloads that many pages share are found by partial maxima; more than FEW_SHARED of them are
    joined by a shuffle, which is dealt anew where one payload is hot. Repeated rows have a record each; other columns of
    ``pages`` play no part, whatever their names; an empty table gives no archives.
    """
    bounded(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html_")).withColumn("_sha", F.sha1("html_"))
    kept = rows.groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    kept = written(kept.filter("_n > 1 and _last is not null").select("_sha", "_last"), "shared")
    # payloads that several pages share, by digest and page: few of them go to every task and no page moves
    joined = rows.join(F.broadcast(kept) if kept.count() <= FEW_SHARED else kept, "_sha", "left").withColumn("_last", F.when(F.octet_length("html_") >= smallest, F.col("_last")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, size
            out = pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{number:06d}.warc.gz"], "content": pa.array([b"".join(held)], pa.binary())})
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            ids, urls, last = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for page, url, payload, to in zip(ids, urls, as_bytes(batch.column(2)), last, strict=True):
                held.append(record(page, url, payload, to, to is not None and to != page))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if held:
            yield close()

    return written(joined.select("page_id", "url", "html_", "_last").mapInArrow(releasing(run), "archive string, content binary"), "warc")


CAPTURE = "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long"
_CAPTURE = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("place", pa.int64())])


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record of the archives, read back and checked: a response's payload against its digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_CAPTURE)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at, fields, block in records(content):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and (len(payload) != size or digest(payload) != told):
                        raise WarcError(f"the payload at byte {at} of {name} doesn't match its digest")
                    url, to = fields["WARC-Target-URI"], fields.get("WARC-Refers-To")
                    row = url_key(url), fields["WARC-Date"], page_of(fields["WARC-Record-ID"]), url, size, told, kind, page_of(to) if to else None, name, at
                    yield from out.add(row, 300)
        yield from out.flush()

    return archives.select("archive", "content").mapInArrow(releasing(run), CAPTURE)


class LoserTree:
    """Merges k sorted iterators; each step replays one path, so it takes about log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i, True)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; ended runs come last, ties by the run's number."""
        if a < 0 or b < 0:  # while the tree is built, an empty place beats all
            return a < b
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _replay(self, winner: int, build: bool = False) -> None:
        at = (winner + self.k) >> 1
        while at:
            if build and self.tree[at] < 0:
                self.tree[at] = winner
                return
            if self._before(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at >>= 1
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def _sort_key(row: tuple) -> tuple:
    return row[0] or "", row[1] or "", row[2] is None, row[2] or 0, row[8] or "", row[9] or 0


def merge_runs(rows: Iterable[tuple], run_rows: int = RUN_ROWS, in_memory: int = RUNS_IN_MEMORY) -> Iterator[tuple]:
    """``rows`` in order of URL key, time, page: sorted runs of ``run_rows``, merged by a loser tree.

    More runs than ``in_memory`` lie in a scratch file, from which each is read a few rows at a time.
    """
    runs: list[Iterator[tuple]] = []
    held: list[tuple] = []
    with tempfile.TemporaryFile() as scratch:

        def stored(start: int, end: int) -> Iterator[tuple]:
            while start < end:
                scratch.seek(start)
                part = pickle.load(scratch)  # noqa: S301  the task's own file
                start = scratch.tell()
                yield from part

        def close() -> None:
            held.sort(key=lambda x: x[0])
            if len(runs) < in_memory:
                runs.append(iter(list(held)))
            else:
                start = scratch.seek(0, 2)
                for i in range(0, len(held), 500):
                    pickle.dump(held[i : i + 500], scratch)
                runs.append(stored(start, scratch.tell()))
            held.clear()

        for row in rows:
            held.append((_sort_key(row), len(runs), len(held), row))
            if len(held) >= run_rows:
                close()
        if held or not runs:
            close()
        for x in LoserTree(runs):
            yield x[3]


def histories(captures: DataFrame) -> DataFrame:
    """``captures`` globally ordered by URL key and time: partition by partition, and within each by merged runs.

    Ranges are cut by key, time and page together, so the captures of one hot host or URL fall into many partitions.
    """
    keys = ["url_key", "captured", "page_id", "archive", "place"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_CAPTURE, BATCH_BYTES)
        for row in merge_runs(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            yield from out.add(row, 300)
        yield from out.flush()

    return captures.repartitionByRange(partitions(captures), *keys).mapInArrow(run, CAPTURE)


def page_records(pages: DataFrame) -> DataFrame:
    """Every page written to archives, read back, and put into its URL's history."""
    captures = histories(read_archives(write_archives(pages)))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "place")
