"""What a file is, from its first bytes: format, encoding, delimiter, header. Works on bounded prefixes."""

from __future__ import annotations

import codecs
import csv
import io
import re
import zipfile
from collections import Counter
from dataclasses import dataclass

from tabulens.types import TabulensError

#: Bytes that are looked at, rows that a dialect is judged by, delimiters in order of preference.
PREFIX, ROWS, DELIMITERS = 1 << 20, 40, (",", ";", "\t", "|")
#: Limits of an upload.
MOST_BYTES, MOST_ROWS, ZIP_RATIO = 500 << 20, 5_000_000, 100
NUMERIC_SHARE = 0.8
BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


class IngestError(TabulensError):
    """A file that is refused, and why."""


def sniff_format(head: bytes, name: str = "", tail: bytes = b"") -> str:
    """parquet, xlsx, json, tsv or csv."""
    if head.startswith(b"PAR1"):
        if tail and not tail.endswith(b"PAR1"):
            raise IngestError("the Parquet file is cut off")
        return "parquet"
    if head.startswith(b"PK\x03\x04"):
        # the names of all members stand in the directory at the end
        if b"xl/workbook.xml" in (tail or head):
            return "xlsx"
        raise IngestError("a ZIP archive that is no workbook can't be read")
    text = head.lstrip(codecs.BOM_UTF8 + b" \t\r\n")
    if re.match(rb"\[\s*(?:\{|\]\s*\Z)", text):
        return "json"
    return "tsv" if name.lower().endswith((".tsv", ".tab")) else "csv"


def encoding_of(head: bytes, whole: bool = False) -> str:
    """The encoding of a prefix: its mark, strict UTF-8 (a sign cut at the end aside), Windows-1252, Latin-1."""
    for mark, name in BOMS:
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, whole)
        return "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        head.decode("cp1252")
        return "cp1252"
    except UnicodeDecodeError:
        return "latin-1"


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    header: bool = True
    encoding: str = "utf-8"
    confidence: float = 1.0


def read_rows(text: str, delimiter: str, most: int = ROWS) -> list[list[str]]:
    out = []
    try:
        for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
            if row:
                out.append(row)
            if len(out) >= most:
                break
    except csv.Error:  # what was read before the damage is judged
        pass
    return out


def delimiter_of(text: str) -> tuple[str, float]:
    """(delimiter, share of rows of the usual width); the most regular one wins, then the widest."""
    best = (0.0, 0, ",")
    for d in DELIMITERS:
        widths = Counter(map(len, read_rows(text, d)))
        if widths:
            width, n = max(widths.items(), key=lambda x: (x[1], x[0]))
            if width > 1 and (share := n / widths.total(), width) > best[:2]:
                best = share, width, d
    return (best[2], best[0]) if best[1] else (",", 1.0)


_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)\Z")


def has_header(rows: list[list[str]]) -> bool:
    """No header where a name is blank or doubled, or where numeric columns begin with a number."""
    if not rows:
        return True
    first, body = rows[0], rows[1:]
    names = [x.strip() for x in first]
    if not all(names) or len(set(names)) < len(names):
        return False
    votes = []
    for i, name in enumerate(names):
        below = [r[i].strip() for r in body if len(r) > i and r[i].strip()]
        if below and sum(bool(_NUMBER.match(x)) for x in below) > NUMERIC_SHARE * len(below):
            votes.append(not _NUMBER.match(name))
    return sum(votes) * 2 >= len(votes) if votes else True


def detect(head: bytes, whole: bool = False) -> Dialect:
    encoding = encoding_of(head, whole)
    text = head.decode(encoding, "ignore")
    delimiter, share = delimiter_of(text)
    return Dialect(delimiter, has_header(read_rows(text, delimiter)), encoding, share)


def check_size(size: int, name: str = "the file") -> None:
    if size > MOST_BYTES:
        raise IngestError(f"{name} is larger than {MOST_BYTES >> 20} MB")
    if not size:
        raise IngestError(f"{name} is empty")


def check_zip(data: bytes) -> None:
    """Refuses an archive that would grow beyond ZIP_RATIO times its size."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if sum(i.file_size for i in z.infolist()) > ZIP_RATIO * max(1, len(data)):
                raise IngestError("the workbook unpacks to too much")
    except zipfile.BadZipFile as e:
        raise IngestError("the workbook is damaged") from e


def check_names(names: list[str]) -> None:
    if twice := [n for n, k in Counter(names).items() if k > 1]:
        raise IngestError(f"the column {twice[0]!r} occurs more than once")


def check_delimiter(names: list[str], rows: list[list[str | None]], delimiter: str) -> None:
    """Refuses a table of one column whose cells hold another delimiter."""
    if len(names) != 1:
        return
    cells = [names[0], *(r[0] or "" for r in rows[:20])]
    for d in DELIMITERS:
        if d != delimiter and sum(c.count(d) for c in cells) >= len(cells):
            raise IngestError(f"the delimiter looks like {d!r}, not {delimiter!r}")
