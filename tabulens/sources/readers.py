"""Readers: each gives a DataFrame of strings, but Parquet keeps its types."""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.sources.sniff import MOST_ROWS, Dialect, IngestError, check_delimiter, check_names, check_size, check_zip
from tabulens.types import col

_BAD = "__record"


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def fields_of(record: Column, delimiter: str) -> Column:
    """How many fields a raw record has: delimiters outside of quotes, and one."""
    plain = F.regexp_replace(record, r'"(?:[^"]|"")*"', "")
    return F.length(plain) - F.length(F.replace(plain, F.lit(delimiter), F.lit(""))) + 1


#: The signs that Latin-1 and Windows-1252 read differently: the latter is read as the former and mended, as Spark reads few encodings.
_LATIN = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def _windows(text: str) -> str:
    return "".join(c.encode("latin-1").decode("cp1252") if c in _LATIN else c for c in text)


def spans_lines(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a quoted cell holds a line feed: then some line has an odd number of quotes. One pass over the lines."""
    if encoding.lower().startswith(("utf-16", "utf-32")):
        return True
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, d: Dialect) -> DataFrame:
    """All columns as text; short rows are filled with null, a long row is refused.

    A file is read in splits, unless a cell runs over several lines; then it is one task.
    """
    base = {"sep": d.delimiter, "quote": '"', "escape": '"', "encoding": {"utf-8-sig": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}.get(d.encoding, d.encoding), "multiLine": spans_lines(spark, path, d.encoding), "inferSchema": False, "nullValue": "\x00", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    first = spark.read.options(**base, header=False).csv(path)
    row = first.limit(1).collect()
    if not row:
        raise IngestError("the table is empty")
    names = [_windows(x or "").removeprefix("\ufeff") if d.encoding == "cp1252" else (x or "").removeprefix("\ufeff") for x in row[0]] if d.header else [f"column_{i + 1}" for i in range(len(first.columns))]
    check_names(names)
    schema = T.StructType([*strings(names).fields, T.StructField(_BAD, T.StringType())])
    df = spark.read.options(**base, header=d.header, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD, enforceSchema=True).schema(schema).csv(path)
    checked = F.when(col(_BAD).isNotNull() & (fields_of(col(_BAD), d.delimiter) > len(names)), F.raise_error(F.concat(F.lit("a row has more cells than there are columns: "), F.substring(col(_BAD), 1, 80))))
    # the check rides on the first column, so that it can't be pruned away while rows are written
    df = df.withColumn(names[0], F.coalesce(checked.cast("string"), col(names[0]))).select(*[col(n) for n in names])
    if d.encoding == "cp1252":
        df = df.select(*[F.translate(col(n), _LATIN, _windows(_LATIN)).alias(n) for n in names])
    check_delimiter(names, [list(r) for r in df.limit(20).collect()], d.delimiter)
    return df


def as_text(x: object) -> str | None:
    """A cell as text: booleans in small letters, whole floats without a point, midnight as a date."""
    if x is None:
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, dt.datetime):
        return x.date().isoformat() if x.time() == dt.time() else x.isoformat(sep=" ")
    if isinstance(x, float) and x.is_integer():
        return str(int(x))
    return str(x)


def read_json(spark: SparkSession, path: str, d: Dialect) -> DataFrame:
    """An array of flat objects; columns in the order in which they first occur; nested values are refused."""
    files = spark.read.format("binaryFile").load(path)
    check_size(files.agg(F.sum("length")).first()[0] or 0, path)
    data = b"".join(r["content"] for r in files.orderBy("path").select("content").collect())
    try:
        rows = json.loads(data.decode("utf-8-sig"))
    except ValueError as e:
        raise IngestError(f"the JSON can't be read: {e}") from e
    if not isinstance(rows, list) or not rows or not all(isinstance(r, dict) for r in rows):
        raise IngestError("an array of objects is expected")
    names = list(dict.fromkeys(k for r in rows for k in r))
    for r in rows:
        if bad := next((k for k, v in r.items() if isinstance(v, (dict, list))), None):
            raise IngestError(f"{bad!r} holds nested values")
    return spark.createDataFrame([tuple(as_text(r.get(n)) for n in names) for r in rows], strings(names))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_DATES = {*range(14, 23), *range(45, 48)}


def _cells(data: bytes) -> list[list[object]]:
    """The rows of a workbook's first sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [("".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t"))) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        dated: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iterfind(".//m:numFmt", _NS) if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
            dated = {i for i, x in enumerate(styles.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in _DATES | own}
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not sheets:
            raise IngestError("the workbook has no sheet")
        out = []
        for row in ElementTree.fromstring(z.read(sheets[0])).iterfind(".//m:row", _NS):
            line: list[object] = []
            for c in row.iterfind("m:c", _NS):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = -1
                for x in letters:
                    at = (at + 1) * 26 + ord(x) - 65
                at = at if letters else len(line)
                line += [None] * (at - len(line))
                kind, v = c.get("t", "n"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    line.append("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")))
                elif v is None or v.text is None:
                    line.append(None)
                elif kind == "s":
                    line.append(shared[int(v.text)])
                elif kind == "b":
                    line.append(v.text == "1")
                elif kind in ("str", "e", "d"):
                    line.append(v.text)
                elif int(c.get("s", -1)) in dated:
                    line.append(dt.datetime(1899, 12, 30) + dt.timedelta(days=float(v.text)))
                else:
                    line.append(float(v.text))
            out.append(line)
        return out


def read_xlsx(spark: SparkSession, path: str, d: Dialect) -> DataFrame:
    """The first sheet; its first row names the columns, blank rows are skipped. A workbook is read on the driver."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    check_zip(data)
    rows = [r for r in _cells(data) if any(x not in (None, "") for x in r)]
    if not rows:
        raise IngestError("the sheet is empty")
    if len(rows) > MOST_ROWS:
        raise IngestError(f"the sheet has more than {MOST_ROWS} rows")
    width = max(map(len, rows))
    head = [*rows[0], *[None] * (width - len(rows[0]))]
    names = [as_text(x).strip() if x not in (None, "") else f"column_{i + 1}" for i, x in enumerate(head)]
    check_names(names)
    return spark.createDataFrame([tuple(as_text(x) for x in [*r, *[None] * (width - len(r))]) for r in rows[1:]], strings(names))


def read_parquet(spark: SparkSession, path: str, d: Dialect) -> DataFrame:
    return spark.read.parquet(path)


READERS: dict[str, Callable[[SparkSession, str, Dialect], DataFrame]] = {"csv": read_csv, "tsv": read_csv, "json": read_json, "xlsx": read_xlsx, "parquet": read_parquet}
