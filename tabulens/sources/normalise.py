"""From a file to an immutable dataset: one Parquet table with row numbers, a content hash, and an inferred contract."""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.operators.stats import infer_schema
from tabulens.sources.readers import READERS
from tabulens.sources.sniff import MOST_ROWS, PREFIX, Dialect, IngestError, check_size, detect, read_rows, sniff_format
from tabulens.types import ROW_ID, Relation, SchemaContract, TabulensError, col

#: Rows of a page and of a preview at most.
MOST_PAGE, PREVIEW = 1000, 50
_URI = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s]*$|^/[^\s]*$")


def checked_uri(uri: str) -> str:
    if not _URI.match(uri) or ".." in uri.split("/"):
        raise TabulensError(f"{uri!r} is no storage address")
    return uri.rstrip("/")


@dataclass(frozen=True)
class Dataset:
    """Written once; a correction is another contract and a changed file another dataset."""

    id: str
    owner: str
    name: str
    path: str
    content_hash: str
    row_count: int
    column_count: int
    contract: SchemaContract

    def relation(self, spark: SparkSession) -> Relation:
        """The dataset as a relation, read by its contract."""
        df = spark.read.parquet(self.path)
        specs = tuple(replace(c, physical=df.schema[c.name].dataType.simpleString()) for c in self.contract.columns)
        return Relation(df, specs, (ROW_ID,))


#: Bytes at the end of a file that are looked at: a ZIP's directory, a Parquet footer's mark.
TAIL = 1 << 16


def ends_of(spark: SparkSession, path: str) -> tuple[bytes, bytes, int]:
    """(first bytes, last bytes, length) of a file in any store that Spark reads; a folder counts as Parquet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(at)
    if status.isDirectory():
        return b"PAR1", b"PAR1", 1
    size = status.getLen()
    stream = fs.open(at)
    try:
        head = bytes(stream.readNBytes(min(size, PREFIX)))
        stream.seek(max(0, size - TAIL))
        return head, bytes(stream.readNBytes(min(size, TAIL))), size
    finally:
        stream.close()


def content_hash(df: DataFrame) -> str:
    """A hash of the rows in any order, with their number, and of the schema."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[col(c) for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{df.schema.simpleString()}\x1f{row['n']}\x1f{row['h']}".encode()).hexdigest()


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with dense row numbers in the order of its files: a row's place in its split, after the rows of all splits before.

    Nothing is moved. The splits are counted first; they are the same when the rows are read again.
    """
    part, low = F.shiftright("_at", 33), F.lit((1 << 33) - 1)
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, seen = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(F.lit(seen).cast("long"))
        seen += counts.get(p, 0)
    if not before:
        return df.withColumn(ROW_ID, F.lit(0).cast("long"))
    return placed.withColumn(ROW_ID, F.get(F.array(*before), part.cast("int")) + F.col("_at").bitwiseAND(low)).drop("_at")


def inspect(spark: SparkSession, path: str) -> tuple[str, Dialect]:
    head, tail, size = ends_of(spark, path)
    check_size(size)
    kind = sniff_format(head, path, tail)
    return kind, detect(head, size <= PREFIX) if kind in ("csv", "tsv") else Dialect()


def ingest(spark: SparkSession, path: str, store: str, owner: str = "", name: str | None = None, dialect: Dialect | None = None) -> Dataset:
    """Read, check, write and infer; nothing is left behind where any of that fails."""
    kind, found = inspect(spark, path)
    source = READERS[kind](spark, path, dialect or found)
    if ROW_ID in source.columns:
        raise IngestError(f"a column may not be named {ROW_ID}")
    made = uuid.uuid4().hex
    target = f"{checked_uri(store)}/datasets/{made}"
    try:
        numbered(source).sortWithinPartitions(ROW_ID).write.option("compression", "zstd").parquet(target)
        df = spark.read.parquet(target)
        rows = df.count()
        if not rows:
            raise IngestError("the table has no rows")
        if kind != "parquet" and rows > MOST_ROWS:
            raise IngestError(f"the table has more than {MOST_ROWS} rows")
        contract = infer_schema(Relation.of(df))
        return Dataset(made, owner, name or path.rsplit("/", 1)[-1], target, content_hash(df.drop(ROW_ID)), rows, len(df.columns) - 1, contract)
    except Exception:
        delete_path(spark, target)
        raise


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Catalog:
    """The datasets of an application: added once, found by id, and deleted with their bytes."""

    def __init__(self, spark: SparkSession):
        self.spark, self._rows = spark, {}

    def add(self, d: Dataset) -> Dataset:
        if d.id in self._rows:
            raise TabulensError(f"there is a dataset {d.id} already")
        self._rows[d.id] = d
        return d

    def of(self, owner: str) -> list[Dataset]:
        return [d for d in self._rows.values() if d.owner == owner]

    def get(self, id: str, owner: str) -> Dataset:
        d = self._rows.get(id)
        if d is None or d.owner != owner:
            raise TabulensError(f"there is no dataset {id!r}")
        return d

    def delete(self, id: str, owner: str) -> None:
        """The bytes go first: a row without bytes can be deleted again, bytes without a row could not be found."""
        delete_path(self.spark, self.get(id, owner).path)
        del self._rows[id]


def page(dataset: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows in file order by their numbers, which Parquet's statistics find without reading the others."""
    if offset < 0 or not 1 <= limit <= MOST_PAGE:
        raise TabulensError(f"a page has 1 to {MOST_PAGE} rows from offset 0 on")
    return dataset.filter(col(ROW_ID).between(offset, offset + limit - 1)).orderBy(ROW_ID).drop(ROW_ID)


def preview(spark: SparkSession, path: str, dialect: Dialect | None = None) -> tuple[list[str], list[list[str | None]], list[str]]:
    """(columns, at most PREVIEW rows, warnings) from the first bytes of a delimited file; nothing is kept."""
    head, _, size = ends_of(spark, path)
    d = dialect or detect(head, size <= PREFIX)
    rows = read_rows(head.decode(d.encoding, "replace"), d.delimiter, PREVIEW + 1)
    width = len(rows[0]) if rows else 0
    names = rows[0] if rows and d.header else [f"column_{i + 1}" for i in range(width)]
    body = rows[1:] if d.header else rows[:PREVIEW]
    long = sum(len(r) > width for r in body)
    return names, [[*r[:width], *[None] * (width - len(r))] for r in body], [f"{long} rows have more cells than there are columns"] if long else []
