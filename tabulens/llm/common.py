"""Helpers that the corpus operators share: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of payload that an operator puts into one Arrow batch or one block of documents.
BATCH_BYTES = 4 << 20

#: Session settings that bound what a task holds at once, with what Spark has by itself and what stands here:
#: bytes of an Arrow batch beside the count of its rows, and of a row group while a Parquet file is written.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(2 * BATCH_BYTES)), "parquet.block.size": (None, str(16 << 20))}

_made: dict[str, str] = {}
_count = itertools.count()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table below ``sf_dir``, which may be a path of any file system Spark reads."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded(spark: SparkSession) -> None:
    """Sets BOUNDS where they have the value that Spark comes with, so that an application's own choice stays."""
    for key, (default, value) in BOUNDS.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, value)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = next(n for n in itertools.chain([f"_{name}"], (f"_{name}_{i}" for i in itertools.count())) if n.lower() not in taken)
        taken.add(own.lower())
        out.append(own)
    return out


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, removed when the driver ends.

    Only in a local session without that setting (tests) a temporary local folder stands in; on a cluster, whose
    executors would not see it, its absence is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _made:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = f"file://{tempfile.mkdtemp(prefix='tabulens-')}"
        _made[app] = f"{top.rstrip('/')}/tabulens-{uuid.uuid4().hex[:12]}"
        atexit.register(_drop, spark, _made[app])
    return _made[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once into the shared folder and read back.

    Cuts the lineage like a reliable checkpoint, yet compressed and by column; executors that are
    lost afterwards lose nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{next(_count)}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def releasing(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which a worker gives freed memory back: workers stay alive between tasks."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class Rows:
    """Collects output rows and cuts them into Arrow batches of about ``limit`` bytes."""

    def __init__(self, schema: pa.Schema, limit: int = BATCH_BYTES):
        self.schema, self.limit, self.size, self.rows = schema, limit, 0, []

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 64
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def blocks(batches: Iterable[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``limit`` bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def merged_blocks(batches: Iterable[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """``blocks``, but of several batches where one holds less than ``limit`` bytes of text."""
    held, size = [], 0
    for part in blocks(batches, limit, text):
        own = pa.compute.sum(pa.compute.binary_length(part.column(text))).as_py() or 0
        if held and size + own > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield pa.concat_batches(held)


def owner_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that Spark's hash partitioning deals to it, so that owners meet in none of them."""
    if n not in _owner_keys:
        place = F.pmod(F.hash("id"), F.lit(n))
        rows, size = [], 8 * n
        while len(rows) < n:  # numbers scatter, so a few times n are enough
            size *= 2
            rows = spark.range(size, numPartitions=1).groupBy(place.alias("p")).agg(F.min("id").alias("id")).orderBy("p").collect()
        _owner_keys[n] = [r["id"] for r in rows]
    return _owner_keys[n]


_owner_keys: dict[int, list[int]] = {}
