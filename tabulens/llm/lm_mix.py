"""Language-model scoring by logistic mixing of hashed-context bit predictors.

Bytes are coded by one Huffman tree for each preceding byte, so a byte is a few binary decisions. Several contexts, each
hashed together with the tree's node into a table of counts, predict a decision; a weight set that a gate selects
combines them in the logistic domain, and each text refines the weights after every FEW decisions, as it is read. Counts,
trees and first weights come from all training texts.

Reading decision after decision is no work for NumPy: ContextMixer.java does it, compiled by the compiler that Spark
itself generates code with, and sent to the executors as a jar. Rows of it are blocks of whole texts.
"""

from __future__ import annotations

import heapq
import io
import itertools
import math
import struct
import uuid
import zipfile
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from importlib import resources

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from tabulens.llm.common import Rows, as_bytes, bounded, merged_blocks, owner_keys, partitions, release, releasing, shared_dir, text_or_empty, written
from tabulens.llm.packing import pack_bytes, pack_numbers, unpack_bytes, unpack_numbers

#: The symbols: bytes, then the end of a text, which also stands before its first byte.
END, SYMBOLS = 256, 257
#: Tables, for the last 3, 4 and 6 bytes and for the word so far; inputs of the mixer: these, the tree node itself, a constant.
TABLES, INPUTS = 4, 6
#: Gates: three levels of evidence, of no, up to three and more counts, for each of the last two tables.
GATES = 9
#: Slots of each table at most and at least, as powers of two; and slots of the parts in which tables are added up.
BITS, LEAST_BITS, PART = 22, 16, 1 << 16
#: Decisions after which a text's weights are refined, and bytes after which the count of these begins anew.
FEW, PIECE = 8, 1 << 16
#: The step of that while a text is scored, and the greatest logarithm of odds.
ONLINE, LIMIT = 0.01, 9.0
#: Numbers of a gate that first weights are fitted from, steps in one at which those of a text are rounded (both as in
#: ContextMixer), and what holds weights of which few decisions tell to where they start.
SUMS, ROUNDED, HOLD = INPUTS * (INPUTS + 1) // 2 + INPUTS, 1 << 16, 10.0
#: Bytes of text in a block that is scored, and in one that is counted.
BLOCK_BYTES, COUNT_BYTES = 8 << 20, 32 << 20
#: Tasks whose counts one task adds up on the first of two levels, once there are more than that.
FAN_IN = 256


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass
class Codes:
    """The trees, flat: for a pair of symbols the nodes on the way to the second and the branch at each."""

    length: np.ndarray
    start: np.ndarray
    node: np.ndarray
    branch: np.ndarray
    prior: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray) -> Codes:
        """From counts of pairs of symbols; every pair gets a code, as if seen a little."""
        length, start, nodes, branches = np.zeros(SYMBOLS * SYMBOLS, np.int64), np.zeros(SYMBOLS * SYMBOLS, np.int64), [], []
        prior = np.zeros((SYMBOLS * (SYMBOLS - 1), 2))
        for first in range(SYMBOLS):
            weights = pairs[first] + 0.01
            heap = [(w, i) for i, w in enumerate(weights.tolist())]
            heapq.heapify(heap)
            parent: dict[int, tuple[int, int]] = {}
            made = SYMBOLS
            while len(heap) > 1:
                (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
                at = first * (SYMBOLS - 1) + made - SYMBOLS
                parent[a], parent[b] = (made, 0), (made, 1)
                prior[at] = x, y
                heapq.heappush(heap, (x + y, made))
                made += 1
            for second in range(SYMBOLS):
                way, at = [], second
                while at in parent:
                    at, side = parent[at]
                    way.append((first * (SYMBOLS - 1) + at - SYMBOLS, side))
                key = first * SYMBOLS + second
                length[key], start[key] = len(way), len(nodes)
                nodes += [n for n, _ in reversed(way)]
                branches += [b for _, b in reversed(way)]
        odds = np.log((prior[:, 1] + 0.4) / (prior[:, 0] + 0.4)).clip(-LIMIT, LIMIT)
        return cls(length, start, np.array(nodes, np.uint32), np.array(branches, np.uint8), odds.astype(np.float32))


def odds_table() -> np.ndarray:
    """Logarithm of odds for a slot's two counts of up to 255, which are the bytes of its number."""
    n = np.arange(256.0)
    return np.log((n[None, :] + 0.4) / (n[:, None] + 0.4)).clip(-LIMIT, LIMIT).astype(np.float32).ravel()


@dataclass
class Model:
    codes: Codes
    bits: int
    tables: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, INPUTS), 0.25, np.float32))

    def packed(self) -> bytes:
        """Trees and tables as ContextMixer reads them."""
        c = self.codes
        identity = uuid.uuid4().int & (1 << 63) - 1
        head = struct.pack("<qiiifii", identity, self.bits, FEW, PIECE, ONLINE, len(c.node), bool(self.tables))
        parts = [head, c.length.astype(np.uint8), c.branch, c.start.astype("<i4"), c.node.astype("<i4"), c.prior.astype("<f4"), odds_table().astype("<f4"), *(t.astype("<u2") for t in self.tables)]
        return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)


_functions: set[str] = set()


def functions(spark: SparkSession) -> None:
    """Compiles ContextMixer and registers its functions in the session; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _functions:
        jvm = spark.sparkContext._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(resources.files("tabulens.llm").joinpath("ContextMixer.java").read_text())
        classes = compiler.getBytecodes()
        jar = io.BytesIO()
        with zipfile.ZipFile(jar, "w") as z:
            for name in classes.keySet():
                z.writestr(name.replace(".", "/") + ".class", bytes(classes.get(name)))
        at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/context-mixer-{uuid.uuid4().hex}.jar")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        try:
            out.write(bytearray(jar.getvalue()))
        finally:
            out.close()
        spark.sql(f"ADD JAR '{at.toString()}'").collect()
        _functions.add(app)
    loader = spark._jsparkSession.sharedState().jarClassLoader()
    for name, kind in (("counts", ArrayType(BinaryType())), ("scores", BinaryType()), ("fits", ArrayType(LongType())), ("words", ArrayType(BinaryType())), ("learned", BinaryType())):
        made = spark.sparkContext._jvm.java.lang.Class.forName(f"tabulens.ContextMixer${name.capitalize()}", True, loader).newInstance()
        spark._jsparkSession.udf().register(f"context_mixer_{name}", made, spark._jsparkSession.parseDataType(kind.json()))


def model_table(spark: SparkSession, model: Model) -> DataFrame:
    """A written table of one row, whose size BITS fixes."""
    return written(spark.createDataFrame([(1, bytearray(model.packed()))], "one int, model binary"), "model")


def with_model(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """``blocks`` with the model's bytes in each row."""
    return blocks.withColumn("one", F.lit(1)).join(F.broadcast(table), "one").drop("one")


def packed_weights(weights: np.ndarray) -> Column:
    return F.lit(bytearray(np.ascontiguousarray(weights, "<f4").tobytes()))


def text_blocks(texts: DataFrame, limit: int) -> DataFrame:
    """(text, lengths): the bytes of whole texts of column text_ one after another, and the lengths of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in merged_blocks(batches, limit, "text_"):
            data = as_bytes(rows.column(0))
            yield pa.RecordBatch.from_pydict({"text": pa.array([b"".join(data)], pa.binary()), "lengths": pa.array([lengths_of(data)], pa.binary())})

    return texts.select("text_").mapInArrow(releasing(run), "text binary, lengths binary")


def lengths_of(data: list[bytes]) -> bytes:
    return np.fromiter(map(len, data), "<i4", len(data)).tobytes()


def pair_counts(train: DataFrame) -> np.ndarray:
    """How often each symbol follows each other one; at most SYMBOLS squared rows reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for rows in merged_blocks(batches, 1 << 20, "text_"):
            data = as_bytes(rows.column(0))
            s = np.full(sum(map(len, data)) + len(data) + 1, END, np.int32)
            at = 1
            for t in data:
                s[at : at + len(t)] = np.frombuffer(t, np.uint8)
                at += len(t) + 1
            total += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=SYMBOLS * SYMBOLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    out = np.zeros(SYMBOLS * SYMBOLS)
    for r in train.select("text_").mapInArrow(releasing(run), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS)


def count_tables(train: DataFrame, model: Model) -> list[np.ndarray]:
    """The tables as 16-bit cells of two counts, scaled to 255 at most; their size is fixed by the model's bits.

    Each block of texts is counted by itself, then parts of slots are added up, on two levels if there are many tasks, and
    made into cells where they are added up.
    """
    slots, parts_ = 1 << model.bits, max(1, (1 << model.bits) // PART)
    width = slots // parts_

    def adder(last: bool):
        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for part, salt, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw, at = zstandard.ZstdDecompressor().decompress(data), (part, 0 if last else salt)
                    own = np.frombuffer(raw, f"<u{len(raw) // (2 * width)}")
                    if at in total:
                        total[at] += own
                    else:
                        total[at] = own.astype(np.int64)
            pack = zstandard.ZstdCompressor(level=1)
            for (part, salt), own in total.items():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "salt": pa.array([salt], pa.int32()), "counts": pa.array([pack.compress((cells(own) if last else own).tobytes())], pa.binary())})

        return releasing(add)

    kind, n = "part int, salt int, counts binary", partitions(train)
    counted = with_model(text_blocks(train, COUNT_BYTES), model_table(train.sparkSession, model)).select(F.call_function("context_mixer_counts", "model", "text", "lengths", F.lit(width)).alias("parts"))
    # outer, as a filter that Spark infers for the plain one would count every block again
    rows = counted.select(F.floor(F.spark_partition_id() / FAN_IN).cast("int").alias("salt"), F.posexplode_outer("parts").alias("part", "counts")).filter("counts is not null")
    rows = rows.select("part", "salt", "counts")
    if train.rdd.getNumPartitions() > FAN_IN:
        rows = rows.repartition(n, "part", "salt").mapInArrow(adder(False), kind)
    # as many rows as there are parts, written so that the driver takes them one partition after another
    rows = written(rows.repartition(n, "part").mapInArrow(adder(True), kind), "parts")
    tables = [np.zeros(slots, np.uint16) for _ in range(TABLES)]
    for r in rows.toLocalIterator():
        k, i = divmod(r["part"], parts_)
        tables[k][width * i : width * (i + 1)] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), "<u2")
    return tables


def cells(counts: np.ndarray) -> np.ndarray:
    pair = counts.reshape(-1, 2)
    over = np.flatnonzero(pair.max(axis=1) > 255)
    out = pair.astype(np.uint16)
    large = pair[over]
    out[over] = np.minimum(255, np.ceil(large / (large.max(axis=1) / 255.0)[:, None])).astype(np.uint16) if len(over) else out[over]
    return out[:, 0] << np.uint16(8) | out[:, 1]


def first_weights(train: DataFrame, table: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Weights fitted to all decisions of all training texts: for each gate, one Newton step of a logistic regression.

    A text's own occurrences are left out of the counts that predict it. Its sums are rounded and then added up as whole
    numbers, so scores don't depend on how the rows are dealt out. GATES times SUMS rows reach the driver.
    """
    sums = with_model(text_blocks(train, BLOCK_BYTES), table).select(F.call_function("context_mixer_fits", "model", packed_weights(weights), "text", "lengths").alias("sums"))
    # outer, as in count_tables
    rows = sums.select(F.posexplode_outer("sums").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(28,0)")).alias("n"))
    total = np.zeros(GATES * SUMS)
    for r in rows.collect():
        total[r["at"]] = int(r["n"]) / ROUNDED
    return fitted(total.reshape(GATES, SUMS), weights)


def fitted(sums: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The weights that solve each gate's equations: the upper triangle of a matrix, then the right side."""
    out = np.empty((GATES, INPUTS))
    for gate, own in enumerate(sums):
        upper = np.zeros((INPUTS, INPUTS))
        upper[np.triu_indices(INPUTS)] = own[:-INPUTS]
        out[gate] = np.linalg.solve(upper + np.triu(upper, 1).T + HOLD * np.eye(INPUTS), own[-INPUTS:] + HOLD * start[gate])
    return out.clip(-4, 4).astype(np.float32)


def train_model(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(the table of the model, first weights); docs: text_, held_out. What reaches the driver has a size that BITS fixes."""
    train = docs.filter(~F.col("held_out")).select("text_")
    pairs = pair_counts(train)
    model = Model(Codes.of(pairs), min(BITS, max(LEAST_BITS, int(math.log2(pairs.sum() + 1)) + 1)))
    model.tables = count_tables(train, model)
    table, weights = model_table(docs.sparkSession, model), model.weights
    del model
    return table, first_weights(train, table, weights)


def _stamp(distinct: Iterable[bytes]) -> int:
    return zlib.crc32(b"\x00".join(distinct))


def numbered_blocks(docs: DataFrame) -> DataFrame:
    """(block, keys, held, lengths, text): ``text_blocks`` with their numbers and, of each text, its id and whether it is held out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, rows in enumerate(merged_blocks(batches, BLOCK_BYTES, "text_")):
            data = as_bytes(rows.column(2))
            yield pa.RecordBatch.from_pydict({"block": pa.array([part << 32 | i]), "keys": pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())), "held": pa.array([rows.column(1).to_pylist()], pa.list_(pa.bool_())), "lengths": pa.array([lengths_of(data)], pa.binary()), "text": pa.array([b"".join(data)], pa.binary())})

    return docs.mapInArrow(releasing(run), "block long, keys array<long>, held array<boolean>, lengths binary, text binary")


def token_counts(docs: DataFrame, table: DataFrame, weights: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (block, stamp, keys, held, sizes, places, lengths, scores), a block's rows with the numbers of their
    tokens among its distinct ones and with the model's scores, which come from the same reading of the texts; and (block,
    stamp, places, counts, kinds, tokens), the training counts of a block's distinct tokens.

    A block sends its distinct tokens to the tasks that own them, which add up all blocks' counts and send them back. Each
    owner's rows with block -1 hold how many tokens and kinds of tokens it has seen in training texts.
    """
    n = partitions(docs)
    keys_of = owner_keys(docs.sparkSession, n)

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("stamp", pa.int64()), ("places", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("keys", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("lengths", pa.binary()), ("scores", pa.binary())]))
        for block, keys, held, texts, scores, found in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            places, sizes, blob, lengths = found
            places, sizes, ends = np.frombuffer(places, "<u4"), np.frombuffer(sizes, "<u4"), np.frombuffer(lengths, "<u4").cumsum(dtype=np.int64).tolist()
            distinct = [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            counts = np.bincount(places[~np.repeat(np.array(held, bool), sizes)], minlength=len(distinct))
            mark = _stamp(distinct)
            # the row of the block itself has no owner
            row = None, block, mark, pack_numbers(places), None, None, keys, held, pack_numbers(sizes), texts, scores
            yield from out.add(row, len(row[3]) + 22 * len(row[6]))
            owners = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct)) % n
            order = np.argsort(owners, kind="stable")
            cuts = np.searchsorted(owners[order], np.arange(n + 1))
            for o in range(n):
                at = order[cuts[o] : cuts[o + 1]]
                if len(at):
                    row = keys_of[o], block, mark, pack_numbers(np.diff(at, prepend=0)), pack_bytes([distinct[i] for i in at.tolist()]), pack_numbers(counts[at]), None, None, None, None, None
                    yield from out.add(row, sum(map(len, row[3:6])))
        yield from out.flush()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(pa.schema([("block", pa.int64()), ("stamp", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("kinds", pa.int64()), ("tokens", pa.int64())]))
        place: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        total = np.zeros(1 << 10, np.int64)
        kept = []
        for batch in batches:
            for _, block, mark, places, blob, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = unpack_bytes(blob)
                at = np.fromiter(map(place.__getitem__, own), np.uint32, len(own))
                if len(place) > len(total):
                    total = np.concatenate([total, np.zeros(len(place), np.int64)])
                total[at] += unpack_numbers(counts)  # a block's tokens differ
                kept.append((block, mark, places, pack_numbers(at)))
        known = len(place)
        place.clear()
        for block, mark, places, at in kept:
            data = total[unpack_numbers(at)].astype(np.uint64)
            pair = pack_numbers(data & np.uint64(0xFFFFFFFF)) if data.max() < 1 << 32 else b"\x00" + zstandard.ZstdCompressor().compress(data.tobytes())
            yield from out.add((block, mark, places, pair, 0, 0), len(places) + len(pair))
        yield from out.add((-1, 0, b"", b"", int((total[:known] > 0).sum()), int(total.sum())), 0)
        yield from out.flush()

    found = with_model(numbered_blocks(docs), table).select("block", "keys", "held", "lengths", F.call_function("context_mixer_scores", "model", packed_weights(weights), "text", "lengths").alias("scores"), F.call_function("context_mixer_words", "text", "lengths").alias("found"))
    sent = written(found.mapInArrow(releasing(words), "owner long, block long, stamp long, places binary, words binary, counts binary, keys array<long>, held array<boolean>, sizes binary, lengths binary, scores binary"), "tokens")
    blocks = sent.filter("owner is null").select("block", "stamp", "keys", "held", "sizes", "places", "lengths", "scores")
    sent = sent.filter("owner is not null").select("owner", "block", "stamp", "places", "words", "counts")
    return blocks, written(sent.repartition(n, "owner").mapInArrow(releasing(count), "block long, stamp long, places binary, counts binary, kinds long, tokens long"), "counts")


def document_scores(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every whole text.

    Null and empty texts are scored as empty ones: their end alone. Rows without an id are learnt from. Repeated rows count
    and return as often as they occur; other columns of ``documents`` play no part; an empty table gives no rows. The
    texts are read several times and must be the same each time, as those of a table are.
    """
    bounded(documents.sparkSession)
    functions(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text_"))
    table, weights = train_model(docs)
    rows, counted = token_counts(docs, table, weights)
    totals = counted.agg(F.sum("kinds").alias("v"), F.sum("tokens").alias("n")).first()
    kinds, total = int(totals["v"] or 0), int(totals["n"] or 0)
    rest = math.log10(total + kinds + 1)

    def wide(data: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint64).astype(np.int64) if data[:1] == b"\x00" else unpack_numbers(data).astype(np.int64)

    def base(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1 or {*left.column("stamp").to_pylist()} != {*right.column("stamp").to_pylist()}:
            raise RuntimeError("a block's tokens and their counts are not of the same reading")
        at = np.concatenate([unpack_numbers(b).cumsum(dtype=np.int64) for b in right.column("places").to_pylist()])
        count_of = np.zeros(len(at), np.int64)
        count_of[at] = np.concatenate([wide(b) for b in right.column("counts").to_pylist()])
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        sizes, places = unpack_numbers(row["sizes"]).astype(np.int64), unpack_numbers(row["places"])
        begins = np.cumsum(sizes) - sizes  # every text has its end, so none is empty
        logs = np.add.reduceat(np.log10(count_of + 1.0)[places], begins) - sizes * rest
        known = np.add.reduceat((count_of > 0).astype(np.int64)[places], begins)
        out = pa.table({"doc_id": pa.array(row["keys"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "base_score": pa.array(logs), "score": pa.array(np.frombuffer(row["scores"], "<f8")), "n_bytes": pa.array(np.frombuffer(row["lengths"], "<i4").astype(np.int64))})
        release()
        return out

    both = rows.groupBy("block").cogroup(counted.filter("block >= 0").select("block", "stamp", "places", "counts").groupBy("block"))
    out = both.applyInArrow(base, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = -F.col("score") / F.lit(math.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
