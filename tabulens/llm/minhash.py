"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A signature's coordinates come from two permutations: the first scatters shingles over a universe of 2**32 places, the
second, shifted circularly by one place more for each coordinate, ranks them. Nodes of the link graph are distinct
shingle sets, so exact copies are joined before any comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import BATCH_BYTES, Rows, as_bytes, blocks, bounded, fresh, release, releasing, text_or_empty, written

#: Bands and coordinates in each: a pair at similarity 0.8 is missed with probability 2e-6, one at 0.85 with 1e-8.
BANDS, ROWS = 25, 4
#: Standard deviations below the threshold from which on a pair's estimated similarity rules it out, in the second round.
SLACK = 5.0
#: Members of a bucket that one task compares with each other; larger buckets are compared chunk by chunk.
CHUNK = 1024
#: Rows whose keys go to every task, so that the others' texts stay where they are; more are joined by a shuffle.
FEW_WANTED = 1 << 20
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 17


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``words`` words, and the least similarity ``num`` / ``den``, compared in whole numbers."""

    words: int
    num: int
    den: int

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common) > 0


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _rank32(x: np.ndarray) -> np.ndarray:
    """A permutation of 2**32 places (the finaliser of MurmurHash3), in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


class Shingler:
    def __init__(self, words: int):
        self.words, self.known = words, {}

    def set_of(self, data: bytes) -> np.ndarray:
        """The sorted 64-bit hashes of a text's distinct shingles; with fewer words all of them are one shingle."""
        tokens = data.lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in {*tokens}:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        n = min(self.words, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            total = _mix64(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return np.unique(total)


def signature(s: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the least rank of the scattered shingles shifted by k places."""
    scattered = (s >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(scattered), 1024):
        part = _rank32(scattered[i : i + 1024, None] + shifts[None, :])
        np.minimum(best, part.min(axis=0), out=best)
    return best


def pack_set(s: np.ndarray) -> bytes:
    """Whole sorted hashes as differences, by byte planes; the planes above the greatest difference are left out."""
    d = np.diff(s, prepend=np.uint64(0))
    planes = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())


def unpack_set(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.view("<u8").ravel().cumsum(dtype=np.uint64)


def text_mark(text: str) -> Column:
    return F.xxhash64(text_or_empty(text))


def sketches(docs: DataFrame, like: Likeness, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A written table (key, mark, n, node, brief, bands), a row for each document.

    ``mark`` is a hash of the text, ``node`` a digest of the set (null if it is empty), ``brief`` holds a byte of each
    coordinate.
    """
    bounded(docs.sparkSession)
    schema = pa.schema([(key, pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("brief", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, out = Shingler(like.words), Rows(schema)
        numbers = np.arange(BANDS, dtype=np.uint64)
        for part in blocks(batches, BATCH_BYTES, "text_"):
            for k, mark, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), strict=True):
                s = shingler.set_of(data)
                if not len(s):
                    yield from out.add((k, mark, 0, None, None, None), 0)
                    continue
                sig = signature(s)
                band = numbers.copy()
                for i in range(ROWS):
                    band = _mix64(band * np.uint64(0x9E3779B97F4A7C15) + sig[i::ROWS].astype(np.uint64))
                yield from out.add((k, mark, len(s), digest(s), (sig & np.uint32(255)).astype(np.uint8).tobytes(), band.view(np.int64).tolist()), 400)
        yield from out.flush()

    source = docs.select(F.col(key).cast("long").alias(key), text_mark(text).alias("mark"), text_or_empty(text).alias("text_"))
    return written(source.mapInArrow(releasing(run), f"{key} long, mark long, n long, node binary, brief binary, bands array<long>"), "sketches")


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def whole_sets(docs: DataFrame, wanted: DataFrame, like: Likeness, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(node, shingles) of the documents whose (key, mark) are in the written table ``wanted``, which are read again."""
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, out = Shingler(like.words), Rows(schema)
        for part in blocks(batches, BATCH_BYTES, "text_"):
            for data in as_bytes(part.column(0)):
                s = shingler.set_of(data)
                blob = pack_set(s)
                yield from out.add((digest(s), blob), len(blob))
        yield from out.flush()

    source = docs.select(F.col(key).cast("long").alias("key_"), text_mark(text).alias("mark_"), text_or_empty(text).alias("text_"))
    own = wanted.select(F.col(key).alias("k"), F.col("mark").alias("m"))
    same = source["key_"].eqNullSafe(own["k"]) & (source["mark_"] == own["m"])
    rows = source.join(F.broadcast(own) if own.count() <= FEW_WANTED else own, same, "left_semi").select("text_")
    return rows.mapInArrow(releasing(run), "node binary, shingles binary").dropDuplicates(["node"])


def _least_equal(like: Likeness) -> int:
    """Equal coordinates from which on a pair may reach the threshold; fewer rule it out at SLACK standard deviations."""
    size, share = BANDS * ROWS, like.num / like.den
    return int(size * (share - SLACK * (share * (1 - share) / size) ** 0.5))


def _verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike. Joins that meet a hot node are dealt anew at run time.

    Sizes and signatures come first, so that only likely pairs move whole sets.
    """
    least = _least_equal(like)

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for i in (2, 3))
            keep = ((x == y).sum(axis=1) >= least) & (like.den * np.minimum(m, n) >= like.num * np.maximum(m, n))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = None, None
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                if a[i] != last:
                    last, s = a[i], unpack_set(x[i])
                t = unpack_set(y[i])
                keep.append(like.linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    pairs = pairs.join(side("b", "brief", "n"), "b").join(side("a", "brief", "n"), "a").select("a", "b", "brief_a", "brief_b", "n_a", "n_b").mapInArrow(likely, "a binary, b binary")
    both = written(pairs, "likely").join(side("b", "shingles"), "b").join(side("a", "shingles"), "a")
    return both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(releasing(run), "a binary, b binary")


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(node, comp): for each node of the links (a, b) the least node that it is joined with.

    Alternates the two star operations of Kiveris et al. (2014) until nothing changes; every round is written, and
    nothing but counts reaches the driver.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(most):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("d"))
        # large star: larger neighbours of a node go to the least of it and its neighbours
        large = both.filter("b > a").join(least.select("a", F.least("a", "m").alias("m")), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of these
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        after = written(small, "edges")
        same = after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _joining(like: Likeness):
    """Links that join components within a part of a bucket, exactly verified; at most one fewer than there are components.

    A pair is compared unless it is joined already, its sizes or signatures rule it out, or an earlier band has both.
    """
    size, least = BANDS * ROWS, _least_equal(like)

    def run(table: pa.Table) -> pa.Table:
        node, chunk, n = table.column("node").to_pylist(), np.array(table.column("chunk").to_pylist()), table.num_rows
        brief = np.frombuffer(b"".join(table.column("brief").to_pylist()), np.uint8).reshape(n, size)
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(n, BANDS)
        sizes = np.array(table.column("n").to_pylist(), np.int64)
        at = int(np.flatnonzero(bands[0] == table.column("band")[0].as_py())[0])
        numbers: dict[bytes, int] = {}
        root = np.array([numbers.setdefault(c, len(numbers)) for c in table.column("comp").to_pylist()])
        packed = table.column("shingles").to_pylist()
        sets: dict[int, np.ndarray] = {}

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = unpack_set(packed[i])
            return sets[i]

        same = chunk.min() == chunk.max()
        right = np.arange(n) if same else np.flatnonzero(chunk == chunk.max())
        a, b = [], []
        for i in range(n) if same else np.flatnonzero(chunk == chunk.min()).tolist():
            other = right[right > i] if same else right
            other = other[root[other] != root[i]]
            small, large = np.minimum(sizes[other], sizes[i]), np.maximum(sizes[other], sizes[i])
            other = other[like.den * small >= like.num * large]
            if not len(other):
                continue
            other = other[(brief[other] == brief[i]).sum(axis=1) >= least]
            other = other[(bands[other, :at] != bands[i, :at]).all(axis=1)]
            for j in other.tolist():
                if root[j] != root[i]:
                    s, t = set_of(i), set_of(j)
                    if like.linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)):
                        a.append(node[i])
                        b.append(node[j])
                        root[root == root[j]] = root[i]
        release()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def classes_of_sets(docs: DataFrame, table: DataFrame, like: Likeness, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(node, comp) for sets of ``table``, the sketches of ``docs``, that are linked with another one: the least node of their class.

    First every member of a bucket is compared with the bucket's leader, which is another one for each band; then, in
    buckets that still hold several classes, members of different classes are compared by signature, in chunks of
    bounded size, and the likely ones exactly. Whole sets are made only of documents that share a bucket.
    """
    # one row of each distinct set
    nodes = table.filter("node is not null").select("node", "n", "brief", "bands", F.struct(key, "mark").alias("own"))
    nodes = nodes.groupBy("node").agg(F.first("n").alias("n"), F.first("brief").alias("brief"), F.first("bands").alias("bands"), F.min("own").alias("own"))
    nodes = written(nodes, "nodes")
    exploded = nodes.select("node", F.explode("bands").alias("band"))
    order = F.xxhash64("band", "node")
    leaders = exploded.groupBy("band").agg(F.min_by("node", order).alias("leader"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("band", "leader", "members")
    shared = written(exploded.join(leaders, "band"), "buckets")
    first = shared.filter("leader <> node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    first = written(first, "pairs")
    wanted = written(nodes.join(shared.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = whole_sets(docs, wanted.select(F.col(f"own.{key}").alias(key), "own.mark"), like, text, key)
    sets = written(wanted.select("node", "n", "brief", "bands").join(sets, "node"), "sets")
    if sets.count() != wanted.count():
        raise RuntimeError("documents were read differently the second time; compare a written table")
    links = written(_verified(first, sets, like), "links")
    joined = written(components(links), "components")
    known = shared.join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = known.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("members").alias("size")).filter("low <> high").select("band", "size")
    rest = known.join(mixed, "band").select("band", "node", "comp", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    # a bucket of several chunks is compared chunk by chunk; a member goes to each pair of chunks that has its own
    own = F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int")
    rest = rest.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rest = rest.join(sets, "node")
    rest = rest.select("band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "comp", "chunk", "n", "brief", "bands", "shingles")
    more = rest.groupBy("band", "i", "j").applyInArrow(_joining(like), "a binary, b binary")
    more = more.join(joined.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(joined.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    more = components(more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    final = joined.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    alone = more.join(joined, "node", "left_anti").select("node", "comp")
    return written(reduce(DataFrame.union, [final, alone]), "final")


def near_duplicates(docs: DataFrame, like: Likeness, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept): near-duplicate classes of whole texts.

    A text's set is that of its distinct shingles; null and empty texts have none and are linked with nothing. Links are
    confirmed on whole sets of 64-bit hashes. ``component_id`` is the least key reachable, itself included; ``kept`` tells
    whether it is the row's own. Equal sets are one node. Rows without a key have no component. Repeated rows are
    repeated in the result; other columns of ``docs`` play no part, whatever their names; an empty table gives no rows.
    """
    table = sketches(docs, like, text, key)
    final = classes_of_sets(docs, table, like, text, key)
    rows = table.select(F.col(key), "n", "node").join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = rows.filter("comp is not null").groupBy("comp").agg(F.min(key).alias("component_id"))
    # only classes of several rows need the join; a third of all rows may be of one class, which is dealt anew
    out = rows.join(least, "comp", "left").withColumn("component_id", F.coalesce("component_id", F.col(key)))
    return out.select(key, F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)).alias("kept"))


#: What the query takes as near: three words, 0.85. Elsewhere: five words, 0.8.
QUERY, DEFAULT = Likeness(3, 85, 100), Likeness(5, 8, 10)


def deduplicated(docs: DataFrame, like: Likeness = DEFAULT) -> DataFrame:
    """One document of each near-duplicate class, with all columns: the one of least id, of several with that id one.

    Documents without words or without an id stay as they are. What goes is decided by id and text together, so texts that
    differ beyond the threshold stay even if they share an id; of repeated rows one stays. Extra columns may have any name.
    """
    table = sketches(docs, like)
    known = table.filter("node is not null and doc_id is not null").select("doc_id", "mark", "node")
    rows = known.join(classes_of_sets(docs, table, like), "node", "left").select(F.coalesce("comp", "node").alias("comp"), "doc_id", "mark")
    kept = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "mark")).alias("row")).select("row.doc_id", "row.mark").distinct()
    own, mark = fresh(docs, "own", "mark")
    wordless = F.col("doc_id").isNull() | (F.length(F.trim(F.regexp_replace(text_or_empty(), r"[\x09-\x0D]", " "))) == 0)
    marked = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(mark, text_mark("text"))
    stays = marked.filter(~wordless).join(kept.select(F.col("doc_id").alias(own), F.col("mark").alias(mark)), [own, mark], "left_semi").dropDuplicates([own, mark])
    return stays.select(*docs.columns).union(docs.filter(wordless))
