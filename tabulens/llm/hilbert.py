"""Shards along a Hilbert curve through several metadata dimensions; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import bounded, fresh, partitions, text_or_empty, written


@dataclass(frozen=True)
class Dimension:
    """A dimension of the curve: a column expression that gives 0 .. 2**bits - 1 for every row, null included."""

    name: str
    cell: Column


#: Labels up to this number are sent to every task with their cells; more are joined by a shuffle.
FEW_LABELS = 10_000
#: Fine steps of a size for each doubling, and of all sizes; their counts are what equally full cells are made of.
STEPS, SIZES = 16, 1024


def label_cells(df: DataFrame, column: str, bits: int, to: str) -> DataFrame:
    """``df`` with ``to``, the cell of a label column: labels in their order, null before all others.

    Up to 2**bits labels get cells of their own, spread over the range; more are cut into runs of neighbours with about as
    many rows each. Labels are ranked by a range partitioning and offsets, so their number has no bound.
    """
    key, n, part, at, before, cell = fresh(df, "key", "n", "part", "at", "before", "cell")
    keyed = df.withColumn(key, F.coalesce(F.concat(F.lit("1"), F.col(column).cast("string")), F.lit("0")))
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias(n)).repartitionByRange(partitions(df), key).sortWithinPartitions(key)
    counts = written(counts.withColumn(at, F.monotonically_increasing_id()), "labels").withColumn(part, F.shiftright(at, 33))
    sums = counts.groupBy(part).agg(F.sum(n).alias("rows"), F.count(F.lit(1)).alias("kinds"))
    # one row for each shuffle partition
    over = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(part, F.coalesce(F.sum("rows").over(over), F.lit(0)).alias("rows"), F.coalesce(F.sum("kinds").over(over), F.lit(0)).alias("kinds"))
    total = sums.agg(F.sum("rows").alias("rows"), F.sum("kinds").alias("kinds")).first()
    rows, kinds = total["rows"] or 0, total["kinds"] or 0
    ranked = counts.join(F.broadcast(offsets), part)
    if kinds <= 1 << bits:
        place = F.expr(f"(kinds + ({at} & {(1 << 33) - 1}L)) * {1 << bits} div {max(1, kinds)}")
    else:
        before_ = F.sum(n).over(Window.partitionBy(part).orderBy(at)) - F.col(n) + F.col("rows")
        place = F.floor((before_.cast("double") + F.col(n) / 2) * (1 << bits) / max(1, rows))
    cells = ranked.select(key, F.least(place, F.lit((1 << bits) - 1)).cast("int").alias(to))
    return keyed.join(F.broadcast(cells) if kinds <= FEW_LABELS else cells, key).drop(key)


def size_cells(df: DataFrame, column: str, bits: int, to: str) -> DataFrame:
    """``df`` with ``to``, the cell of a size: runs of fine steps, STEPS for each doubling, with about as many rows each.

    Null and negative sizes count as 0. As many counts as there are fine steps reach the driver.
    """
    fine = F.least(F.floor(F.log2(F.greatest(F.coalesce(F.col(column), F.lit(0)), F.lit(0)).cast("double") + F.lit(1.0)) * F.lit(STEPS)), F.lit(SIZES - 1)).cast("int")
    counts = {r["f"]: r["n"] for r in df.groupBy(fine.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, seen, cells = sum(counts.values()), 0, []
    for f in range(SIZES):
        n = counts.get(f, 0)
        cells.append(min((1 << bits) - 1, int((seen + n / 2) * (1 << bits) / max(1, total))))
        seen += n
    return df.withColumn(to, F.get(F.array(*map(F.lit, cells)), fine))


def curve_states(n: int) -> tuple[list[int], int]:
    """The curve in ``n`` dimensions as an automaton, for the digits of a point from the highest level down.

    Gives a table and the number of digits 2**n: entry ``state * 2**n + digit`` is ``next_state * 2**n + place``. A state is
    an entry corner and a direction; the rules for both are those of Hamilton and Rau-Chaplin (2008).
    """
    size, mask = 1 << n, (1 << n) - 1

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & mask

    def ungray(g: int) -> int:
        out = 0
        while g:
            out, g = out ^ g, g >> 1
        return out

    def entry(w: int) -> int:
        even = 2 * ((w - 1) // 2)
        return even ^ (even >> 1) if w else 0

    def direction(w: int) -> int:
        odd = w if w & 1 else w - 1
        return (~odd & (odd + 1)).bit_length() - 1 if w else 0  # trailing ones

    known, todo, table = {(0, 0): 0}, [(0, 0)], []
    while todo:
        corner, way = todo.pop(0)
        for digit in range(size):
            place = ungray(turn(digit ^ corner, -(way + 1)))
            after = corner ^ turn(entry(place), way + 1), (way + direction(place) + 1) % n
            if after not in known:
                known[after] = len(known)
                todo.append(after)
            table.append(known[after] * size + place)
    return table, size


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The position on the Hilbert curve of a point with ``bits`` bits in each of its dimensions: a fold over its levels."""
    n = len(cells)
    table, size = curve_states(n)
    known = F.array(*[F.lit(x) for x in table])

    def step(at: Column, level: Column) -> Column:
        digit = sum((F.call_function("shiftright", c.cast("int"), level).bitwiseAND(F.lit(1)) * F.lit(1 << i) for i, c in enumerate(cells)), F.lit(0))
        found = F.get(known, at["state"] * F.lit(size) + digit)
        return F.struct(F.floor(found / F.lit(size)).cast("int").alias("state"), (at["place"] * F.lit(size) + found % F.lit(size)).cast("long").alias("place"))

    start = F.struct(F.lit(0).cast("int").alias("state"), F.lit(0).cast("long").alias("place"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(bits - 1, -1, -1)]), start, step, lambda x: x["place"])


def hilbert_shards(df: DataFrame, dims: list[Dimension], bits: int, n_shards: int, tie: list[str]) -> DataFrame:
    """``df`` with ``curve`` (long), ``shard`` (0 .. n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Rows are ordered by curve index, then by the ``tie`` columns; runs of that order with equal counts (at most one
    apart) are the shards, so a shard covers few cells and its files have narrow minima and maxima in every dimension.
    The order is found by a range partitioning on curve index and ties, which also divides a cell that holds a third
    of all rows; a window sees one row for each partition only. ``df`` should hold metadata alone, as all of its
    columns are moved; its columns curve, shard and slot are replaced. Rows equal in all sort columns get their places in any order. An empty table gives no rows.
    """
    placed = df.withColumn("curve", hilbert_index([d.cell for d in dims], bits))
    id_, part, rows, before, rank = fresh(placed, "id", "part", "rows", "before", "rank")
    keys = ["curve", *tie]
    sorted_ = placed.repartitionByRange(partitions(df), *keys).sortWithinPartitions(*keys)
    # the id holds the partition's number above its 33 low bits, and the row's place in it below
    numbered = written(sorted_.withColumn(id_, F.monotonically_increasing_id()), "curve")
    counts = numbered.groupBy(F.shiftright(id_, 33).alias(part)).agg(F.count(F.lit(1)).alias(rows))
    offsets = counts.select(part, (F.sum(rows).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))).alias(before))
    total = numbered.count()  # from the footers of the written table
    # one row for each shuffle partition: bounded by the setting of that name
    joined = numbered.withColumn(part, F.shiftright(id_, 33)).join(F.broadcast(offsets), part)
    place = F.coalesce(F.col(before), F.lit(0)) + F.col(id_).bitwiseAND(F.lit((1 << 33) - 1))
    shard = F.expr(f"`{rank}` * {n_shards}L div {max(1, total)}L")
    first = F.expr(f"(shard * {max(1, total)}L + {n_shards - 1}L) div {n_shards}L")
    return joined.withColumn(rank, place).withColumn("shard", shard.cast("int")).withColumn("slot", F.col(rank) - first).drop(part, before, id_, rank)


def pruning_table(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """For each shard its count and the least and greatest value of each column: what a reader skips files by."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{p}_{c}") for c in columns for f, p in ((F.min, "min"), (F.max, "max"))])


def write_shards(sharded: DataFrame, path: str, sort: list[str]) -> None:
    """One folder of files for each shard, each sorted, so that footers prune by any of the dimensions.

    Shards are ranges of the curve with equal counts, so none is hot; each is dealt to one task.
    """
    sharded.repartitionByRange("shard").sortWithinPartitions("shard", *sort).write.partitionBy("shard").parquet(path)


#: Bits of each dimension in the query: 3 dimensions of 32 cells.
BITS = 5


def document_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, lang, source of every row, with the cells of the last two and of the size."""
    bounded(docs.sparkSession)
    text = text_or_empty()
    own = {c.lower() for c in docs.columns}
    labels = [(F.col(c) if c in own else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    meta = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *labels)
    meta = written(meta, "meta")
    meta = label_cells(label_cells(meta, "lang", BITS, "lang_cell"), "source", BITS, "source_cell")
    return size_cells(meta, "size", BITS, "size_cell")


def document_shards(docs: DataFrame, n_shards: int) -> DataFrame:
    """Documents by language, source and length along the curve.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law (``rows``), shard, slot, grown_shard (null), curve, and the
    three metadata columns' cells. A null text counts as empty, null labels stand before all others; repeated rows each
    get a place; columns of ``docs`` but doc_id, text, lang and source play no part, whatever their names. An empty table
    gives no rows.
    """
    dims = [Dimension(c, F.col(c)) for c in ("lang_cell", "source_cell", "size_cell")]
    out = hilbert_shards(document_metadata(docs), dims, BITS, n_shards, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "lang_cell", "source_cell", "size_cell")
