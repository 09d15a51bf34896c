"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is cut into k + 1 pieces: a passage within k edits of the item keeps one piece
unchanged. All pieces are searched for at once; around each hit, Myers' bit-parallel distance decides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import BATCH_BYTES, Rows, blocks, bounded, releasing, text_or_empty, written

#: Edits allowed for each character of an item, and characters of a piece at least. Pieces would be shorter, and the budget
#: therefore smaller, only for items below SHORT characters, which are held to no edits at all.
BUDGET, PIECE = 0.05, 12
#: Normalised items that are shorter than this are found between word bounds only, unchanged.
SHORT = 24
#: Characters of all items together that may go to every task; beyond, items are dealt out in groups of this size.
GROUP_CHARS = 4 << 20

_BLANK = re.compile(r"\s+")


def normalise(text: str | None) -> str:
    """Lower case, white space as one blank."""
    return _BLANK.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: float = BUDGET, piece: int = PIECE) -> tuple[int, list[tuple[int, str]]]:
    """(k, the k + 1 pieces as (offset, text)): k edits are ``budget`` of the item's length, fewer if pieces would get too short."""
    k = max(0, min(int(len(item) * budget), len(item) // piece - 1))
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bounded(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] neither begins nor ends inside a word."""
    return not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


@dataclass
class Pattern:
    """An item for Myers' algorithm (1999), one bit for each character in Python's unbounded integers."""

    text: str

    def __post_init__(self) -> None:
        self.bits: dict[str, int] = defaultdict(int)
        for i, c in enumerate(self.text):
            self.bits[c] |= 1 << i

    def best_end(self, window: str) -> tuple[int, int]:
        """(least distance of the item to any passage that ends in the window, the first such end)."""
        m = len(self.text)
        mask, top, get = (1 << m) - 1, 1 << (m - 1), self.bits.get
        up, down, score = mask, 0, m
        best, end = m, 0
        for j, c in enumerate(window, 1):
            eq = get(c, 0)
            x = eq | down
            d0 = ((((x & up) + up) & mask) ^ up) | x
            hp = (down | ~(d0 | up)) & mask
            hn = up & d0
            score += bool(hp & top) - bool(hn & top)
            hp = (hp << 1) & mask
            up = ((hn << 1) | ~(d0 | hp)) & mask
            down = hp & d0
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    """All items of a group, searched for in one pass over a text."""

    def __init__(self, items: dict[int, str], budget: float = BUDGET, piece: int = PIECE, shortest: int = 1):
        self.items = {i: t for i, t in items.items() if len(t) >= max(1, shortest)}
        self.budget, self.patterns, self.reversed = {}, {}, {}
        hits: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, t in self.items.items():
            self.budget[i], parts = pieces(t, budget, piece) if len(t) >= SHORT else (0, [(0, t)])
            for at, part in parts:
                hits[part].append((i, at))
        self.search = ahocorasick.Automaton()
        for part, where in hits.items():
            self.search.add_word(part, (len(part), where))
        if hits:
            self.search.make_automaton()

    def _pattern(self, i: int, backwards: bool = False) -> Pattern:
        known = self.reversed if backwards else self.patterns
        if i not in known:
            known[i] = Pattern(self.items[i][::-1] if backwards else self.items[i])
        return known[i]

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best passage for each item within its budget; text must be normalised."""
        if not self.items:
            return
        diagonals: dict[int, set[int]] = defaultdict(set)
        for last, (n, where) in self.search.iter(text):
            for i, at in where:
                diagonals[i].add(last + 1 - n - at)
        for i, starts in diagonals.items():
            k, m = self.budget[i], len(self.items[i])
            if m < SHORT:
                at = next((s for s in sorted(starts) if _bounded(text, s, s + m)), None)
                if at is not None:
                    yield i, 0, at, at + m
                continue
            best: tuple[int, int, int] | None = None
            begin = None
            for s in [*sorted(starts), None]:
                # windows that overlap are read as one, each at most twice as long as what it must hold
                if begin is not None and (s is None or s > begin + m + 2 * k):
                    a, b = max(0, begin - k), min(len(text), reach + m + k)
                    distance, end = self._pattern(i).best_end(text[a:b])
                    if distance <= k and (best is None or distance < best[0]):
                        best = distance, a, a + end
                    begin = None
                if s is not None:
                    begin, reach = s if begin is None else begin, s
            if best:
                distance, a, end = best
                _, length = self._pattern(i, True).best_end(text[max(a, end - m - k) : end][::-1])
                yield i, distance, end - length, end


def find_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, piece: int = PIECE, text: str = "text", key: str = "doc_id", shortest: int = 1) -> DataFrame:
    """(key, item_id, distance, start_at, end_at): for each document and item the best passage within the item's budget.

    An item is a row of the benchmark: of several texts with one item_id each is searched for and reported under that id,
    items without an id are reported under null, and rows equal in both count once.
    Positions are in the normalised text. Null and empty items, and those of less than ``shortest`` characters, are
    found nowhere; items below SHORT characters only unchanged and as whole words. Null and empty texts hold nothing;
    repeated rows are reported once each; other columns of ``docs`` and ``benchmark`` play no part. Items go to the tasks
    in groups of bounded size, one pass over the documents for each group: the driver holds one group at a time, and the
    results of all but a single group are written as they come.
    """
    bounded(docs.sparkSession)
    schema = pa.schema([(key, pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start_at", pa.int64()), ("end_at", pa.int64())])
    source = docs.select(F.col(key).cast("long").alias(key), text_or_empty(text).alias("text_"))

    def searcher(items: dict[int, str], ids: list[int | None]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher, out = Matcher(items, budget, piece, shortest), Rows(schema)
            for part in blocks(batches, BATCH_BYTES, "text_"):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for found in matcher.find(normalise(t)):
                        yield from out.add((k, ids[found[0]], *found[1:]), 40)
            yield from out.flush()

        return run

    kind = f"{key} long, item_id long, distance int, start_at long, end_at long"
    out = None
    for group, last in _last_marked(_groups(benchmark)):
        found = source.mapInArrow(releasing(searcher(*group)), kind)
        found = found if last and out is None else written(found, "leaks")
        out = found if out is None else out.unionAll(found)
    return source.mapInArrow(searcher({}, []), kind) if out is None else out


def _last_marked(items: Iterable) -> Iterator[tuple]:
    """(item, whether it is the last one)."""
    before = None
    for x in items:
        if before is not None:
            yield before, False
        before = x
    if before is not None:
        yield before, True


def _groups(benchmark: DataFrame) -> Iterator[tuple[dict[int, str], list[int | None]]]:
    """(normalised items by number, item_id of each number) in groups of at most GROUP_CHARS characters, read by partition."""
    items: dict[tuple[int | None, str], int] = {}
    held = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).distinct()

    def group() -> tuple[dict[int, str], list[int | None]]:
        return {n: t for (_, t), n in items.items()}, [i for i, _ in items]

    for r in rows.toLocalIterator():
        t = normalise(r["text"])
        if (r["item_id"], t) in items:
            continue
        if items and held + len(t) > GROUP_CHARS:
            yield group()
            items, held = {}, 0
        items[r["item_id"], t] = len(items)
        held += len(t)
    if items:
        yield group()


def decontaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, piece: int = PIECE, text: str = "text", shortest: int = 1) -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names, whose text holds no passage within an item's budget.

    Null and empty texts stay, repeated rows are decided alike. Nothing is moved; between groups of items the rows that
    are left are written.
    """
    bounded(docs.sparkSession)
    place = docs.columns.index(text)

    def keeper(items: dict[int, str]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, budget, piece, shortest)
            for rows in blocks(batches, BATCH_BYTES, text):
                clean = [next(matcher.find(normalise(t)), None) is None for t in rows.column(place).to_pylist()]
                yield rows.filter(pa.array(clean, pa.bool_()))

        return run

    out = docs
    for (items, _), last in _last_marked(_groups(benchmark)):
        out = out.mapInArrow(releasing(keeper(items)), docs.schema)
        out = out if last else written(out, "clean")
    return out
