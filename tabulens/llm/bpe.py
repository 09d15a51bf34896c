"""Byte-level BPE by a distinct-word exchange, and decoding by the token-byte table.

Documents are read in blocks. A block's texts are split into pre-tokens; its distinct pre-tokens travel, packed by
hash, to the task that owns the hash, where each distinct word of the whole corpus is encoded once; the ids travel
back to the block and are put together again by position.
"""

from __future__ import annotations

import base64
import functools
import itertools
import sys
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import Rows, bounded, merged_blocks, owner_keys, partitions, release, releasing, text_or_empty
from tabulens.llm.packing import pack_bytes, pack_numbers, unpack_bytes, unpack_numbers

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Ids that are decoded at once.
DECODE_IDS = 1 << 20
#: Unicode's white space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as one pre-token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.cache
def _kinds() -> np.ndarray:
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kinds[c] = _LETTER if k == "L" else _NUMBER
    kinds[SPACES] = _SPACE
    return kinds


def bounds(text: str) -> np.ndarray:
    """Where pre-tokens begin, and the end of the text: what the splitting pattern of the public rank files matches.

    Runs of letters, numbers and other signs take one space before them; white space keeps its last character apart
    when something follows; an apostrophe that begins a run takes a contraction's letters.
    """
    n = len(text)
    if not n:
        return np.zeros(1, np.int64)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[chars]
    begins = np.empty(n + 1, bool)
    begins[0] = begins[n] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:n])
    space = kind == _SPACE
    # the last white space before something else begins a pre-token
    last = space[:-1] & ~space[1:]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = last & (chars[:-1] == 0x20)
    begins[:-2] |= last
    begins[:n] &= ~blank_before
    # apostrophes that are a whole run and don't follow a space
    quote = np.flatnonzero((chars[:-1] == 0x27) & begins[: n - 1] & (kind[1:] == _LETTER) & ~blank_before[:-1])
    for i in quote.tolist():
        if i and kind[i - 1] == _OTHER:
            continue
        for tail in CONTRACTIONS:
            if text.startswith(tail, i + 1):
                begins[i + 1] = False
                begins[i + 1 + len(tail)] = True
                break
    return np.flatnonzero(begins)


def pre_tokens(text: str) -> list[str]:
    at = bounds(text).tolist()
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


class Vocabulary:
    """The ranks of a rank file: base64 of a token's bytes and its id on each line."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.table[i] = token
        self._core = None

    def word(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the merge of lowest rank first."""
        if self._core is None:
            import tiktoken

            self._core = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._core.encode_single_piece(piece)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary in a local file that is installed on every machine; read once for each Python worker."""
    if path not in _vocabularies:
        with open(path, "rb") as f:
            _vocabularies[path] = Vocabulary(f.read())
    return _vocabularies[path]


def _numbered_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    part = TaskContext.get().partitionId()
    for i, rows in enumerate(merged_blocks(batches, BLOCK_BYTES, "text_")):
        yield part << 32 | i, rows


def _stamp(distinct: Iterable[str]) -> int:
    return zlib.crc32("\x00".join(distinct).encode("utf-8", "surrogatepass"))


def _owners(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % n


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(key, ids array<int>): every whole text by the ranks in ``path``, without special tokens.

    ``decoded``: with what ``decode`` gives for the ids, made in the same worker.

    Null and empty texts have no ids. Repeated rows give repeated rows; a null key stays null; other columns play no
    part. ``docs`` is read twice and must give the same rows in the same partitions each time, as a table does; a
    block whose two readings differ raises an error instead of giving wrong ids. Memory is bounded by a block, and by
    the distinct words that one of the shuffle partitions owns.
    """
    bounded(docs.sparkSession)
    n = partitions(docs)
    keys_of = owner_keys(docs.sparkSession, n)
    source = docs.select(F.col(key).cast("long").alias(key), text_or_empty(text).alias("text_"))
    words_schema = pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("stamp", pa.int64()), ("places", pa.binary()), ("words", pa.binary())])
    places_schema = pa.schema([("block", pa.int64()), ("stamp", pa.int64()), (key, pa.int64()), ("places", pa.binary())])
    ids_schema = pa.schema([("block", pa.int64()), ("stamp", pa.int64()), ("places", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])
    out_schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32())), *([("decoded", pa.binary())] if decoded else [])])

    def words_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(words_schema)
        for block, rows in _numbered_blocks(batches):
            known: dict[str, None] = {}  # in the order of their first places
            for t in rows.column(1).to_pylist():
                known |= dict.fromkeys(pre_tokens(t))
            stamp = _stamp(known)
            data = [w.encode("utf-8", "surrogatepass") for w in known]
            owners = _owners(data, n)
            order = np.argsort(owners, kind="stable")
            cuts = np.searchsorted(owners[order], np.arange(n + 1))
            for o in range(n):
                own = order[cuts[o] : cuts[o + 1]]
                if len(own):
                    row = keys_of[o], block, stamp, pack_numbers(np.diff(own, prepend=0)), pack_bytes([data[i] for i in own.tolist()])
                    yield from out.add(row, len(row[3]) + len(row[4]))
        yield from out.flush()

    def places_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(places_schema)
        for block, rows in _numbered_blocks(batches):
            place: defaultdict[str, int] = defaultdict(itertools.count().__next__)
            found = []
            for t in rows.column(1).to_pylist():
                w = pre_tokens(t)
                found.append(pack_numbers(np.fromiter(map(place.__getitem__, w), np.uint32, len(w))))
            stamp = _stamp(place)
            for k, blob in zip(rows.column(0).to_pylist(), found, strict=True):
                yield from out.add((block, stamp, k, blob), len(blob))
        yield from out.flush()

    def encode_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known, out = vocabulary(path), {}, Rows(ids_schema)
        for batch in batches:
            for _, block, stamp, places, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids: list[int] = []
                sizes: list[int] = []
                for w in unpack_bytes(blob):
                    found = known.get(w)
                    if found is None:
                        found = known[w] = tuple(vocab.word(w))
                    ids += found
                    sizes.append(len(found))
                row = block, stamp, places, pack_numbers(np.array(sizes)), pack_numbers(np.array(ids))
                yield from out.add(row, sum(map(len, row[2:])))
        yield from out.flush()

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        stamps = {*left.column("stamp").to_pylist(), *right.column("stamp").to_pylist()}
        if len(stamps) > 1:
            raise RuntimeError("a block of documents was read differently the second time; encode a written table")
        places = [unpack_numbers(b).cumsum(dtype=np.int64) for b in right.column("places").to_pylist()]
        sizes = [unpack_numbers(b) for b in right.column("sizes").to_pylist()]
        flat = np.concatenate([unpack_numbers(b) for b in right.column("ids").to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int32)
        at = np.concatenate(places or [np.zeros(0, np.int64)])
        size = np.zeros(len(at), np.int64)
        start = np.zeros(len(at), np.int64)
        every = np.concatenate(sizes or [np.zeros(0, np.uint32)]).astype(np.int64)
        size[at] = every
        start[at] = np.cumsum(every) - every
        keys, out, ends = [], [], [0]
        for k, blob in zip(left.column(key).to_pylist(), left.column("places").to_pylist(), strict=True):
            p = unpack_numbers(blob)
            n_ids = size[p]
            total = int(n_ids.sum())
            out.append(flat[np.repeat(start[p] - (np.cumsum(n_ids) - n_ids), n_ids) + np.arange(total)])
            keys.append(k)
            ends.append(ends[-1] + total)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out or [flat[:0]]), pa.int32()))
        columns = [pa.array(keys, pa.int64()), lists]
        if decoded:
            table = pa.array(vocabulary(path).table, pa.binary())
            columns.append(pa.chunked_array([texts_of(part.column(1), table) for part in _by_values(pa.RecordBatch.from_arrays(columns, names=[key, "ids"]), DECODE_IDS)], pa.binary()))
        release()
        return pa.Table.from_arrays(columns, schema=out_schema)

    words = source.mapInArrow(releasing(words_of), "owner long, block long, stamp long, places binary, words binary")
    ids = words.repartition(n, "owner").mapInArrow(releasing(encode_words), "block long, stamp long, places binary, sizes binary, ids binary")
    places = source.mapInArrow(releasing(places_of), f"block long, stamp long, {key} long, places binary")
    return places.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(reassemble, f"{key} long, ids array<int>" + ", decoded binary" * decoded)


def texts_of(lists: pa.ListArray, table: pa.Array) -> pa.BinaryArray:
    """The bytes of each list of ids: looked up at once, so that the bytes of all rows lie in one buffer."""
    found = table.take(lists.flatten())
    # a row's text ends where its last id's bytes end
    at = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())])
    ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1) if len(found) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(ends[at])), found.buffers()[2]])


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded binary): the bytes of each list of ids, by the table of token bytes in ``path``.

    The table has as many rows as the vocabulary, so every task holds it and looks ids up in it. Null ids decode to
    no bytes; an id that is not in the table raises an error.
    """
    schema = pa.schema([(key, pa.int64()), (ids, pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(vocabulary(path).table, pa.binary())
        for batch in batches:
            for rows in _by_values(batch, DECODE_IDS):
                lists = rows.column(1)
                texts = texts_of(lists, table)
                yield pa.RecordBatch.from_arrays([rows.column(0), lists.cast(schema.field(1).type), texts], schema=schema)

    return encoded.select(F.col(key).cast("long").alias(key), ids).mapInArrow(releasing(run), f"{key} long, {ids} array<int>, decoded binary")


def _by_values(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices with about ``most`` list values each."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def ids_text(column: str) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(F.col(column).cast("array<string>"), " ")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded documents."""
    both = encode(docs, path, decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
