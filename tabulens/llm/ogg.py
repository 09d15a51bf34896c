"""Ogg containers in a media column: a multiplexer, and a reader that checks what it reads.

Page layout as in RFC 3533. The checksum is CRC-32 with polynomial 0x04C11DB7, neither reflected nor
inverted; it is derived here from the reflected CRC-32 of zlib over bit-reversed bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import Rows, as_bytes, blocks, text_or_empty

#: Fixed values of the container format.
CAPTURE, CONTINUED, FIRST, LAST, NO_GRANULE = b"OggS", 1, 2, 4, -1
HEADER = struct.Struct("<4sBBqIIIB")
#: Fixed values of the two streams written here: 8-bit mono samples in frames, and checksums of runs of frames.
FRAME, RATE, MARK_EVERY = 576, 48_000, 85
SAMPLES_HEAD, MARKS_HEAD = struct.Struct("<8sIIQ"), struct.Struct("<8sII")
SAMPLES_MAGIC, MARKS_MAGIC = b"\x01pcm8le\x00", b"\x02marks\x00\x00"

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes are not a whole, undamaged Ogg container."""


def checksum(page: bytes) -> int:
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Stream:
    """A logical stream: packets in order, each with its granule position."""

    serial: int
    packets: list[tuple[bytes, int]] = field(default_factory=list)


def pages_of(stream: Stream) -> list[tuple[int, bytes]]:
    """(granule position at its start, page) for each page of one stream.

    The first packet has a page of its own, as the format asks of a stream's header. Later packets are
    laced together, at most 255 segments a page, and continue on the next page where they must.
    """
    out: list[tuple[int, bytes]] = []
    number, reached = 0, 0

    def put(flags: int, lacing: bytes, body: bytes, granule: int) -> None:
        nonlocal number, reached
        head = HEADER.pack(CAPTURE, 0, flags, granule, stream.serial, number, 0, len(lacing))
        page = bytearray(head + lacing + body)
        page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
        out.append((reached, bytes(page)))
        number += 1
        reached = max(reached, granule)

    def runs(packets: list[tuple[bytes, int]], flags: int, end: int) -> None:
        lacing, body, at, done = bytearray(), [], [], 0
        for data, granule in packets:
            lacing += b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
            body.append(data)
            at.append((len(lacing), granule))
        joined, start, i, continued = b"".join(body), 0, 0, False
        for first in range(0, len(lacing), 255):
            part = bytes(lacing[first : first + 255])
            size, granule = sum(part), NO_GRANULE
            while i < len(at) and at[i][0] <= first + len(part):
                granule, i = at[i][1], i + 1
            done = first + len(part) == len(lacing)
            put(flags | CONTINUED * continued | end * done, part, joined[start : start + size], granule)
            start, flags = start + size, flags & ~FIRST
            continued = part[-1] == 255
        return None

    rest = stream.packets[1:]
    runs(stream.packets[:1], FIRST, 0 if rest else LAST)
    if rest:
        runs(rest, 0, LAST)
    return out


def mux(streams: list[Stream]) -> bytes:
    """All first pages, then the others by granule position; streams keep their own page order."""
    every = [pages_of(s) for s in streams]
    heads = [p[0][1] for p in every]
    tail = sorted(((g, k, i) for k, p in enumerate(every) for i, (g, _) in enumerate(p) if i), key=lambda x: (x[0], x[1], x[2]))
    order = [iter(p[1:]) for p in every]
    return b"".join([*heads, *(next(order[k])[1] for _, k, _ in tail)])


@dataclass
class Demuxed:
    pages: int
    order: list[int]
    packets: dict[int, list[bytes]]
    granules: dict[int, list[int]]


def demux(data: bytes) -> Demuxed:
    """Check every page and give each stream's packets and the granule positions of its pages.

    Raises OggError for a wrong capture pattern, version or checksum, a page number out of order, a missing first
    or last page, a packet that stops in the middle, or bytes left over.
    """
    at, pages = 0, 0
    packets: dict[int, list[bytes]] = {}
    granules: dict[int, list[int]] = {}
    open_: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError("a page header is cut off")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if magic != CAPTURE or version:
            raise OggError(f"no page begins at byte {at}")
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("a page is cut off")
        page = bytearray(data[at:end])
        page[22:26] = bytes(4)
        if checksum(bytes(page)) != crc:
            raise OggError(f"the checksum of the page at byte {at} is wrong")
        if bool(flags & FIRST) != (serial not in expected) or serial in ended or number != expected.get(serial, 0):
            raise OggError(f"page {number} of stream {serial} is out of order")
        held = open_.setdefault(serial, [])
        if bool(flags & CONTINUED) != bool(held):
            raise OggError(f"page {number} of stream {serial} doesn't continue its packet")
        expected[serial] = number + 1
        own, start, stop = packets.setdefault(serial, []), end - sum(lacing), end - sum(lacing)
        for value in lacing:
            stop += value
            if value < 255:
                own.append(b"".join([*held, data[start:stop]]) if held else data[start:stop])
                held.clear()
                start = stop
        if stop > start or (lacing and lacing[-1] == 255):
            held.append(data[start:stop])
        granules.setdefault(serial, []).append(granule)
        if flags & LAST:
            ended.add(serial)
        at, pages = end, pages + 1
    if any(open_.values()) or ended != set(expected):
        raise OggError("a stream has no last page or an unfinished packet")
    return Demuxed(pages, list(expected), packets, granules)


def encode(payload: bytes, length: int) -> bytes:
    """Payload (a multiple of FRAME bytes) as 8-bit samples; length: the bytes that were there before padding."""
    serial = zlib.crc32(payload)
    samples, marks = Stream(serial), Stream(serial ^ 0x5A5A5A5A)
    samples.packets.append((SAMPLES_HEAD.pack(SAMPLES_MAGIC, RATE, FRAME, length), 0))
    marks.packets.append((MARKS_HEAD.pack(MARKS_MAGIC, RATE, MARK_EVERY), 0))
    samples.packets += [(payload[i : i + FRAME], i + FRAME) for i in range(0, len(payload), FRAME)]
    step = FRAME * MARK_EVERY
    for i in range(0, len(payload), step):
        part = payload[i : i + step]
        marks.packets.append((struct.pack("<I", zlib.crc32(part)), i + len(part)))
    return mux([samples, marks])


@dataclass
class Track:
    payload: bytes
    length: int
    feature: str


def decode(data: bytes) -> Track:
    """The samples of a container, checked against its stream of checksums, and a summary.

    Timestamps follow from granule positions: a page ends at granule / rate seconds.
    """
    found = demux(data)
    samples = next((s for s in found.order if found.packets[s][0].startswith(SAMPLES_MAGIC)), None)
    marks = next((s for s in found.order if found.packets[s][0].startswith(MARKS_MAGIC)), None)
    if samples is None or marks is None:
        raise OggError("a stream is missing")
    _, rate, frame, length = SAMPLES_HEAD.unpack(found.packets[samples][0])
    payload = b"".join(found.packets[samples][1:])
    _, _, every = MARKS_HEAD.unpack(found.packets[marks][0])
    step = frame * every
    if [zlib.crc32(payload[i : i + step]) for i in range(0, len(payload), step)] != [int.from_bytes(x, "little") for x in found.packets[marks][1:]]:
        raise OggError("the samples don't match their stream of checksums")
    ends = [g for g in found.granules[samples] if g > 0]
    if (ends[-1] if ends else 0) != len(payload) or ends != sorted(ends):
        raise OggError("granule positions don't match the samples")
    level = np.frombuffer(payload, np.uint8)
    feature = f"pages={found.pages};packets={sum(map(len, found.packets.values()))};streams={len(found.order)};first_us={ends[0] * 1_000_000 // rate if ends else 0};end_us={len(payload) * 1_000_000 // rate};mean={int(level.sum(dtype=np.int64)) * 1000 // max(1, len(level))};peak={int(level.max(initial=0))}"
    return Track(payload, length, feature)


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % FRAME if data else FRAME)


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media): every whole text as an Ogg container.

    Null and empty texts are one frame of padding. Repeated rows give repeated rows, a null key stays null, and
    other columns play no part. The container depends on the text alone.
    """
    schema = pa.schema([(key, pa.int64()), ("media", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for part in blocks(batches, out.limit, "text_"):
            for k, data in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                media = encode(padded(data), len(data))
                yield from out.add((k, media), len(media))
        yield from out.flush()

    return df.select(F.col(key).cast("long").alias(key), text_or_empty(text).alias("text_")).mapInArrow(run, f"{key} long, media binary")


def load(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """Read containers back: (key, n_bytes, payload, media_bytes, media_sha256, feature).

    A damaged container raises OggError; a null one is an error as well, as no text is stored as null.
    """
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    raise OggError("there is no container")
                track = decode(data)
                yield from out.add((k, track.length, track.payload, len(data), hashlib.sha256(data).hexdigest(), track.feature), len(track.payload))
        yield from out.flush()

    return df.select(F.col(key).cast("long").alias(key), F.col(media)).mapInArrow(run, f"{key} long, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string")


def digests(df: DataFrame) -> DataFrame:
    """What ``load`` gives, the payload as its length, SHA-256 and the CRC-32 of its last 32 bytes."""
    size = F.octet_length("payload")
    return df.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
