"""Containers parsed by a plain reader: pages, packets, granules, and the feature of the query."""

import hashlib
import random
import struct
import zlib

import pytest

from tabulens.llm import ogg


def plain_pages(data):
    """(flags, granule, serial, number, lacing values, body) of every page, by the layout of the format alone."""
    at = 0
    while at < len(data):
        magic, version, flags, granule, serial, number, _, n = struct.unpack_from("<4sBBqIIIB", data, at)
        assert magic == b"OggS" and version == 0
        lacing = list(data[at + 27 : at + 27 + n])
        body = data[at + 27 + n : at + 27 + n + sum(lacing)]
        page = bytearray(data[at : at + 27 + n + sum(lacing)])
        page[22:26] = b"\0\0\0\0"
        assert struct.unpack_from("<I", data, at + 22)[0] == ogg.checksum(bytes(page))
        yield flags, granule, serial, number, lacing, body
        at += 27 + n + sum(lacing)


def plain_packets(pages):
    out, open_ = {}, {}
    for _, _, serial, _, lacing, body in pages:
        at = 0
        for v in lacing:
            open_[serial] = open_.get(serial, b"") + body[at : at + v]
            at += v
            if v < 255:
                out.setdefault(serial, []).append(open_.pop(serial))
    assert not open_
    return out


def texts():
    rng = random.Random(4)
    return [None, "", "a", "é" * 300, "x" * 576, "y" * 577, "".join(chr(rng.randint(32, 0x2FF)) for _ in range(40_000)), "a"]


def test_features_are_those_of_a_plain_reader(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    media = {r["doc_id"]: bytes(r["media"]) for r in ogg.store(df).collect()}
    for r in ogg.digests(ogg.load(ogg.store(df))).collect():
        text = (texts()[r["doc_id"]] or "").encode()
        whole = text + b"\xff" * (-len(text) % 576 if text else 576)
        data = media[r["doc_id"]]
        pages = list(plain_pages(data))
        packets = plain_packets(pages)
        first = next(s for _, _, s, _, _, b in pages if b.startswith(ogg.SAMPLES_MAGIC))
        assert b"".join(packets[first][1:]) == whole
        ends = [g for _, g, s, _, _, _ in pages if s == first and g > 0]
        assert r["feature"] == f"pages={len(pages)};packets={sum(map(len, packets.values()))};streams=2;first_us={ends[0] * 1_000_000 // ogg.RATE};end_us={len(whole) * 1_000_000 // ogg.RATE};mean={sum(whole) * 1000 // len(whole)};peak={max(whole)}"
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        for serial in packets:  # each stream begins, ends and counts its pages by itself
            own = [p for p in pages if p[2] == serial]
            assert own[0][0] & 2 and own[-1][0] & 4 and [p[3] for p in own] == list(range(len(own)))
    assert media[2] == media[7] and media[0] == media[1]


def test_null_containers_are_refused(spark):
    with pytest.raises(Exception, match="no container"):
        ogg.load(spark.createDataFrame([(1, None)], "doc_id long, media binary")).collect()
