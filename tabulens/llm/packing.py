"""Compact binary forms of number and byte-string lists, for columns that are shuffled."""

from __future__ import annotations

import numpy as np
import zstandard


def pack_numbers(x: np.ndarray) -> bytes:
    """uint32 numbers by byte planes, so that small ones cost little."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def pack_bytes(items: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, items), np.uint32, len(items)).tobytes()
    return len(items).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(items))


def unpack_bytes(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[4:])
    ends = (np.frombuffer(raw, np.uint32, n).cumsum(dtype=np.int64) + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends], ends, strict=False)]
