"""Packing of symbol arrays: bit planes, nibbles, deflate.  Python functions on Arrow batches, as no built-in exists."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np


def pack_planes(symbols: np.ndarray, bits: int) -> bytes:
    """Bit planes, the least significant first, eight symbols a byte from the low bit on; none for 0 bits."""
    s = np.asarray(symbols, np.uint32)
    return b"".join(np.packbits((s >> b & 1).astype(np.uint8), bitorder="little").tobytes() for b in range(bits))


def unpack_planes(data: bytes, n: int, bits: int) -> np.ndarray:
    width = (n + 7) // 8
    if len(data) != width * bits:
        raise ValueError(f"{len(data)} bytes for {bits} planes of {n} symbols")
    out = np.zeros(n, np.uint32)
    for b in range(bits):
        plane = np.unpackbits(np.frombuffer(data, np.uint8, width, b * width), count=n, bitorder="little")
        out |= plane.astype(np.uint32) << np.uint32(b)
    return out


def pack_nibbles(symbols: np.ndarray) -> bytes:
    """Two symbols below 16 a byte, the first in the low half; an odd end is padded with 0."""
    s = np.asarray(symbols, np.uint8)
    if len(s) % 2:
        s = np.append(s, np.uint8(0))
    return (s[::2] | s[1::2] << 4).astype(np.uint8).tobytes()


def unpack_nibbles(data: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return np.stack([b & 15, b >> 4], axis=1).ravel()[:n]


def inflate(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A deflated payload in pieces of up to ``most`` bytes; a truncated stream is an error."""
    decoder = zlib.decompressobj()
    rest = data
    while rest or not decoder.eof:
        piece = decoder.decompress(rest, most)
        rest = decoder.unconsumed_tail
        if piece:
            yield piece
        elif not rest:
            break
    tail = decoder.flush()
    if tail:
        yield tail
    if not decoder.eof:
        raise ValueError("truncated stream")
