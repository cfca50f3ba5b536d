"""Vectorised word and shingle hashing over Arrow text columns.

Everything here works on the UTF-8 bytes of a block of documents at once.  A
word is a maximal run of bytes other than 0x20 and 0x09-0x0D, the byte form of
``[^\\x20\\x09-\\x0D]+``; those separators never occur inside a multi-byte
character.  A block is a slice of an Arrow batch whose texts together stay near
``BLOCK_BYTES`` (one longer text makes a block of its own), so the temporaries
are bounded by the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_ODD = 0x9E3779B97F4A7C15
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def _byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(seed))


class Powers:
    """Powers of an odd radix and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, radix: int):
        self.radix, self.inverse = radix, pow(radix, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, min(2 * len(self.up), BLOCK_BYTES + 1))
            base = np.full(size, self.radix, np.uint64)
            base[0] = 1
            self.up = np.cumprod(base, dtype=np.uint64)
            base[1:] = self.inverse
            self.down = np.cumprod(base, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_BYTE_POWERS = Powers(0xD6E8FEB86659FD93)
_WORD_POWERS = Powers(0xA0761D6478BD642F)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batches, text: str = "text"):
    """Slices of record batches with about BLOCK_BYTES of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8_buffers(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


class Words:
    """The words of a block: byte spans, the row of each, and row offsets."""

    def __init__(self, column: pa.Array, seed: int = 0, lower: bool = False):
        self.data, self.rows = utf8_buffers(column)
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.bytes = data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~_SEPARATOR[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[self.rows] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut) & np.append(inside[1:-1], False))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.first = np.searchsorted(self.starts, self.rows)
        self.counts = np.diff(self.first)
        self._hash: dict[int, np.ndarray] = {}

    def hashes(self, seed: int = 0) -> np.ndarray:
        if seed not in self._hash:
            up, down = _BYTE_POWERS.upto(len(self.bytes) + 1)
            total = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum(_byte_table(seed)[self.bytes] * up[:-1], out=total[1:])
            value = (total[self.ends] - total[self.starts]) * down[self.starts]
            self._hash[seed] = mix64(value)
        return self._hash[seed]

    def spans(self, seed: int = 0) -> SpanHash:
        return SpanHash(self.hashes(seed))


class SpanHash:
    """Hashes of any span of a sequence in constant time, equal for equal spans."""

    def __init__(self, values: np.ndarray):
        up, self.down = _WORD_POWERS.upto(len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix64((self.total[start + length] - self.total[start]) * self.down[start] + np.asarray(length).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values, by doubling."""
    have, out = 1, values
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    if have < width:
        out = np.minimum(out[: len(values) - width + 1], out[width - have :])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated integer ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    out = np.ones(total, np.int64)
    out[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    out[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
