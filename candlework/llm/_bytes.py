"""Words and hashes of whole Arrow text columns, without a Python object for each word.

Words are found in UTF-8 bytes. All separators used here are ASCII, and every byte of a longer UTF-8 sequence is 0x80 or
above, so a byte table tells words from separators exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = 0x20
#: Bytes and rows of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES, CHUNK_ROWS = 1 << 18, 2048
#: Values that are hashed at once; a longer span is hashed alone.
_SEGMENT = 1 << 16
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _table(separators: bytes) -> bytes:
    lower = bytes(range(256)).lower()  # of bytes, this changes A-Z only
    return bytes(SPACE if b in separators else lower[b] for b in range(256))


#: ``[^\x20\x09-\x0D]+``
BLANK_SEPARATED = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased
ALPHANUMERIC = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def buffers(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return memoryview(b""), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(data) if data else memoryview(b""), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of at most CHUNK_ROWS rows and limit bytes, or of one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows, low + CHUNK_ROWS)
        yield low, high
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        if size > 4 * _SEGMENT:  # for one long span only
            return out[0], out[1]
        _powers = out[0], out[1]
    return _powers


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], whatever stands around them; spans ascend and don't overlap."""
    out, low = np.empty(len(starts), np.uint64), 0
    while low < len(starts):
        at = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, at + _SEGMENT, "right")))
        s, e = starts[low:high] - at, ends[low:high] - at
        part = values[at : at + e[-1]].astype(np.uint64)
        part += np.uint64(1)
        forward, back = powers(len(part) + 1)
        part *= forward[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        out[low:high] = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))
        low = high
    return out


class Words:
    """The words of rows low to high of a text column: bytes, starts and ends, and how many each row has."""

    def __init__(self, data: memoryview, offsets: np.ndarray, low: int, high: int, table: bytes):
        at = offsets[low : high + 1].tolist()
        rows = [bytes(data[a:b]) for a, b in zip(at, at[1:])]
        self.raw = (b" " + b" ".join(rows) + b" ").translate(table)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        inside = (self.bytes != SPACE).view(np.int8)
        edge = np.diff(inside)
        self.starts = np.flatnonzero(edge == 1) + 1
        self.ends = np.flatnonzero(edge == -1) + 1
        began = np.concatenate(([1], 1 + np.cumsum(np.diff(offsets[low : high + 1]) + 1)))
        self.bounds = np.searchsorted(self.starts, began)  # of row i: words bounds[i] to bounds[i + 1]
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.bytes, self.starts, self.ends)

    def word(self, i: int) -> str:
        return self.raw[self.starts[i] : self.ends[i]].decode("utf-8", "replace")


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of k consecutive words, from every word but the last k - 1, across rows too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, (seed * 2 + 1) * _ODD & _MASK, np.uint64)
    for j in range(k):
        total = (total ^ hashes[j : j + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
        total ^= total >> np.uint64(29)
    return mix(total)
