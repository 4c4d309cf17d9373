"""Byte-level BPE over whole text columns: each distinct pre-token is encoded once by the tokenizers library.

A text's pieces are those of its pre-tokens one after another, so encoding a pre-token once and looking it up afterwards
gives the library's own ids. Pre-tokens are found here on arrays of code points by the published byte-level pattern
(contractions, an optional space before a run of letters, numbers or other signs, white space up to the last). Texts with
characters outside the class table, or with a special token's string, go through the library as a whole.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from candlework.llm._bytes import buffers, chunks, span_hashes

CHUNK_BYTES = 1 << 18
#: Distinct pre-tokens that a worker remembers, 60 MB at most; beyond that it starts anew, which costs time but changes no result.
MOST_KNOWN = 800_000
_SLOTS = 1 << 21
_OTHER, _LETTER, _NUMBER, _BLANK, _UNKNOWN = range(5)
_END = 0x20000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(_END + 1, _OTHER, np.uint8)
    for c in range(_END):
        kind = unicodedata.category(chr(c))
        out[c] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _UNKNOWN if kind in ("Cn", "Cs") else _OTHER
    # The Unicode property White_Space
    for low, high in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[low : high + 1] = _BLANK
    out[_END] = _UNKNOWN
    return out


def pretoken_starts(points: np.ndarray, kinds: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """First code points of all pre-tokens. kinds: the points' classes; begun: first point of each text that has any."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    start[begun] = True
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    first = np.zeros(n + 1, bool)
    first[begun] = True
    first[n] = True
    # White space before something else: its last character stands alone, or belongs to what follows if it is a space.
    blank = (kinds[runs] == _BLANK) & ~first[ends]
    last, after = ends[blank] - 1, ends[blank]
    start[last] = True
    start[after[points[last] == 0x20]] = False
    # Contractions: an apostrophe by itself, right before letters.
    quote = runs[(points[runs] == 0x27) & (ends - runs == 1) & ~first[ends] & start[runs]]
    quote = quote[kinds[quote + 1] == _LETTER] if len(quote) else quote
    if len(quote):
        one = points[quote + 1]
        padded = np.append(points, [0, 0])
        two = np.where(first[np.minimum(quote + 2, n)], 0, padded[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((quote[short], 2), (quote[long], 3)):
            start[at + 1] = False
            start[(at + size)[at + size < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes columns of texts by one tokenizer."""

    def __init__(self, library: Tokenizer):
        self.library = library
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.kinds = _classes()
        self._forget()

    def _forget(self) -> None:
        self.slots = np.zeros(_SLOTS, np.uint64)
        self.entry = np.zeros(_SLOTS, np.int32)
        self.mask = _SLOTS - 1
        self.known = 0
        self.counts = np.zeros(1 << 16, np.int32)
        self.offsets = np.zeros(1 << 16, np.uint32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 where one isn't known."""
        out = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        at = (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            seen = self.slots[at]
            hit = seen == hashes[left]
            out[left[hit]] = self.entry[at[hit]]
            more = ~hit & (seen != 0)
            left, at = left[more], (at[more] + 1) & self.mask
        return out

    def _put(self, hashes: np.ndarray, first: int) -> None:
        slots, entry, mask = self.slots, self.entry, self.mask
        for k, h in enumerate(hashes.tolist()):
            at = h & mask
            while slots[at]:
                at = (at + 1) & mask
            slots[at] = h
            entry[at] = first + k

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if 2 * (self.known + len(texts)) > len(self.slots):  # one text with very many pre-tokens
            full = np.flatnonzero(self.slots)
            old = self.slots[full][np.argsort(self.entry[full])]
            size = 1 << (4 * (self.known + len(texts))).bit_length()
            self.slots, self.entry, self.mask = np.zeros(size, np.uint64), np.zeros(size, np.int32), size - 1
            self._put(old, 0)
        if self.known + len(texts) > len(self.counts):
            grow = max(len(self.counts) * 2, self.known + len(texts))
            self.counts, self.offsets = np.resize(self.counts, grow), np.resize(self.offsets, grow)
        for low in range(0, len(texts), 4096):
            part = texts[low : low + 4096]
            got = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            counts = np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))
            if self.used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + len(ids)))
            self.ids[self.used : self.used + len(ids)] = ids
            self.counts[self.known : self.known + len(part)] = counts
            self.offsets[self.known : self.known + len(part)] = self.used + np.cumsum(counts) - counts
            self._put(hashes[low : low + 4096], self.known)
            self.used += len(ids)
            self.known += len(part)

    def pretokens(self, data: memoryview, offsets: np.ndarray, low: int, high: int):
        """Entries of the pre-tokens of rows low to high, their bounds by row, and the rows left to the library."""
        raw = bytes(data[offsets[low] : offsets[high]])
        points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        leads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        bounds = leads[offsets[low : high + 1] - offsets[low]]
        kinds = self.kinds[np.minimum(points, _END)]
        begun = bounds[:-1][bounds[:-1] < bounds[1:]]
        starts = pretoken_starts(points, kinds, begun)
        hashes = span_hashes(points, starts, np.append(starts[1:], len(points)))
        hashes[hashes == 0] = 1
        if self.known > MOST_KNOWN:
            self._forget()
        entries = self._find(hashes)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            where = missing[where]
            text = points.tobytes()
            ends = np.append(starts[1:], len(points))
            self._learn(new, [text[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(starts[where].tolist(), ends[where].tolist())])
            entries[missing] = self._find(hashes[missing])
        of_row = np.searchsorted(starts, bounds)
        odd = set((np.searchsorted(bounds, np.flatnonzero(kinds == _UNKNOWN), "right") - 1).tolist())
        if any(s in raw for s in self.special):
            at = offsets[low : high + 1].tolist()
            odd |= {i for i, (a, b) in enumerate(zip(at, at[1:])) if any(s in bytes(data[a:b]) for s in self.special)}
        return entries, of_row, sorted(odd)

    def whole(self, data: memoryview, offsets: np.ndarray, row: int) -> list[int]:
        return self.library.encode(bytes(data[offsets[row] : offsets[row + 1]]).decode("utf-8", "replace"), add_special_tokens=False).ids

    def encode(self, data: memoryview, offsets: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        """The ids of each row from low to high."""
        entries, of_row, odd = self.pretokens(data, offsets, low, high)
        counts = self.counts[entries].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(ends[-1]) + np.repeat(self.offsets[entries].astype(np.int64) - ends[:-1], counts)
        ids = self.ids[at]
        cut = ends[of_row]
        rows = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        for i in odd:
            rows[i] = np.array(self.whole(data, offsets, low + i), np.uint32)
        return rows

    def count(self, data: memoryview, offsets: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many pieces each row from low to high has: its pre-tokens' frequencies times their pieces."""
        entries, of_row, odd = self.pretokens(data, offsets, low, high)
        row = np.repeat(np.arange(high - low), np.diff(of_row))
        pair = np.sort(row * self.known + entries)
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(pair)))
        row, entry = np.divmod(pair[first], max(self.known, 1))
        out = np.bincount(row, weights=times * self.counts[entry], minlength=high - low).astype(np.int64)
        for i in odd:
            out[i] = len(self.whole(data, offsets, low + i))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This worker's encoder for a public tokenizer or a path to a tokenizers file.

    The file must be byte-level BPE by the published pattern, without a normalizer. What tasks have learned stays with the
    worker, since learning a pre-token costs some 10 microseconds and most recur.
    """
    if name not in _encoders:
        library = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        made = json.loads(library.to_str())
        split = made["pre_tokenizer"] or {}
        if made["normalizer"] or made["model"]["type"] != "BPE" or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"{name} isn't plain byte-level BPE")
        _encoders[name] = Encoder(library)
    return _encoders[name]


def texts(column, limit: int = CHUNK_BYTES):
    """Buffers of a column with the row ranges to work on."""
    data, offsets = buffers(column)
    for low, high in chunks(offsets, limit):
        yield data, offsets, low, high
