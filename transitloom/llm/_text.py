"""Byte-level batch helpers shared by the text operators.

Texts reach Python as Arrow batches.  `chunks` cuts a batch into pieces of bounded size, and `Text` holds such a
piece as one byte array with a separator after each document, so that words, word hashes and n-gram hashes are
computed for all its documents at once.  Hashes are 64-bit polynomials over random byte values, passed through a
finaliser; equal strings have equal hashes on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_M = (1 << 64) - 1
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(keep) -> np.ndarray:
    """A 256-entry truth table of the bytes that belong to words."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
ALNUM = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
IDENTITY = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            up, down = np.uint64(pow(self.base, k, 1 << 64)), np.uint64(pow(self.inverse, k, 1 << 64))
            self.up = np.concatenate([self.up, self.up * up])
            self.down = np.concatenate([self.down, self.down * down])
        return self.up[:n], self.down[:n]


_P_POWERS, _Q_POWERS = _Powers(_P), _Powers(_Q)


class Sums:
    """Prefix sums of a sequence of symbols; hashes of its slices in O(1)."""

    def __init__(self, symbols: np.ndarray, powers: _Powers = _P_POWERS):
        up, self.down = powers.get(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def byte_sums(data: np.ndarray) -> Sums:
    return Sums(_BYTE[data])


class Text:
    """Documents as one byte array: document i is data[start[i]:end[i]], and data[end[i]] is a line feed."""

    def __init__(self, texts: pa.Array):
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        n = len(texts)
        if n == 0:
            self.data, off = np.zeros(0, np.uint8), np.zeros(1, np.int64)
            raw = self.data
        else:
            wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
            _, offsets, values = texts.buffers()
            off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
            raw = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
        size = np.diff(off)
        self.n = n
        self.start = np.arange(n, dtype=np.int64) + (off[:-1] - off[0])
        self.end = self.start + size
        self.data = np.full(int(size.sum()) + n, 10, dtype=np.uint8)
        for a, b, o in zip(self.start.tolist(), self.end.tolist(), off[:-1].tolist(), strict=True):
            self.data[a:b] = raw[o : o + b - a]

    def words(self, keep: np.ndarray, fold: np.ndarray = IDENTITY) -> Words:
        return Words(self, keep, fold)


class Words:
    """Words of a Text: start and end of each, and per document the range first[i]:first[i + 1] of its words."""

    def __init__(self, text: Text, keep: np.ndarray, fold: np.ndarray):
        self.text = text
        self.data = text.data if fold is IDENTITY else fold[text.data]
        inside = keep[self.data].view(np.int8)
        edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.append(np.searchsorted(self.start, text.start), len(self.start))
        self._hash = self._sums = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = byte_sums(self.data).of(self.start, self.end)
        return self._hash

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.text.n), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (word numbers) where n words of one document begin, and the hashes of those n words."""
        if self._sums is None:
            self._sums = Sums(self.hash, _Q_POWERS)
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))
        at = np.flatnonzero(room >= n)
        return at, self._sums.of(at, at + n)

    def whole(self) -> np.ndarray:
        """Per document the hash of its whole word sequence."""
        if self._sums is None:
            self._sums = Sums(self.hash, _Q_POWERS)
        return self._sums.of(self.first[:-1], self.first[1:])

    def strings(self, a: int, b: int) -> bytes:
        """Words a to b of the chunk, joined by single spaces."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES):
    """Slices of a batch that hold at most `size` bytes of text, or one longer document."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs(flags_at: np.ndarray, width: np.ndarray | int, size: int) -> np.ndarray:
    """A mask of `size` positions covered by spans that begin at `flags_at` and are `width` long."""
    step = np.zeros(size + 1, dtype=np.int32)
    np.add.at(step, flags_at, 1)
    np.add.at(step, flags_at + width, -1)
    return np.cumsum(step[:-1]) > 0
