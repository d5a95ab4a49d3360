"""Words, word hashes and word n-gram hashes of whole Arrow batches in NumPy.

A text column's UTF-8 buffer is scanned as one byte array: no Python object per short word. A word's hash folds eight
bytes at a time through a bijective mixer, so that words of up to eight bytes and one length never collide; long words
are digested by BLAKE2b. Hashes of word n-grams are polynomials of these modulo 2**64. Equal words always have equal
hashes; callers that need the converse verify the words themselves or a digest of them (see digests).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the n-gram polynomials.
GRAM_BASE = 0xD6E8FEB86659FD93 | 1
#: Bytes from which a word is digested by itself.
LONG_WORD = 64
#: Bytes of text that are scanned at once; a longer document is scanned alone.
BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]; all bytes of characters beyond ASCII are 0x80 or more.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def up(b: int) -> np.ndarray:
        p = np.full(size, b, U64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return up(base), up(pow(base, -1, 1 << 64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    up, down = _powers(base, 1 << max(16, n.bit_length()))
    return up[: n + 1], down[: n + 1]


def runs(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """The polynomial hash of each k consecutive values."""
    n = len(values)
    if n < k:
        return np.empty(0, U64)
    up, down = powers(base, n)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + U64(k))


@dataclass
class Words:
    """Words of a block: byte spans in data, the row of each, where each row's words begin and its bytes (one more than rows)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        size = self.end - self.start
        out = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
        at = np.ndarray((len(self.data) + 1,), "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
        left = np.flatnonzero(size <= LONG_WORD)
        lane = 0
        while len(left):
            rest = size[left] - lane
            cut = U64(8) * np.maximum(8 - rest, 0).astype(U64)
            part = at[self.start[left] + lane] << cut
            out[left] = mix(out[left] ^ part)
            lane += 8
            left = left[rest > 8]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        return out

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, as bytes, and where in them each word begins and ends."""
        size = self.end - self.start
        stop = np.cumsum(size + 1) - 1
        begin = stop - size
        out = np.full(int(stop[-1]) + 1 if len(stop) else 0, 0x20, np.uint8)
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.start] = 1
        edge[self.end] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        blank = np.zeros(len(out), bool)
        blank[stop] = True
        out[~blank] = self.data[inside]
        return out.tobytes(), begin, stop

    def grams(self, hashes: np.ndarray, k: int, base: int = GRAM_BASE) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position on, and whether they are of one row."""
        return runs(hashes, k, base), self.row[: max(0, len(self.row) - k + 1)] == self.row[k - 1 :]

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b]))


def scan(text: pa.Array, keep: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    text = pc.fill_null(text, "") if text.null_count else text
    wide = pa.types.is_large_string(text.type)
    off = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    off = off - off[0]
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = keep[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[1:-1][cut]
    ends[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    return Words(data, start, end, np.repeat(np.arange(len(off) - 1), np.diff(first)), first, off)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about size bytes of text each, one row at least: bounds memory, drops nothing."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.concatenate([[0], np.cumsum(n)]), 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """An Arrow list for each row of values that are ordered by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), pa.array(values, kind))
