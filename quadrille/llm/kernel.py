"""Vectorised text kernels that run inside Spark tasks, on the UTF-8 bytes of an Arrow column.

All hashes are 64-bit, the same in every process, and functions of content alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that end words: white space, and everything but ASCII letters, digits and non-ASCII.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


BYTE = mixed(np.arange(1, 257, dtype=U))
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]

_powers = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        up, down = np.full(n, BASE, U), np.full(n, pow(BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and each row's start (and the end); nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """The words of a batch of texts: byte ranges, hashes, and the first word of each text (and the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def prefix_sums(raw: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Sums of table[byte] * BASE**i: any range's hash is a difference of two, brought to one place."""
    out = np.zeros(len(raw) + 1, U)
    np.cumsum(table[raw] * powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def words(raw: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE, fold: bool = False) -> Words:
    inside = ~breaks[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = at[1:-1]
    borders = borders[borders < len(raw)]
    begins[borders] = inside[borders]  # a text's first byte begins a word whatever the text before ends with
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[borders[borders > 0] - 1] = inside[borders[borders > 0] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_sums(raw, FOLDED if fold else BYTE)
    hashes = mixed((sums[end] - sums[start]) * powers(len(raw) + 1)[1][start] + (end - start).astype(U))
    return Words(start, end, hashes, np.searchsorted(start, at))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n hashes; the last n - 1 places have none."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, U)
    for i in range(n):
        out = out * U(BASE) + hashes[i : i + count]
    return mixed(out)


def shingle_sets(w: Words, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; of fewer words, the whole sequence as one."""
    every = windows(w.hash, n)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            short = U(b - a)
            for h in w.hash[a:b]:
                short = U((int(short) * BASE + int(h)) & (2**64 - 1))
            out.append(mixed(np.array([short], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def pieces(batches, column: str = "text", most_bytes: int = 2 << 20):
    """The batches, cut so that each holds at most so many bytes of text, or one row."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        row = 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(at, at[row] + most_bytes, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end
