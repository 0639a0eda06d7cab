"""Lossless WebP of RGBA pixels: green subtracted, neighbours predicted, runs copied, Huffman codes per channel."""

from __future__ import annotations

import heapq
import struct

import numpy as np

LONGEST_CODE = 15
LONGEST_COPY = 4096
SHORTEST_COPY = 4
#: The format's numbers of the predictors left, top, and clamped left + top - top left.
LEFT, TOP, CLAMPED = 1, 2, 12
#: Fixed value: the order in which the format sends the lengths of the code of code lengths.
SENT_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The code of code lengths is the same for every tile: four bits, or five for lengths that are rare; 16 is unused.
LENGTH_CODE = np.array([4] * 12 + [5] * 4 + [0, 4, 4])


class Bits:
    """Values of given widths, sent from the lowest bit."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []

    def put(self, values, widths):
        values, widths = np.broadcast_arrays(np.asarray(values, np.int64), np.asarray(widths, np.int64))
        self.values.append(values.ravel())
        self.widths.append(widths.ravel())

    def bytes(self) -> bytes:
        values, widths = np.concatenate(self.values), np.concatenate(self.widths)
        ends = np.cumsum(widths)
        place = np.arange(ends[-1]) - np.repeat(ends - widths, widths)
        return np.packbits(((np.repeat(values, widths) >> place) & 1).astype(np.uint8), bitorder="little").tobytes()


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most LONGEST_CODE bits; a single symbol has length 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    weights = counts.astype(np.int64)
    while True:
        heap = [(int(weights[s]), int(s), [int(s)]) for s in used]
        heapq.heapify(heap)
        lengths[:] = 0
        while len(heap) > 1:
            (a, first, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            lengths[left + right] += 1
            heapq.heappush(heap, (a + b, first, left + right))
        if lengths.max() <= LONGEST_CODE:
            return lengths
        weights = np.where(weights > 0, weights // 2 + 1, 0)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol, with the bits turned round since a code is sent from its highest bit."""
    codes, code, before = np.zeros(len(lengths), np.int64), 0, 0
    for symbol in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        n = int(lengths[symbol])
        code <<= n - before
        codes[symbol] = int(f"{code:0{n}b}"[::-1], 2)
        code, before = code + 1, n
    return codes


def _put_code(bits: Bits, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sends the prefix code for these counts; (codes, widths) by symbol."""
    used = np.flatnonzero(counts)
    if len(used) < 2:  # a simple code of one symbol of 8 bits: its uses take no bits
        bits.put([1, 0, 1, used[0] if len(used) else 0], [1, 1, 1, 8])
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    lengths = code_lengths(counts)
    bits.put([0, len(SENT_ORDER) - 4], [1, 4])
    bits.put(LENGTH_CODE[list(SENT_ORDER)], 3)
    bits.put(0, 1)  # lengths of all symbols follow
    sent, at = canonical(LENGTH_CODE), 0
    while at < len(lengths):
        zeros = 0
        while at + zeros < len(lengths) and zeros < 138 and lengths[at + zeros] == 0:
            zeros += 1
        if zeros >= 11:
            bits.put([sent[18], zeros - 11], [LENGTH_CODE[18], 7])
        elif zeros >= 3:
            bits.put([sent[17], zeros - 3], [LENGTH_CODE[17], 3])
        else:
            zeros = 1
            bits.put(sent[lengths[at]], LENGTH_CODE[lengths[at]])
        at += zeros
    return canonical(lengths), lengths


def _run_lengths(same: np.ndarray) -> np.ndarray:
    """How many True follow from each place on."""
    place = np.arange(len(same))
    stop = np.where(same, len(same), place)
    return np.minimum.accumulate(stop[::-1])[::-1] - place


def _copies(pixels: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(place, length, distance symbol) of runs equal to the pixel to the left (1) or to the row above (0)."""
    left, above = np.zeros(len(pixels), bool), np.zeros(len(pixels), bool)
    left[1:] = pixels[1:] == pixels[:-1]
    above[width:] = pixels[width:] == pixels[:-width]
    runs = np.stack([_run_lengths(above), _run_lengths(left)])
    longest = runs.max(0)
    out, at = [], 0
    for place in np.flatnonzero(longest >= SHORTEST_COPY).tolist():
        if place >= at:
            n = min(int(longest[place]), LONGEST_COPY)
            out.append((place, n, int(runs[:, place].argmax())))
            at = place + n
    return out


def _put_image(bits: Bits, rgba: np.ndarray, whole: bool):
    """Sends pixels with codes of their own; only a ``whole`` image says that it has one set of codes."""
    h, w, _ = rgba.shape
    flat = rgba.reshape(-1, 4)
    copies = np.array(_copies(np.ascontiguousarray(flat).view(np.uint32).ravel(), w), np.int64).reshape(-1, 3)
    place, n, distance = copies.T
    covered = np.zeros(len(flat) + 1, np.int64)
    np.add.at(covered, place, 1)
    np.add.at(covered, place + n, -1)
    literal = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    # a copy's length less one as a prefix symbol with bits behind it
    d = n - 1
    top = np.where(d > 3, np.floor(np.log2(np.maximum(d, 1))).astype(np.int64), 1)
    symbol = 256 + np.where(d > 3, 2 * top + ((d >> (top - 1)) & 1), d)
    spare = np.where(d > 3, top - 1, 0)
    green, red, blue, alpha = (flat[literal, c].astype(np.int64) for c in (1, 0, 2, 3))
    bits.put([0, 0], [1, 1]) if whole else bits.put(0, 1)  # no colour cache; one set of codes
    sizes = (280, 256, 256, 256, 40)
    streams = (np.concatenate([green, symbol]), red, blue, alpha, distance)
    (gc, gw), (rc, rw), (bc, bw), (ac, aw), (dc, dw) = (_put_code(bits, np.bincount(s, minlength=size)) for s, size in zip(streams, sizes))
    values = np.concatenate([
        np.stack([gc[green], rc[red], bc[blue], ac[alpha]], 1),
        np.stack([gc[symbol], d & ((1 << spare) - 1), dc[distance], 0 * d], 1),
    ])
    widths = np.concatenate([np.stack([gw[green], rw[red], bw[blue], aw[alpha]], 1), np.stack([gw[symbol], spare, dw[distance], 0 * d], 1)])
    order = np.argsort(np.concatenate([literal, place]))
    bits.put(values[order], widths[order])


def _residual(rgba: np.ndarray, mode: int) -> np.ndarray:
    """Pixels less their prediction; the first row is predicted from the left, the first column from above."""
    x = rgba.astype(np.int64)
    guess = np.zeros_like(x)
    guess[0, 0] = (0, 0, 0, 255)
    guess[0, 1:] = x[0, :-1]
    guess[1:, 0] = x[:-1, 0]
    left, top = x[1:, :-1], x[:-1, 1:]
    guess[1:, 1:] = left if mode == LEFT else top if mode == TOP else np.clip(left + top - x[:-1, :-1], 0, 255)
    return ((x - guess) & 255).astype(np.uint8)


def _entropy(rgba: np.ndarray) -> float:
    counts = np.stack([np.bincount(rgba[..., c].ravel(), minlength=256) for c in range(4)])
    share = counts[counts > 0] / rgba[..., 0].size
    return float(-(share * np.log2(share)).sum())


def webp(rgba: np.ndarray) -> bytes:
    """An (h, w, 4) uint8 array as lossless WebP, with the predictor that leaves least, or none."""
    h, w, _ = rgba.shape
    plain = rgba.copy()
    plain[..., [0, 2]] -= rgba[..., [1]]
    guessed = {mode: _residual(plain, mode) for mode in (LEFT, TOP, CLAMPED)}
    best = min(guessed, key=lambda mode: _entropy(guessed[mode]))
    found = []
    for mode in (None, best):
        bits = Bits()
        bits.put([0x2F, w - 1, h - 1, 1, 0], [8, 14, 14, 1, 3])  # alpha is used; version 0
        bits.put([1, 2], [1, 2])  # green is subtracted
        if mode is not None:
            bits.put([1, 0, 7], [1, 2, 3])  # one predictor for each block of 512 x 512 pixels
            modes = np.zeros((-(-h // 512), -(-w // 512), 4), np.uint8)
            modes[..., 1] = mode
            _put_image(bits, modes, whole=False)
        bits.put(0, 1)
        _put_image(bits, plain if mode is None else guessed[mode], whole=True)
        found.append(bits.bytes())
    data = min(found, key=len)
    padded = data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + padded
