"""Tiles as lossless WebP, read back by a plain decoder of the format."""

import struct

import numpy as np
import pytest

from quadrille.codecs.image import png
from quadrille.codecs.webp import SENT_ORDER, canonical, code_lengths, webp


class Reader:
    def __init__(self, data):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").tolist(), 0

    def take(self, n):
        out = sum(b << i for i, b in enumerate(self.bits[self.at : self.at + n]))
        assert len(self.bits) >= self.at + n
        self.at += n
        return out


def table(lengths):
    """{(length, code from its highest bit): symbol}, built by counting lengths."""
    assert sum(2.0**-n for n in lengths if n) == 1.0
    code, out = 0, {}
    for n in range(1, 16):
        for s in [s for s, k in enumerate(lengths) if k == n]:
            out[n, code] = s
            code += 1
        code <<= 1
    return out


def symbol(r, codes):
    if isinstance(codes, int):
        return codes
    code = n = 0
    while (n, code) not in codes:
        code, n = code << 1 | r.take(1), n + 1
        assert n <= 15
    return codes[n, code]


def prefix_code(r, size):
    if r.take(1):
        two, eight = r.take(1), r.take(1)
        assert not two
        return r.take(8 if eight else 1)
    lengths = [0] * 19
    for i in range(4 + r.take(4)):
        lengths[SENT_ORDER[i]] = r.take(3)
    assert r.take(1) == 0
    codes, out = table(lengths), []
    while len(out) < size:
        s = symbol(r, codes)
        out += [s] if s < 16 else [out[-1]] * (3 + r.take(2)) if s == 16 else [0] * (3 + r.take(3)) if s == 17 else [0] * (11 + r.take(7))
    assert len(out) == size
    return table(out)


def entropy_image(r, w, h, whole):
    assert r.take(1) == 0 and not (whole and r.take(1))
    green, red, blue, alpha, distance = (prefix_code(r, n) for n in (280, 256, 256, 256, 40))
    out = []
    while len(out) < w * h:
        g = symbol(r, green)
        if g < 256:
            red_, blue_, alpha_ = symbol(r, red), symbol(r, blue), symbol(r, alpha)
            out.append((red_, g, blue_, alpha_))
            continue
        k = g - 256
        n = k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + r.take((k - 2) >> 1) + 1
        back = {0: w, 1: 1}[symbol(r, distance)]
        for _ in range(n):
            out.append(out[-back])
    assert len(out) == w * h
    return np.array(out, np.int64).reshape(h, w, 4)


def decoded(data):
    assert data[:4] == b"RIFF" and struct.unpack("<I", data[4:8])[0] == len(data) - 8 and data[8:16] == b"WEBPVP8L"
    r = Reader(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    assert r.take(8) == 0x2F
    w, h = r.take(14) + 1, r.take(14) + 1
    assert r.take(4) == 1
    undo = []
    while r.take(1):
        if (kind := r.take(2)) == 2:
            undo.append(None)
        else:
            assert kind == 0
            side = 1 << (r.take(3) + 2)
            undo.append((side, entropy_image(r, -(-w // side), -(-h // side), False)[..., 1]))
    x = entropy_image(r, w, h, True)
    for step in reversed(undo):
        if step is None:
            x[..., 0] += x[..., 1]
            x[..., 2] += x[..., 1]
            x &= 255
            continue
        side, modes = step
        for i in range(h):
            for j in range(w):
                if i == 0 or j == 0:
                    guess = (0, 0, 0, 255) if i == j else x[i, j - 1] if i == 0 else x[i - 1, j]
                else:
                    left, top, corner = x[i, j - 1], x[i - 1, j], x[i - 1, j - 1]
                    guess = {1: left, 2: top, 12: np.clip(left + top - corner, 0, 255)}[modes[i // side, j // side]]
                x[i, j] = (x[i, j] + guess) & 255
    return x.astype(np.uint8)


def slope(n):
    i, j = np.mgrid[:n, :n]
    grey = ((i * 3 + j * 2 + (i * j) // 40) // 5 % 256).astype(np.uint8)
    return np.dstack([grey, grey, grey, np.full_like(grey, 255)])


NOISE = np.random.default_rng(5)
CASES = {
    "empty": np.zeros((100, 100, 4), np.uint8),
    "one pixel": np.array([[[1, 2, 3, 4]]], np.uint8),
    "one column": NOISE.integers(0, 3, (40, 1, 4)).astype(np.uint8),
    "noise": NOISE.integers(0, 256, (31, 17, 4)).astype(np.uint8),
    "slope": slope(48),
    "classes": np.repeat(np.repeat(NOISE.integers(0, 256, (6, 5, 4)), 9, 0), 11, 1).astype(np.uint8),
    "hole": np.where(np.mgrid[:40, :40].sum(0)[..., None] < 30, 0, slope(40)).astype(np.uint8),
    "two blocks": np.repeat(slope(6)[:1], 90, 1)[:, :530],
}


@pytest.mark.parametrize("name", CASES)
def test_round_trip(name):
    assert (decoded(webp(CASES[name])) == CASES[name]).all()


def test_sizes():
    assert len(webp(np.zeros((256, 256, 4), np.uint8))) < 200
    assert len(webp(slope(256))) < 0.8 * len(png(slope(256)))


def test_long_codes_are_limited():
    a, b, counts = 1, 1, []
    for _ in range(24):
        counts.append(a)
        a, b = b, a + b
    lengths = code_lengths(np.array(counts))
    assert lengths.max() <= 15 and sum(2.0**-n for n in lengths.tolist()) == 1.0
    assert len(set(zip(lengths.tolist(), canonical(lengths).tolist()))) == 24
