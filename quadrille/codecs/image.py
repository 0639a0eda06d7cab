"""PNG of RGBA pixels, and colour ramps."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def png(rgba: np.ndarray) -> bytes:
    """An (h, w, 4) uint8 array as PNG, rows unfiltered."""
    h, w, _ = rgba.shape
    raw = np.zeros((h, 1 + 4 * w), np.uint8)
    raw[:, 1:] = rgba.reshape(h, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


#: Own colour ramps, from low to high; drawn out linearly between the stops.
RAMPS = {
    "grayscale": ["#000000", "#ffffff"],
    "terrain": ["#2b6f3e", "#a8c66c", "#e8d9a0", "#a9784a", "#ffffff"],
    "ndvi": ["#8c510a", "#f6e8c3", "#5ab45a", "#00441b"],
    "imhof": ["#7aa68f", "#d8dcb4", "#eec49a", "#d8a392", "#f4f0ee"],
    "viridis": ["#440154", "#3b528b", "#21908c", "#5dc863", "#fde725"],
    "magma": ["#000004", "#51127c", "#b6377a", "#fb8861", "#fcfdbf"],
    "inferno": ["#000004", "#56106e", "#bb3754", "#f98c0a", "#fcffa4"],
    "plasma": ["#0d0887", "#7e03a8", "#cc4778", "#f89441", "#f0f921"],
    "heat": ["#000000", "#b30000", "#ff8000", "#ffff80", "#ffffff"],
    "water": ["#f7fbff", "#6baed6", "#08306b"],
    "bathymetry": ["#08306b", "#4292c6", "#deebf7"],
    "bluered": ["#2166ac", "#f7f7f7", "#b2182b"],
    "spectral": ["#5e4fa2", "#66c2a5", "#ffffbf", "#f46d43", "#9e0142"],
    "greens": ["#f7fcf5", "#74c476", "#00441b"],
    "browns": ["#fff7bc", "#d95f0e", "#662506"],
    "rainbow": ["#0000ff", "#00ffff", "#00ff00", "#ffff00", "#ff0000"],
}


def coloured(values: np.ndarray, lo: float, hi: float, scheme: str = "grayscale") -> np.ndarray:
    """RGBA of values; NaN is transparent."""
    stops = np.array([[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in RAMPS[scheme.lower()]], float)
    share = np.clip((values - lo) / ((hi - lo) or 1.0), 0, 1)
    out = np.zeros((*values.shape, 4), np.uint8)
    for k in range(3):
        out[..., k] = np.nan_to_num(np.interp(share, np.linspace(0, 1, len(stops)), stops[:, k])).round()
    out[..., 3] = np.where(np.isnan(values), 0, 255)
    out[np.isnan(values)] = 0
    return out
