"""TIFF: directories and blocks, read by range, and the layout of a Cloud Optimized GeoTIFF."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Tag types and the tags that are read or written.
SHORT, LONG, ASCII, DOUBLE = 3, 4, 2, 12
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
FORMATS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
(SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, EXTRA, SAMPLE_FORMAT, SCALE, TIEPOINT, GEO_KEYS, NODATA) = (
    254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 338, 339, 33550, 33922, 34735, 42113)


def directory(read: Callable[[int, int], bytes]) -> tuple[str, dict[int, tuple]]:
    """(byte order, values by tag) of the first image, classic or of 64-bit offsets. ``read(at, n)`` gives bytes of the file."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    wide = struct.unpack_from(order + "H", head, 2)[0] == 43  # fixed value: the version of BigTIFF
    at = struct.unpack_from(order + ("Q" if wide else "I"), head, 8 if wide else 4)[0]
    count, entry, inline = ("Q", "HHQ", 8) if wide else ("H", "HHI", 4)
    first, size = struct.calcsize(order + count), struct.calcsize(order + entry) + inline
    n = struct.unpack(order + count, read(at, first))[0]
    table, tags = read(at + first, n * size), {}
    for i in range(n):
        tag, kind, many = struct.unpack_from(order + entry, table, i * size)
        if kind not in FORMATS:
            continue
        place = (i + 1) * size - inline
        if SIZES[kind] * many <= inline:
            data = table[place : place + SIZES[kind] * many]
        else:
            data = read(struct.unpack_from(order + ("Q" if wide else "I"), table, place)[0], SIZES[kind] * many)
        tags[tag] = (data.rstrip(b"\0").decode("latin-1"),) if kind == ASCII else struct.unpack(f"{order}{many}{FORMATS[kind]}", data)
    return order, tags


def first_directory(data: bytes) -> tuple[str, dict[int, tuple]]:
    """The directory of a file that is held whole."""
    return directory(lambda at, n: data[at : at + n])


def geo(tags: dict[int, tuple]) -> tuple[float, float, float, float]:
    """(origin_x, origin_y, px_w, px_h); without the tags, cells of 1 from 0."""
    if SCALE not in tags or TIEPOINT not in tags:
        return 0.0, 0.0, 1.0, 1.0
    (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIEPOINT][:5]
    return x - i * sx, y + j * sy, sx, sy


def epsg(tags: dict[int, tuple]) -> int | None:
    """The projected CRS key if there is one, else the geographic."""
    keys = tags.get(GEO_KEYS, ())
    found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    return next((found[k] for k in (3072, 2048) if found.get(k, 0) > 0), None)


def lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, widened one code early."""
    clear, end = 256, 257  # fixed values
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    out, table, width, held, bits, last = [], list(single), 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == clear:
            table, width, last = list(single), 9, None
            continue
        if code == end:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + entry[:1])
            if width < 12 and len(table) == (1 << width) - 1:
                width += 1
        out.append(entry)
        last = entry
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    """Runs: n below 128 is followed by n + 1 bytes as they are, n above 128 by one byte that stands 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 1 + (n > 128)
    return bytes(out)


#: Compression codes.
DECODERS = {1: bytes, 5: lzw, 8: zlib.decompress, 32773: packbits, 32946: zlib.decompress}


def unpredicted(raw: bytes, kind: np.dtype, shape: tuple[int, int, int], predictor: int) -> np.ndarray:
    """A block's samples: as they are (1), as differences along a row (2), or as differences of the bytes of floats, most significant first (3)."""
    rows, cols, samples = shape
    n = rows * cols * samples
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize).reshape(rows, -1, samples).cumsum(1, dtype=np.uint8)
        values = planes.reshape(rows, kind.itemsize, cols * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(values).view(kind.newbyteorder(">")).reshape(shape)
    block = np.frombuffer(raw, kind, n).reshape(shape)
    return block.cumsum(1, dtype=kind.newbyteorder("=")) if predictor == 2 else block


@dataclass(frozen=True)
class Block:
    """A strip or tile: its bytes, and the rows, columns and bands (from 0) that it holds of the grid."""

    at: int
    size: int
    row: int
    col: int
    rows: int
    cols: int
    band: int


@dataclass(frozen=True)
class Coding:
    """What a block's bytes mean."""

    compression: int
    predictor: int
    kind: str
    #: Rows (less in the last strip), columns and samples of a block as it is stored.
    shape: tuple[int, int, int]
    tiled: bool

    def decode(self, data: bytes, block: Block) -> np.ndarray:
        """(rows, cols, samples) of the grid, as float64."""
        rows = self.shape[0] if self.tiled else block.rows
        got = unpredicted(DECODERS[self.compression](data), np.dtype(self.kind), (rows, *self.shape[1:]), self.predictor)
        return got[: block.rows, : block.cols].astype(float)


def layout(order: str, tags: dict[int, tuple]) -> tuple[Coding, Iterator[Block]]:
    """How blocks are coded, and each of them; with separate planes a block holds one band."""
    one = lambda t, d: tags.get(t, (d,))[0]
    w, h, samples, coding, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    form, bits = one(SAMPLE_FORMAT, 1), one(BITS, 8)
    if coding not in DECODERS or predictor not in (1, 2, 3) or form not in (1, 2, 3) or bits not in (8, 16, 32, 64) or predictor == 2 and form == 3 or predictor == 3 and form != 3:
        raise ValueError(f"TIFF of compression {coding}, predictor {predictor}, sample format {form} and {bits} bits is not read")
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_W, w), one(TILE_H, h)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    across, down = -(-w // bw), -(-h // bh)
    held = 1 if one(PLANAR, 1) == 2 else samples

    def every() -> Iterator[Block]:
        for k, (at, n) in enumerate(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS])):
            plane, place = divmod(k, across * down)
            r, c = place // across * bh, place % across * bw
            yield Block(at, n, r, c, min(bh, h - r), min(bw, w - c), plane)

    return Coding(coding, predictor, order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8), (bh, bw, held), tiled), every()


def blocks(data: bytes):
    """(first row, first col, first band from 0, (h, w, samples) float64 array) of each strip or tile of a file that is held whole."""
    coding, every = layout(*first_directory(data))
    for b in every:
        yield b.row, b.col, b.band, coding.decode(data[b.at : b.at + b.size], b)


def geo_keys(code: int) -> list[int]:
    """Model type, pixel is area, and the CRS."""
    return [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326] if code == 4326 else [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, 3857]


def cog(levels: list[dict], meta, samples: int, float32: bool, tile_size: int, deflate: bool, nodata: str | None) -> bytes:
    """What comes before the data. levels: {rows, cols, sizes of blocks in row-major order}, full size first; their data follows, smallest level first."""
    directories = []
    for k, level in enumerate(levels):
        n = len(level["sizes"])
        entries = {
            WIDTH: (LONG, [level["cols"]]), HEIGHT: (LONG, [level["rows"]]), BITS: (SHORT, [32 if float32 else 8] * samples), COMPRESSION: (SHORT, [8 if deflate else 1]),
            PHOTOMETRIC: (SHORT, [2 if samples > 1 else 1]), SAMPLES: (SHORT, [samples]), TILE_W: (SHORT, [tile_size]), TILE_H: (SHORT, [tile_size]),
            TILE_OFFSETS: (LONG, [0] * n), TILE_COUNTS: (LONG, list(level["sizes"])), SAMPLE_FORMAT: (SHORT, [3 if float32 else 1] * samples),
        }
        if k:
            entries[SUBFILE] = (LONG, [1])
        if samples == 4:
            entries[EXTRA] = (SHORT, [2])
        if not k:
            entries[SCALE] = (DOUBLE, [meta.px_w, meta.px_h, 0.0])
            entries[TIEPOINT] = (DOUBLE, [0.0, 0.0, 0.0, meta.origin_x, meta.origin_y, 0.0])
            entries[GEO_KEYS] = (SHORT, geo_keys(int(meta.crs)))
            if nodata is not None:
                entries[NODATA] = (ASCII, nodata.encode() + b"\0")
        directories.append(entries)

    def packed(kind, values) -> bytes:
        return values if kind == ASCII else struct.pack(f"<{len(values)}{FORMATS[kind]}", *values)

    size = lambda e: 6 + 12 * len(e) + sum(len(p) + len(p) % 2 for p in (packed(*v) for v in e.values()) if len(p) > 4)
    starts = [8]
    for e in directories:
        starts.append(starts[-1] + size(e))
    at = starts[-1]
    for k in reversed(range(len(levels))):
        offsets = []
        for n in levels[k]["sizes"]:
            offsets.append(at)
            at += n
        directories[k][TILE_OFFSETS] = (LONG, offsets)
    if at >= 1 << 32:
        raise ValueError("a classic TIFF holds 4 GiB at most")
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for k, e in enumerate(directories):
        far, more = starts[k] + 6 + 12 * len(e), bytearray()
        out += struct.pack("<H", len(e))
        for tag in sorted(e):
            kind, values = e[tag]
            data = packed(kind, values)
            out += struct.pack("<HHI", tag, kind, len(values))
            if len(data) <= 4:
                out += data.ljust(4, b"\0")
            else:
                out += struct.pack("<I", far + len(more))
                more += data + b"\0" * (len(data) % 2)
        out += struct.pack("<I", starts[k + 1] if k + 1 < len(levels) else 0) + more
    return bytes(out)
