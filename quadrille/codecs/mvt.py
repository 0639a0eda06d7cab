"""Mapbox Vector Tiles: a protobuf writer of the few fields that tiles need, and a reader of them.

A layer is made of partial layers that can be merged: features with their tags as numbers into
dictionaries of keys and values of their own. At the end the features are put in order and the
dictionaries numbered anew by first use, so the bytes do not depend on how features were dealt out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field as own

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Features, or values, whose bytes are put together at a time.
PIECE = 50_000
#: A part of so many points is encoded by numpy.
MANY_POINTS = 24


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value) -> bytes:
    """A varint field, or a length-delimited one for bytes."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def varints(values: np.ndarray) -> bytes:
    """Whole numbers one after another."""
    values = values.astype(np.uint64)
    groups = values[:, None] >> np.arange(0, 70, 7, dtype=np.uint64).clip(max=63) & np.uint64(127)
    groups[:, 9] = values >> np.uint64(63)
    more = np.cumsum(groups[:, ::-1] != 0, 1)[:, ::-1] > 0  # something stands at or above this group
    more[:, 0] = True
    last = more & ~np.append(more[:, 1:], np.zeros((len(values), 1), bool), 1)
    return (groups + np.where(last, np.uint64(0), np.uint64(128))).astype(np.uint8)[more].tobytes()


def varint_sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of each of them."""
    return 1 + sum((values >= 1 << k).astype(np.int64) for k in range(7, 63, 7))


def put(out: np.ndarray, places: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> None:
    """Writes pieces that follow each other in ``data`` to places of their own."""
    out[np.repeat(places - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))] = data


def raw_bytes(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bytes) of a column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.diff(at), np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the elements of runs."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def delimited(number: int, column: pa.BinaryArray) -> Iterator[bytes]:
    """A length-delimited field of each value, number below 16."""
    for low in range(0, len(column), PIECE):
        sizes, data = raw_bytes(column.slice(low, PIECE))
        head = varint_sizes(sizes)
        whole = 1 + head + sizes
        at = np.cumsum(whole) - whole
        out = np.empty(int(whole.sum()), np.uint8)
        out[at] = number << 3 | 2
        put(out, at + 1, head, np.frombuffer(varints(sizes), np.uint8))
        put(out, at + 1 + head, sizes, data)
        yield out.tobytes()


def by_first_use(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes in order of their first use, the number of each code in that order)."""
    first = np.full(n, len(codes))
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    used = np.argsort(first, kind="stable")[: int((first < len(codes)).sum())]
    number = np.zeros(n, np.int64)
    number[used] = np.arange(len(used))
    return used, number


def merged_layer(name: str, partials: pa.Table, extent: int) -> bytes:
    """A layer's message from partial layers, a row each: orders, heads, tag_counts, tags, bodies, keys and values.
    The bytes are those of ``Partial.message``; features stay columns of bytes and never become objects."""
    lists = {c: partials.column(c).combine_chunks() for c in ("orders", "heads", "tag_counts", "tags", "bodies", "keys", "values")}
    flat = {c: x.flatten() for c, x in lists.items()}
    sizes = {c: pc.list_value_length(lists[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tags", "keys", "values")}
    tags, pairs = flat["tags"].to_numpy().astype(np.int64), flat["tag_counts"].to_numpy().astype(np.int64) // 2
    order = np.argsort(flat["orders"].to_numpy(), kind="stable")
    turn = ragged((np.cumsum(pairs) - pairs)[order], pairs[order])
    numbers, spelled = np.empty(2 * len(turn), np.int64), []
    for k, c in enumerate(("keys", "values")):
        coded = flat[c].cast(pa.binary()).dictionary_encode()
        base = np.repeat(np.cumsum(sizes[c]) - sizes[c], sizes["tags"] // 2)
        codes = coded.indices.to_numpy()[base + tags[k::2]][turn]
        used, number = by_first_use(codes, len(coded.dictionary))
        numbers[k::2] = number[codes]
        spelled.append(coded.dictionary.take(pa.array(used)))
        del coded, base, codes
    pairs, done, out = pairs[order], 0, [field(1, name.encode())]
    for low in range(0, len(order), PIECE):
        own = pa.array(order[low : low + PIECE])
        (head, heads), (body, bodies) = raw_bytes(flat["heads"].take(own)), raw_bytes(flat["bodies"].take(own))
        many = 2 * pairs[low : low + PIECE]
        told = numbers[done : done + int(many.sum())]
        done += len(told)
        ends = np.concatenate([[0], np.cumsum(varint_sizes(told))])
        size = ends[np.cumsum(many)] - ends[np.cumsum(many) - many]
        lead = np.where(size > 0, 1 + varint_sizes(size), 0)
        inner = head + lead + size + body
        first = 1 + varint_sizes(inner)
        at = np.cumsum(first + inner) - first - inner
        data = np.empty(int((first + inner).sum()), np.uint8)
        data[at] = 2 << 3 | 2
        put(data, at + 1, first - 1, np.frombuffer(varints(inner), np.uint8))
        put(data, at + first, head, heads)
        some = size > 0
        data[(at + first + head)[some]] = 2 << 3 | 2
        put(data, (at + first + head + 1)[some], lead[some] - 1, np.frombuffer(varints(size[some]), np.uint8))
        put(data, at + first + head + lead, size, np.frombuffer(varints(told), np.uint8))
        put(data, at + first + head + lead + size, body, bodies)
        out.append(data.tobytes())
    return b"".join([*out, *delimited(3, spelled[0]), *delimited(4, spelled[1]), field(5, extent), field(15, 2)])


def commands(kind: str, parts: list[np.ndarray]) -> bytes:
    """Geometry commands: moves, lines and closed rings, in zigzag differences. A part: points as rows of x and y."""
    if "Point" in kind:
        parts = [np.concatenate(parts)] if len(parts) > 1 else parts
    out, at = bytearray(), (0, 0)
    for part in parts:
        n = len(part)
        head = (varint(n << 3 | 1), b"") if "Point" in kind else (varint(1 << 3 | 1), varint(n - 1 << 3 | 2))
        if n >= MANY_POINTS:
            steps = np.diff(np.asarray(part, np.int64), axis=0, prepend=[at]).ravel()
            steps = (steps << 1) ^ (steps >> 63)
            moved = [varints(steps[:2]), varints(steps[2:])]
            at = tuple(map(int, part[-1]))
        else:
            moved, (px, py) = [bytearray(), bytearray()], at
            for k, (x, y) in enumerate(np.asarray(part).tolist()):
                for d in (x - px, y - py):
                    moved[k > 0] += varint(d << 1 ^ d >> 63)
                px, py = x, y
            at = px, py
        out += head[0] + moved[0] + head[1] + moved[1]
        if "Polygon" in kind:
            out += varint(1 << 3 | 7)
    return bytes(out)


def value(prop: dict) -> bytes | None:
    """A property's value message; None for null."""
    kind = prop["t"]
    if kind == "Bool":
        return field(7, int(prop["b"]))
    if kind == "Int":
        return field(4, prop["i"] & (1 << 64) - 1)
    if kind == "Float":
        return varint(3 << 3 | 1) + struct.pack("<d", prop["d"])
    return field(1, prop["s"].encode()) if kind == "String" else None


@dataclass
class Partial:
    """Some features of a layer: (order, message before the tags, tags, message after them)."""

    keys: dict[str, int] = own(default_factory=dict)
    values: dict[bytes, int] = own(default_factory=dict)
    features: list[tuple[int, bytes, list[int], bytes]] = own(default_factory=list)

    def add(self, order: int, ident: int | None, kind: str, parts: list[np.ndarray], props: list[dict] | None) -> None:
        tags = []
        for p in props or ():
            if (v := value(p)) is not None:
                tags += [self.keys.setdefault(p["k"], len(self.keys)), self.values.setdefault(v, len(self.values))]
        number = 1 if "Point" in kind else 2 if "Line" in kind else 3
        self.features.append((order, b"" if ident is None else field(1, ident), tags, field(3, number) + field(4, commands(kind, parts))))

    def merge(self, keys: list[str], values: list[bytes], features: Iterator[tuple[int, bytes, list[int], bytes]]) -> None:
        """Takes in another's features, whose tags are numbers into its keys and values."""
        of = [self.keys.setdefault(k, len(self.keys)) for k in keys], [self.values.setdefault(v, len(self.values)) for v in values]
        self.features += [(order, head, [of[i & 1][t] for i, t in enumerate(tags)], rest) for order, head, tags, rest in features]

    def message(self, name: str, extent: int) -> bytes:
        names, spelled = list(self.keys), list(self.values)
        keys: dict[int, int] = {}
        values: dict[int, int] = {}
        body = bytearray()
        for _, head, tags, rest in sorted(self.features, key=lambda f: f[0]):
            numbered = b"".join(varint(seen.setdefault(t, len(seen))) for t, seen in zip(tags, (keys, values) * (len(tags) // 2)))
            body += field(2, head + (field(2, numbered) if numbered else b"") + rest)
        return field(1, name.encode()) + bytes(body) + b"".join(field(3, names[k].encode()) for k in keys) + b"".join(field(4, spelled[v]) for v in values) + field(5, extent) + field(15, 2)


def layer(name: str, features: list[dict], extent: int) -> bytes:
    """features: {id, kind, geom, props}, in order."""
    whole = Partial()
    for order, f in enumerate(features):
        whole.add(order, None if f["id"] is None else int(f["id"]), f["kind"], f["geom"], f["props"])
    return whole.message(name, extent)


def tile(layers: list[tuple[str, list[dict]]], extent: int) -> bytes:
    return b"".join(field(3, layer(name, features, extent)) for name, features in layers if features)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: whole numbers, and bytes for all others."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            out, shift, at = out | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + n]
            at += n


def numbers(data: bytes) -> list[int]:
    """Packed whole numbers."""
    out, now, shift = [], 0, 0
    for byte in data:
        now |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(now)
            now = shift = 0
    return out


def geometry(data: bytes) -> list[list[tuple[int, int]]]:
    """Parts from commands; rings are not closed by a last point."""
    parts, codes, at, x, y = [], numbers(data), 0, 0, 0
    while at < len(codes):
        command, n = codes[at] & 7, codes[at] >> 3
        at += 1
        for _ in range(n if command < 7 else 0):
            x, y, at = x + (codes[at] >> 1 ^ -(codes[at] & 1)), y + (codes[at + 1] >> 1 ^ -(codes[at + 1] & 1)), at + 2
            if command == 1:
                parts.append([])
            parts[-1].append((x, y))
    return parts


def read_value(data: bytes) -> str | float | int | bool:
    for number, v in fields(data):
        if number == 1:
            return v.decode()
        if number in (2, 3):
            return struct.unpack("<f" if number == 2 else "<d", v)[0]
        if number == 4:
            return v - (v >> 63 << 64)
        if number == 6:
            return v >> 1 ^ -(v & 1)
        return bool(v) if number == 7 else v
    raise ValueError("a value without a field")


def read_layers(data: bytes) -> Iterator[tuple[dict, Iterator[dict]]]:
    """Each layer of a tile, {name, extent, version}, and its features one by one, {id, kind, geom, props}."""
    for number, message in fields(data):
        if number != 3:
            continue
        found, keys, values = {"name": "", "extent": 4096, "version": 1}, [], []
        for k, v in fields(message):
            if k == 1:
                found["name"] = v.decode()
            elif k == 3:
                keys.append(v.decode())
            elif k == 4:
                values.append(read_value(v))
            elif k != 2:
                found[{5: "extent", 15: "version"}[k]] = v

        def features(message=message, keys=keys, values=values) -> Iterator[dict]:
            for k, v in fields(message):
                if k == 2:
                    f = dict(fields(v))
                    tags = numbers(f.get(2, b""))
                    yield {"id": f.get(1), "kind": {1: "Point", 2: "LineString", 3: "Polygon"}[f[3]], "geom": geometry(f[4]), "props": {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}}

        yield found, features()


def decode(data: bytes) -> list[dict]:
    """The layers of a tile: {name, extent, version, features: [{id, kind, geom, props}]}."""
    return [layer | {"features": list(features)} for layer, features in read_layers(data)]
