"""Bin packing of a histogram of lengths: linear grouping, few-size configurations, best fit.

What can be packed with what depends on lengths alone, of which there are as many as a sequence has
places. So the plan is made from the counts of the lengths and stays small, however many items there
are; it says for each *kind* of bin which lengths it holds, and how many bins there are of it.

Large items (above ``capacity * share``) are sorted by length and dealt into groups of equal
cardinality. Rounded up to its group's longest, an item has one of few sizes, and the fewest bins for
these are found by a linear program over configurations (what fits into one bin), whose columns are
generated by a knapsack over the current prices. Whole multiples of each configuration are opened,
actual lengths take the rounded ones' places, and what is left, small items above all, goes from the
longest to the shortest into the fullest bin that has room (best fit), in runs of equal bins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

#: Share of the capacity above which items are large, and groups: tried in turn up to a plan that meets
#: the bound (all lengths over the capacity), else the one with the fewest bins is taken. Rounding
#: wastes little where small items fill the gaps; where there are few of these, more groups do better.
SCHEMES = ((1 / 3, 40), (1 / 8, 80), (1 / 8, 100))
TINY = 1e-9
ROUNDS = 3000


@dataclass
class Kind:
    """``bins`` bins alike: (length, how many of it in each) in order, and the room left in each."""

    bins: int
    room: int
    holds: list[tuple[int, int]] = field(default_factory=list)

    def with_more(self, bins: int, length: int, each: int) -> Kind:
        return Kind(bins, self.room - length * each, [*self.holds, (length, each)])


def groups_of(counts: np.ndarray, least: int, parts: int) -> list[tuple[int, int]]:
    """Items of at least ``least``, longest first, in groups of equal cardinality: (longest, count).
    Groups of the same longest item are one."""
    total = int(counts[least:].sum())
    quota, out, room = -(-total // parts) if total else 0, [], 0
    for length in range(len(counts) - 1, least - 1, -1):
        left = int(counts[length])
        while left:
            if not room:
                out.append([length, 0])
                room = quota
            take = left if out[-1][0] == length else min(left, room)
            out[-1][1] += take
            left, room = left - take, max(0, room - take)
    return [(size, count) for size, count in out]


def fullest(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest price, and it (an unbounded knapsack)."""
    worth, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = [i for i in np.argsort(-prices / sizes) if prices[i] > TINY]
    for i in useful:
        s, p = int(sizes[i]), prices[i]
        for start in range(s, capacity + 1, s):  # a stretch of s places depends on the stretch before it alone
            here = slice(start, min(start + s, capacity + 1))
            gain = worth[start - s : here.stop - s] + p
            better = gain > worth[here] + TINY
            worth[here][better] = gain[better]
            chosen[here][better] = i
    held, at = np.zeros(len(sizes), np.int64), int(worth.argmax())
    best = worth[at]
    while chosen[at] >= 0:
        i = chosen[at]
        held[i] += 1
        at -= int(sizes[i])
    return float(best), held


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of bins that hold most of the demand, and no more than it."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(ROUNDS):
        prices = np.linalg.solve(basis.T, np.ones(k))
        worth, held = fullest(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        amounts, enters = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, held.astype(float))
        ratio = np.where(enters > TINY, np.maximum(amounts, 0) / np.where(enters > TINY, enters, 1), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = held
    amounts = np.linalg.solve(basis, demand.astype(float))
    out, left = [], demand.copy()
    for j in np.argsort(-amounts):
        held = np.rint(basis[:, j]).astype(np.int64)
        whole = min(int(np.floor(amounts[j] + 1e-6)), *(int(left[i] // held[i]) for i in np.flatnonzero(held)))
        if whole > 0:
            out.append((held, whole))
            left -= whole * held
    return out


def substituted(sizes: list[int], bins: int, counts: np.ndarray, lengths: list[int], capacity: int) -> list[Kind]:
    """Actual lengths in the places of the rounded ``sizes`` (longest first), in runs of bins alike.

    A place takes the longest item left that its size allows, and the last one the longest that
    the bin has room for, so that what rounding wasted is used. ``counts``, and ``lengths``, in
    which the lengths left are listed, give up what is taken; places for which nothing is left
    stay empty.
    """
    out = []
    while bins and lengths:
        room, used = capacity, {}
        for k, size in enumerate(sizes):
            at = bisect_right(lengths, room if k == len(sizes) - 1 else min(size, room)) - 1
            while at >= 0 and used.get(lengths[at], 0) >= counts[lengths[at]]:
                at -= 1
            if at >= 0:
                used[lengths[at]] = used.get(lengths[at], 0) + 1
                room -= lengths[at]
        if not used:
            break
        alike = min(bins, *(int(counts[length]) // each for length, each in used.items()))
        for length, each in used.items():
            counts[length] -= alike * each
            if not counts[length]:
                lengths.pop(bisect_left(lengths, length))
        out.append(Kind(alike, room, list(used.items())))
        bins -= alike
    return out


def best_fit(kinds: list[Kind], counts: np.ndarray, capacity: int) -> list[Kind]:
    """The rest from the longest to the shortest, each into the fullest bin with room for it."""
    by_room: dict[int, list[Kind]] = defaultdict(list)
    rooms: list[int] = []

    def put(kind: Kind) -> None:
        if not by_room[kind.room]:
            insort(rooms, kind.room)
        by_room[kind.room].append(kind)

    for kind in kinds:
        put(kind)
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no room: bins are opened
                put(Kind(max(1, left // (capacity // length)), capacity))
                continue
            room = rooms[at]
            kind = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            each = min(room // length, left)
            alike = min(kind.bins, left // each)
            put(kind.with_more(alike, length, each))
            left -= alike * each
            if kind.bins > alike:
                kind.bins -= alike
                put(kind)
    return [k for many in by_room.values() for k in many]


def packed(counts: np.ndarray, share: float, parts: int) -> list[Kind]:
    """counts[l] items of length l, for each length up to the capacity."""
    capacity = len(counts) - 1
    rest, kinds = counts.copy(), []
    if counts[capacity]:
        kinds.append(Kind(int(counts[capacity]), 0, [(capacity, 1)]))
        rest[capacity] = 0
    groups = groups_of(rest, max(1, int(capacity * share) + 1), parts)
    if groups:
        sizes, demand, lengths = np.array([size for size, _ in groups]), np.array([count for _, count in groups]), np.flatnonzero(rest).tolist()
        for config, bins in configurations(sizes, demand, capacity):
            kinds += substituted(np.repeat(sizes, config).tolist(), bins, rest, lengths, capacity)
    return best_fit(kinds, rest, capacity)


def plan(counts: np.ndarray, schemes: tuple[tuple[float, int], ...] = SCHEMES) -> list[Kind]:
    """The kinds of bins of the scheme that needs the fewest."""
    capacity = len(counts) - 1
    bound = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    best: list[Kind] = []
    for share, parts in schemes:
        kinds = packed(counts, share, parts)
        if not best or sum(k.bins for k in kinds) < sum(k.bins for k in best):
            best = kinds
        if sum(k.bins for k in best) <= bound:
            break
    return best
