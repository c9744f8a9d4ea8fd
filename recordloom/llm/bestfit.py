"""Best-fit-decreasing over items or over a histogram of sizes.

Open bins with the same room are interchangeable, so a histogram is placed in
runs: a store of (room, first bin, number of bins) gives the tightest run. The
store is a balanced tree over the rooms, or a segment tree over capacity classes.
"""

from __future__ import annotations

import random
from collections.abc import Iterable


class BinTree:
    """A treap of (remaining capacity, bin); ``ceiling`` finds the tightest bin that still fits."""

    def __init__(self, seed: int = 7):
        self.root = None
        self.rng = random.Random(seed)

    # A node is [key, priority, left, right].
    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node, key):
        """(nodes below key, the others)."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def insert(self, key: tuple) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.rng.random(), None, None]), right)

    def pop_ceiling(self, size: int):
        """Removes and returns the least key whose remaining capacity is at least ``size``, or None."""
        left, right = self._split(self.root, (size,))
        if right is None:
            self.root = left
            return None
        node, above = right, None
        while node[2] is not None:
            above, node = node, node[2]
        if above is None:
            right = node[3]
        else:
            above[2] = node[3]
        self.root = self._merge(left, right)
        return node[0]


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> tuple[list[int], int]:
    """(bin of each item, number of bins). An item above the capacity gets a bin of its own."""
    sizes = list(sizes)
    tree, out, bins = BinTree(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.pop_ceiling(sizes[i])
        if found is None:
            found, bins = (max(capacity, sizes[i]), bins), bins + 1
        tree.insert((found[0] - sizes[i], found[1]))
        out[i] = found[1]
    return out, bins


class TreeStore:
    """Runs of open bins in a balanced tree, for capacities of any size."""

    def __init__(self):
        self.tree = BinTree()

    def take(self, size: int) -> tuple[int, int, int] | None:
        return self.tree.pop_ceiling(size)

    def put(self, room: int, first: int, have: int) -> None:
        self.tree.insert((room, first, have))


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity; a leaf counts the open bins of its class."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.width)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, remaining: int, count: int) -> None:
        at = remaining + self.width
        while at:
            self.sums[at] += count
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The least class >= size with an open bin."""
        at = size + self.width
        if self.sums[at]:
            return size
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None

    def take(self, size: int) -> tuple[int, int, int] | None:
        room = self.tightest(size)
        if room is None:
            return None
        first, have = self.runs[room].pop()
        self.add(room, -have)
        return room, first, have

    def put(self, room: int, first: int, have: int) -> None:
        self.runs.setdefault(room, []).append((first, have))
        self.add(room, have)


def plan_by_class(histogram: dict[int, int], capacity: int, store: TreeStore | CapacityTree | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit-decreasing over a histogram {size: count}: exactly the bins that placing the items one by one gives.

    After an item of size s enters a bin of room r, that bin is the tightest
    again while r - s >= s; hence a bin takes r // s items in a row. An item
    above the capacity gets a bin of its own. Returns rows (size, first rank,
    first bin, items per bin, first offset), each for a run of ranks within a
    size, and the number of bins. Its length depends on the distinct sizes and
    open runs, not on the number of items.
    """
    store = CapacityTree(capacity) if store is None else store
    plan, bins = [], 0
    for size in sorted((s for s, n in histogram.items() if n), reverse=True):
        left, rank, limit = histogram[size], 0, max(capacity, size)
        while left:
            found = store.take(size)
            room = limit if found is None else found[0]
            each = room // size
            wanted = max(1, left // each)
            if found is None:
                first, have = bins, wanted
                bins += have
            else:
                _, first, have = found
                if have > wanted:
                    store.put(room, first + wanted, have - wanted)
                    have = wanted
            take = min(each, left)
            plan.append((size, rank, first, take, limit - room))
            rank, left, rest = rank + have * take, left - have * take, room - take * size
            if rest:
                store.put(rest, first, have)
    return plan, bins


def fewest_capacity(histogram: dict[int, int], bins: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(plan, capacity): the least capacity, by bisection to one part in 65,536, at which best fit needs at most ``bins`` bins."""
    if not histogram:
        return [], 0
    low = max(-(-sum(s * n for s, n in histogram.items()) // bins), max(histogram))
    plan, need = plan_by_class(histogram, low, TreeStore())
    if need <= bins:
        return plan, low
    high, reach = low, max(1, low >> 12)
    while need > bins:
        low, high, reach = high, high + reach, reach * 2
        plan, need = plan_by_class(histogram, high, TreeStore())
    while high - low > max(1, high >> 16):
        middle = (low + high) // 2
        tried, need = plan_by_class(histogram, middle, TreeStore())
        if need <= bins:
            high, plan = middle, tried
        else:
            low = middle
    return plan, high
