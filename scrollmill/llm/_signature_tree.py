"""Signature trees over sets: nodes hold the OR of their members' bitmaps, their least bit count and the range of their sizes.

Two nodes are walked together, and a pair of nodes goes as soon as no pair of sets below it can overlap enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Children of a node; bytes of bitmaps that are compared at once.
FANOUT, STEP = 8, 1 << 23
#: Bits of a bitmap for each element, before the next power of two is taken; the least number of bits.
DENSITY, LEAST_BITS = 4, 256


def bitmap(s: np.ndarray) -> bytes:
    """Of a set of hashes. Its width follows the set's size and is a power of two, so that a wide one folds to any smaller one."""
    width = max(LEAST_BITS, 1 << (DENSITY * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits).tobytes()


def _rows(bitmaps: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(bitmaps), width // 8), np.uint64)
    for k, b in enumerate(bitmaps):
        row = np.frombuffer(b, np.uint64)
        out[k] = row if len(b) == width else np.bitwise_or.reduce(row.reshape(-1, width // 8), axis=0)
    return out


class _Level:
    """The nodes of one level, as columns; ``upper``: all members below belong to a tree of wider bitmaps."""

    def __init__(self, bits, lo, hi, pop, upper):
        self.bits, self.lo, self.hi, self.pop, self.upper = bits, lo, hi, pop, upper

    def parents(self) -> _Level:
        at = np.arange(0, len(self.lo), FANOUT)
        least = np.minimum.reduceat
        return _Level(np.bitwise_or.reduceat(self.bits, at), least(self.lo, at), np.maximum.reduceat(self.hi, at), least(self.pop, at), least(self.upper, at))

    def possible(self, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which node pairs may hold two sets with ``den * intersection >= num * union``, of which one at least is not ``upper``."""
        ok = (num * self.lo[j] <= den * self.hi[i]) & (num * self.lo[i] <= den * self.hi[j]) & ~(self.upper[i] & self.upper[j])
        at = np.flatnonzero(ok)
        step = max(1, STEP // (8 * self.bits.shape[1]))
        for k in range(0, len(at), step):
            here = at[k : k + step]
            a, b = i[here], j[here]
            common = np.bitwise_count(self.bits[a] & self.bits[b]).sum(1, dtype=np.int64)
            # Each bit of a set outside of the other node is at least one element that cannot be shared.
            most = np.minimum(self.hi[a] - np.maximum(0, self.pop[a] - common), self.hi[b] - np.maximum(0, self.pop[b] - common))
            ok[here] = most * (den + num) >= num * (self.lo[a] + self.lo[b])
        return ok


class _Tree:
    """Members in the lexicographic order of their bitmaps, which puts like ones side by side. ``label`` tells their components."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, label: np.ndarray, upper: np.ndarray, num: int, den: int):
        words = bits[:, :2].byteswap()  # the first bits count most
        order = np.lexsort((n, *words.T[::-1], label))
        self.order, self.label, self.num, self.den = order, label[order], num, den
        bits, n = bits[order], n[order]
        self.levels = [_Level(bits, n, n, np.bitwise_count(bits).sum(1, dtype=np.int64), upper[order])]
        while len(self.levels[-1].lo) > 1:
            self.levels.append(self.levels[-1].parents())

    def ranges(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest label below the nodes of a level."""
        at = np.arange(0, len(self.label), FANOUT**k)
        return np.minimum.reduceat(self.label, at), np.maximum.reduceat(self.label, at)

    def apart(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lo, hi = self.ranges(k)
        return (lo[i] != hi[i]) | (lo[j] != hi[j]) | (lo[i] != lo[j])

    def children(self, k: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes of the level below k, without a leaf's pair with itself."""
        a = (i[:, None, None] * FANOUT + np.arange(FANOUT)[None, :, None]).repeat(FANOUT, 2).ravel()
        b = (j[:, None, None] * FANOUT + np.arange(FANOUT)[None, None, :]).repeat(FANOUT, 1).ravel()
        n = len(self.levels[k - 1].lo)
        ok = (a < n) & (b < n) & (a <= b if k > 1 else a < b)
        return a[ok], b[ok]

    def descend(self, k: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaf pairs of different labels that dual traversal of the node pairs leaves over."""
        stack = [(k, i, j)]
        while stack:
            k, i, j = stack.pop()
            ok = self.apart(k, i, j)
            i, j = i[ok], j[ok]
            ok = self.levels[k].possible(i, j, self.num, self.den)
            i, j = i[ok], j[ok]
            if k == 0:
                if len(i):
                    yield i, j
                continue
            for at in range(0, len(i), 1024):
                a, b = self.children(k, i[at : at + 1024], j[at : at + 1024])
                if len(a):
                    stack.append((k - 1, a, b))

    def union(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        """Of leaf pairs those that join two labels, the likest first."""
        if len(i) > 1:
            leaf = self.levels[0]
            differ = np.bitwise_count(leaf.bits[i] ^ leaf.bits[j]).sum(1, dtype=np.int64)
            order = np.argsort(differ / (leaf.lo[i] + leaf.lo[j]), kind="stable")
            i, j = i[order], j[order]
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = self.label[a], self.label[b]
            if x != y:
                self.label[self.label == max(x, y)] = min(x, y)
                yield a, b

    def forest(self, quick: bool) -> Iterator[tuple[int, int]]:
        """Enough pairs to join all that may link, taking it for granted that they do: from small nodes to large ones. ``quick``: of two nodes that are whole only the first members are tried before."""
        for k in range(1, len(self.levels)):
            nodes = np.arange(len(self.levels[k].lo))
            a, b = self.children(k, nodes, nodes)
            a, b = a[a < b], b[a < b]
            size = FANOUT ** (k - 1)
            if k > 1 and quick:
                lo, hi = self.ranges(k - 1)
                whole = (lo[a] == hi[a]) & (lo[b] == hi[b]) & (lo[a] != lo[b])
                x, y = a[whole] * size, b[whole] * size
                ok = self.levels[0].possible(x, y, self.num, self.den)
                yield from self.union(x[ok], y[ok])
            for i, j in self.descend(k - 1, a, b):
                yield from self.union(i, j)


def pairs(bitmaps: list[bytes], n: np.ndarray, label: np.ndarray | None, forest: bool, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of sets that may link, by a tree for each width of the bitmaps.

    All pairs of different labels (of any two, if None) that are not ruled out, or a forest of them. Sets of other widths
    that are near enough in size join a tree with their bitmaps folded.
    """
    widths = np.array([8 * len(b) for b in bitmaps])
    for width in np.unique(widths).tolist():
        own = widths == width
        here = np.flatnonzero(own | ((widths > width) & (num * n <= den * n[own].max())))
        if len(here) < 2:
            continue
        tree = _Tree(_rows([bitmaps[k] for k in here], width // 8), n[here], np.arange(len(here)) if label is None else label[here], ~own[here], num, den)
        at = here[tree.order]
        if forest:
            found = list(tree.forest(label is None))
            if found:
                i, j = np.array(found, np.int64).T
                yield at[i], at[j]
        else:
            top, root = len(tree.levels) - 1, np.zeros(1, np.int64)
            for i, j in tree.descend(top, root, root):
                yield at[i], at[j]
