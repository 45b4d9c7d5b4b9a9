"""BK-tree over fingerprints: children hang on edges numbered by their Hamming distance."""

from __future__ import annotations


class BKTree:
    """A tree of distinct integers under the Hamming distance.

    All fingerprints below the edge ``d`` of a node differ from that node in exactly ``d`` bits. A
    fingerprint at distance ``x`` from the node can thus have neighbours within ``r`` below the
    edges ``x - r`` to ``x + r`` only, by the triangle inequality; the other edges aren't followed.
    """

    __slots__ = ("values", "children")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Put a value in its place and return its number; a known value keeps its number."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while True:
            d = (value ^ self.values[at]).bit_count()
            if d == 0:
                return at
            below = self.children[at].get(d)
            if below is None:
                self.values.append(value)
                self.children.append({})
                self.children[at][d] = len(self.values) - 1
                return len(self.values) - 1
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of all values that differ in at most ``radius`` bits."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            x = (value ^ self.values[at]).bit_count()
            if x <= radius:
                found.append(at)
            children = self.children[at]
            if children:
                for d in range(x - radius, x + radius + 1):
                    below = children.get(d)
                    if below is not None:
                        open_nodes.append(below)
        return found


class Sets:
    """Union-find over the numbers of a tree's values."""

    __slots__ = ("parent",)

    def __init__(self) -> None:
        self.parent: list[int] = []

    def grow(self, n: int) -> None:
        self.parent.extend(range(len(self.parent), n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
