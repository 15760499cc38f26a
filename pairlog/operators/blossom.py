"""A random largest matching of a network that one task holds in memory.

Edges are taken in random order where both ends are free; then each node left over looks for an alternating path
to another one, breadth first, in the order of shuffled neighbour lists. Odd cycles are shrunk as they are met
(Edmonds), so a search that fails is proof: no later search needs the nodes it reached, and they are left out from then
on. The nodes reached by failed searches are reached once in all; one that succeeds with k nodes left over
reaches about n/k on random networks, so all of them take about n log n.

Memory: 8 bytes an edge for the neighbour lists and about 30 a node; while they are built, up to 130 an edge in all
(measured on separate pairs, with two nodes an edge).
"""

from __future__ import annotations

from array import array

import numpy as np

_EVEN, _ODD, _OUT = 1, 2, 3
_CHUNK = 1 << 16


def _ints(values: np.ndarray) -> array:
    out = array("i")
    out.frombytes(np.ascontiguousarray(values, np.int32).tobytes())
    return out


def _greedy(u: np.ndarray, v: np.ndarray, mate: array) -> None:
    """Each edge in order, where both ends are free."""
    now = np.frombuffer(mate, np.int32)
    for start in range(0, len(u), _CHUNK):
        a, b = u[start:start + _CHUNK], v[start:start + _CHUNK]
        free = (now[a] < 0) & (now[b] < 0)
        for x, y in zip(a[free].tolist(), b[free].tolist()):
            if mate[x] < 0 and mate[y] < 0:
                mate[x], mate[y] = y, x


def _augment(roots: list[int], first: array, beside: array, mate: array) -> None:
    """Swap along alternating paths from the roots until none is left. ``beside[first[x]:first[x + 1]]`` are x's neighbours."""
    n = len(mate)
    kind, before, base, seen, tick = bytearray(n), array("i", [-1]) * n, array("i", range(n)), array("i", [0]) * n, 0

    def bottom(x: int) -> int:
        """Where the shrunken cycle that x is in hangs on its tree."""
        while (y := base[x]) != x:
            base[x] = base[y]
            x = y
        return x

    def common(x: int, y: int) -> int:
        nonlocal tick
        tick += 1
        x, y = bottom(x), bottom(y)
        while True:
            if x >= 0:
                if seen[x] == tick:
                    return x
                seen[x] = tick
                x = bottom(before[mate[x]]) if mate[x] >= 0 else -1
            x, y = y, x

    def shrink(x: int, y: int, top: int, queue: list[int]) -> None:
        while bottom(x) != top:
            before[x] = y
            y = mate[x]
            if kind[y] == _ODD:
                kind[y] = _EVEN
                queue.append(y)
            if base[x] == x:
                base[x] = top
            if base[y] == y:
                base[y] = top
            x = before[y]

    def search(root: int) -> bool:
        kind[root] = _EVEN
        queue, reached = [root], [root]
        for x in queue:  # grows
            for y in beside[first[x]:first[x + 1]]:
                if kind[y] == 0:
                    before[y] = x
                    z = mate[y]
                    if z < 0:
                        while y >= 0:
                            x = before[y]
                            z = mate[x]
                            mate[y], mate[x] = x, y
                            y = z
                        for w in reached:
                            kind[w], base[w] = 0, w
                        return True
                    kind[y], kind[z] = _ODD, _EVEN
                    reached += (y, z)
                    queue.append(z)
                elif kind[y] == _EVEN and bottom(x) != bottom(y):
                    top = common(x, y)
                    shrink(x, y, top, queue)
                    shrink(y, x, top, queue)
        for w in reached:
            kind[w] = _OUT
        return False

    left = len(roots)
    for root in roots:
        if left < 2:  # nobody to find
            return
        if mate[root] < 0:
            left -= 2 if search(root) else 1


def largest_matching(u: np.ndarray, v: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the network in order, and where among them the mate of each is, or -1. Edges are there once, without loops;
    their order does not matter."""
    nodes = np.unique(np.concatenate([u, v]))
    n, m = len(nodes), len(u)
    edges = np.searchsorted(nodes, u) * n + np.searchsorted(nodes, v)
    edges.sort()
    edges = edges[rng.permutation(m)]
    u, v = (edges // n).astype(np.int32), (edges % n).astype(np.int32)
    del edges
    mate = array("i", [-1]) * n
    _greedy(u, v, mate)
    roots = np.flatnonzero(np.frombuffer(mate, np.int32) < 0)
    if len(roots) > 1:
        swap = rng.random(m) < 0.5  # else the neighbours with larger numbers came first
        at, to = np.concatenate([np.where(swap, u, v), np.where(swap, v, u)]), np.concatenate([np.where(swap, v, u), np.where(swap, u, v)])
        del u, v
        beside = _ints(to[np.argsort(at, kind="stable")])
        first = _ints(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]))
        del at, to
        _augment(rng.permutation(roots).tolist(), first, beside, mate)
    return nodes, np.frombuffer(mate, np.int32)
