"""Depth-first searches over one graph in memory, to test the distributed algorithms against."""

import numpy as np


def _adjacency(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int], list[int]]:
    """Start of each vertex's list, neighbours, and the edges they come by."""
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.argsort(ends, kind="stable")
    return np.searchsorted(ends[by], np.arange(n + 1)).tolist(), others[by].tolist(), (by % max(1, len(a))).tolist()


def search(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a simple undirected graph: whether each edge is a bridge, the edges' blocks, and whether each vertex is a cut vertex.

    Vertices are numbered as they are met; low[v] is the least number that v's subtree reaches by
    one edge up. An edge that closes a block takes with it all edges found since it was met.
    """
    start, near, by = _adjacency(a, b, n)
    number, low, place = [0] * n, [0] * n, start[:-1]
    block = np.full(len(a), -1, np.int64)
    bridge = np.zeros(len(a), bool)
    cut = np.zeros(n, bool)
    clock = blocks = 0
    for root in range(n):
        if number[root]:
            continue
        clock += 1
        number[root] = low[root] = clock
        path, came, waiting, children = [root], [-1], [], 0
        while path:
            v = path[-1]
            if place[v] < start[v + 1]:
                w, e = near[place[v]], by[place[v]]
                place[v] += 1
                if e == came[-1]:
                    continue
                if not number[w]:
                    clock += 1
                    number[w] = low[w] = clock
                    waiting.append(e)
                    path.append(w)
                    came.append(e)
                elif number[w] < number[v]:
                    waiting.append(e)
                    low[v] = min(low[v], number[w])
                continue
            path.pop()
            e = came.pop()
            if not path:
                break
            u = path[-1]
            low[u] = min(low[u], low[v])
            if u == root:
                children += 1
            if low[v] >= number[u]:
                cut[u] |= u != root
                size = 0
                while True:
                    x = waiting.pop()
                    block[x] = blocks
                    size += 1
                    if x == e:
                        break
                bridge[e] = size == 1
                blocks += 1
        cut[root] = children > 1
    return bridge, block, cut


def strong(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Strong component of each vertex of a directed graph, by two passes: finishing order, then the reversed edges from its end."""

    def lists(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
        by = np.argsort(x, kind="stable")
        return np.searchsorted(x[by], np.arange(n + 1)).tolist(), y[by].tolist()

    start, near = lists(a, b)
    seen, order = [False] * n, []
    place = start[:-1]
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        path = [root]
        while path:
            v = path[-1]
            if place[v] < start[v + 1]:
                w = near[place[v]]
                place[v] += 1
                if not seen[w]:
                    seen[w] = True
                    path.append(w)
            else:
                order.append(path.pop())
    start, near = lists(b, a)
    of = np.full(n, -1, np.int64)
    for k, root in enumerate(reversed(order)):
        if of[root] >= 0:
            continue
        of[root] = k
        path = [root]
        while path:
            v = path.pop()
            for w in near[start[v] : start[v + 1]]:
                if of[w] < 0:
                    of[w] = k
                    path.append(w)
    return of
