"""A balanced k-way cut of a small weighted graph."""

from __future__ import annotations

import heapq
import math

import numpy as np


def cut_graph(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, k: int, imbalance: float = 0.05, seed: int = 1986, rounds: int = 8) -> np.ndarray:
    """A label 0 to k-1 per node; no part has more than (1 + imbalance) * ceil(n / k) nodes.

    Parts grow one after another from a node far from those taken, by the strongest links into the part; then
    nodes move to the part that they are linked to most, where balance allows it and the cut gets smaller.
    """
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64)
    most = int((1 + imbalance) * math.ceil(n / k))
    links: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist()):
        links[a].append((b, w))
    label, left, rng = np.full(n, -1), n, np.random.default_rng(seed)
    start = int(rng.integers(n))
    for part in range(k):
        goal = math.ceil(left / (k - part))
        gain: dict[int, float] = {start: 0.0}
        heap, taken = [(0.0, start)], 0
        while taken < goal:
            if not heap:
                free = np.flatnonzero(label < 0)
                heap, gain = [(0.0, int(free[0]))], {int(free[0]): 0.0}
            g, v = heapq.heappop(heap)
            if label[v] >= 0 or -g < gain.get(v, 0.0):
                continue
            label[v] = part
            taken += 1
            for u, w in links[v]:
                if label[u] < 0:
                    gain[u] = gain.get(u, 0.0) + w
                    heapq.heappush(heap, (-gain[u], u))
        left -= taken
        rim = [u for _, u in heap if label[u] < 0]
        free = np.flatnonzero(label < 0)
        start = rim[0] if rim else int(free[0]) if len(free) else 0
    size = np.bincount(label, minlength=k)
    for _ in range(rounds):
        moved = 0
        for v in range(n):
            pull = np.zeros(k)
            for u, w in links[v]:
                pull[label[u]] += w
            best = int(np.where(size < most, pull, -1).argmax())
            if pull[best] > pull[label[v]] and size[label[v]] > 1:
                size[label[v]] -= 1
                size[best] += 1
                label[v] = best
                moved += 1
        if not moved:
            break
    return label
