"""The local mesh kernel: Delaunay simplices of a point set in two or three dimensions.

Points are inserted one by one along a space-filling curve. Outside the hull lie ghost simplices with one symbolic
vertex, so no artificial coordinates enter. Signs are exact. Cospherical ties are decided as if each point's
lifted coordinate were raised by an infinitesimal that is larger for lexicographically larger points: the result
doesn't depend on the order of insertion or on which other points are there.
"""

from __future__ import annotations

import numpy as np

from tessella.operators.predicates import orient2, orient3, sphere2, sphere3

GHOST = -1


def curve_order(points: np.ndarray, bits: int = 16) -> np.ndarray:
    """The order of points along a Morton curve over their bounds."""
    low, span = points.min(0), np.ptp(points, axis=0)
    cell = ((points - low) / np.where(span > 0, span, 1) * ((1 << bits) - 1)).astype(np.uint64)
    code = np.zeros(len(points), np.uint64)
    for b in range(bits):
        for d in range(points.shape[1]):
            code |= (cell[:, d] >> np.uint64(b) & np.uint64(1)) << np.uint64(b * points.shape[1] + d)
    return np.argsort(code, kind="stable")


class Mesh:
    def __init__(self, points: np.ndarray):
        self.dim = points.shape[1]
        self.at = [tuple(map(float, p)) for p in points]
        self.orient, self.sphere = (orient2, sphere2) if self.dim == 2 else (orient3, sphere3)
        self.vertices: list[list[int] | None] = []
        self.links: list[list[int]] = []
        self.free: list[int] = []
        self.last = -1
        order = curve_order(points).tolist() if len(points) else []
        first = self._independent(order)
        self.flat = first is None
        if first is not None:
            self._begin(first)
            used = set(first)
            for p in order:
                if p not in used:
                    self._insert(p)

    def _independent(self, order: list[int]) -> list[int] | None:
        """Points that span the space, with positive orientation."""
        if len(order) <= self.dim:
            return None
        a, b = order[0], order[1]
        for c in order[2:]:
            if self.dim == 2:
                if o := orient2(self.at[a], self.at[b], self.at[c]):
                    return [a, b, c] if o > 0 else [b, a, c]
            elif any(orient2(*[(self.at[v][i], self.at[v][j]) for v in (a, b, c)]) for i, j in ((0, 1), (0, 2), (1, 2))):
                for d in order[2:]:
                    if o := orient3(*[self.at[v] for v in (a, b, c, d)]):
                        return [a, b, c, d] if o > 0 else [b, a, c, d]
                return None
        return None

    def _new(self, vertices: list[int]) -> int:
        if self.free:
            s = self.free.pop()
            self.vertices[s], self.links[s] = vertices, [-1] * len(vertices)
            return s
        self.vertices.append(vertices)
        self.links.append([-1] * len(vertices))
        return len(self.vertices) - 1

    def _begin(self, first: list[int]) -> None:
        new = [self._new(first)]
        for k in range(self.dim + 1):  # beyond each face a ghost, whose orientation is that of a point out there
            v = [*first]
            v[k] = GHOST
            i, j = [m for m in range(self.dim + 1) if m != k][:2]
            v[i], v[j] = v[j], v[i]
            new.append(self._new(v))
        self._join(new)
        self.last = new[0]

    def _join(self, simplices: list[int], skip: int | None = None) -> None:
        """Links simplices that share faces; `skip` is the vertex that all of them have."""
        open_: dict[tuple[int, ...], tuple[int, int]] = {}
        for s in simplices:
            v = self.vertices[s]
            for k, own in enumerate(v):
                if own == skip:
                    continue
                face = tuple(sorted(x for x in v if x != own and x != skip))
                if other := open_.pop(face, None):
                    t, m = other
                    self.links[s][k], self.links[t][m] = t, s
                else:
                    open_[face] = (s, k)

    def _side(self, v: list[int], k: int, p: int) -> int:
        """The orientation of a simplex with vertex k replaced."""
        at = self.at
        q = [at[x] if j != k else at[p] for j, x in enumerate(v)]
        return self.orient(*q)

    def _conflict(self, s: int, p: int) -> bool:
        """Does the open circumsphere of s (of a ghost: what lies beyond its face) hold p?"""
        v = self.vertices[s]
        if GHOST in v:
            k = v.index(GHOST)
            side = self._side(v, k, p)
            return side > 0 or (side == 0 and self._conflict(self.links[s][k], p))
        at = self.at
        q = at[p]
        side = self.sphere(*[at[x] for x in v], q)
        if side:
            return side > 0
        for point, k in sorted([(at[x], j) for j, x in enumerate(v)] + [(q, -1)], reverse=True):
            if k < 0:
                return False
            if o := self._side(v, k, p):
                return o > 0
        return False

    def _locate(self, p: int) -> int:
        s, came = self.last, -1
        while True:
            v = self.vertices[s]
            if GHOST in v:
                return s
            for k in range(len(v)):
                t = self.links[s][k]
                if t != came and self._side(v, k, p) < 0:
                    came, s = s, t
                    break
            else:
                return s

    def _insert(self, p: int) -> None:
        start = self._locate(p)
        inside, stack, border = {start}, [start], []
        outside: set[int] = set()
        while stack:
            s = stack.pop()
            for k, t in enumerate(self.links[s]):
                if t in inside:
                    continue
                if t not in outside and self._conflict(t, p):
                    inside.add(t)
                    stack.append(t)
                else:
                    outside.add(t)
                    border.append((s, k, t))
        new = []
        for s, k, t in border:
            v = [*self.vertices[s]]
            v[k] = p
            n = self._new(v)
            self.links[n][k] = t
            self.links[t][self.links[t].index(s)] = n
            new.append(n)
        self._join(new, skip=p)
        for s in inside:
            self.vertices[s] = None
        self.free.extend(inside)
        self.last = next(n for n in new if GHOST not in self.vertices[n])

    def simplices(self) -> np.ndarray:
        """Finite simplices, places of vertices rising."""
        found = [sorted(v) for v in self.vertices if v is not None and GHOST not in v]
        return np.array(found, np.int64).reshape(-1, self.dim + 1)

    def hull(self) -> np.ndarray:
        found = [sorted(x for x in v if x != GHOST) for v in self.vertices if v is not None and GHOST in v]
        return np.array(found, np.int64).reshape(-1, self.dim)


def circumspheres(points: np.ndarray, simplices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii; NaN or infinity for simplices that are flat in double precision."""
    first = points[simplices[:, 0]]
    rows = points[simplices[:, 1:]] - first[:, None]
    half = (rows * rows).sum(2) / 2
    with np.errstate(all="ignore"):
        if points.shape[1] == 2:
            a, b = rows[:, 0], rows[:, 1]
            whole = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
            centre = np.stack([half[:, 0] * b[:, 1] - half[:, 1] * a[:, 1], half[:, 1] * a[:, 0] - half[:, 0] * b[:, 0]], 1) / whole[:, None]
        else:
            a, b, c = rows[:, 0], rows[:, 1], rows[:, 2]
            whole = (a * np.cross(b, c)).sum(1)
            centre = (half[:, :1] * np.cross(b, c) + half[:, 1:2] * np.cross(c, a) + half[:, 2:] * np.cross(a, b)) / whole[:, None]
        return first + centre, (centre * centre).sum(1)


def distinct_places(points: np.ndarray) -> np.ndarray:
    """The first row of each location."""
    return np.sort(np.unique(points + 0.0, axis=0, return_index=True)[1]) if len(points) else np.zeros(0, np.int64)
