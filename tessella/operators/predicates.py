"""Exact signs of orientation and in-sphere determinants: floats where their error bound decides, integers elsewhere."""

from __future__ import annotations

from fractions import Fraction

Point = tuple[float, ...]
#: Error bounds of the plain double evaluations, as multiples of the sum of absolute terms.
BOUND_ORIENT2, BOUND_ORIENT3 = 4e-16, 9e-16
BOUND_SPHERE2, BOUND_SPHERE3 = 1.3e-15, 2e-15


def _sign(x) -> int:
    return (x > 0) - (x < 0)


def _exact_rows(points: list[Point]) -> list[list[int]]:
    """Coordinates as integers of one common scale."""
    parts = [[Fraction(c) for c in p] for p in points]
    scale = max(f.denominator for p in parts for f in p)  # denominators are powers of two
    return [[int(f * scale) for f in p] for p in parts]


def _det(m: list[list[int]]) -> int:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    return sum((-1) ** k * row[0] * _det([r[1:] for j, r in enumerate(m) if j != k]) for k, row in enumerate(m) if row[0])


def exact_orient(points: list[Point]) -> int:
    *rows, last = _exact_rows(points)
    return _sign(_det([[a - b for a, b in zip(r, last)] for r in rows]))


def exact_in_sphere(points: list[Point], p: Point) -> int:
    """Above 0 if p is inside the sphere of a simplex with positive orientation."""
    *rows, last = _exact_rows([*points, p])
    lifted = []
    for r in rows:
        d = [a - b for a, b in zip(r, last)]
        lifted.append([*d, sum(c * c for c in d)])
    return _sign(_det(lifted))


def orient2(a: Point, b: Point, c: Point) -> int:
    acx, acy, bcx, bcy = a[0] - c[0], a[1] - c[1], b[0] - c[0], b[1] - c[1]
    left, right = acx * bcy, acy * bcx
    det = left - right
    if abs(det) > BOUND_ORIENT2 * (abs(left) + abs(right)):
        return 1 if det > 0 else -1
    return exact_orient([a, b, c])


def orient3(a: Point, b: Point, c: Point, d: Point) -> int:
    dx, dy, dz = d
    ax, ay, az = a[0] - dx, a[1] - dy, a[2] - dz
    bx, by, bz = b[0] - dx, b[1] - dy, b[2] - dz
    cx, cy, cz = c[0] - dx, c[1] - dy, c[2] - dz
    p, q, r, s, t, u = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    det = az * (p - q) + bz * (r - s) + cz * (t - u)
    size = (abs(p) + abs(q)) * abs(az) + (abs(r) + abs(s)) * abs(bz) + (abs(t) + abs(u)) * abs(cz)
    if abs(det) > BOUND_ORIENT3 * size:
        return 1 if det > 0 else -1
    return exact_orient([a, b, c, d])


def sphere2(a: Point, b: Point, c: Point, p: Point) -> int:
    px, py = p
    ax, ay, bx, by, cx, cy = a[0] - px, a[1] - py, b[0] - px, b[1] - py, c[0] - px, c[1] - py
    e, f, g, h, i, j = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    la, lb, lc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    det = la * (e - f) + lb * (g - h) + lc * (i - j)
    if abs(det) > BOUND_SPHERE2 * ((abs(e) + abs(f)) * la + (abs(g) + abs(h)) * lb + (abs(i) + abs(j)) * lc):
        return 1 if det > 0 else -1
    return exact_in_sphere([a, b, c], p)


def sphere3(a: Point, b: Point, c: Point, d: Point, p: Point) -> int:
    px, py, pz = p
    ax, ay, az = a[0] - px, a[1] - py, a[2] - pz
    bx, by, bz = b[0] - px, b[1] - py, b[2] - pz
    cx, cy, cz = c[0] - px, c[1] - py, c[2] - pz
    dx, dy, dz = d[0] - px, d[1] - py, d[2] - pz
    ab, ba, bc, cb, cd, dc = ax * by, bx * ay, bx * cy, cx * by, cx * dy, dx * cy
    da, ad, ac, ca, bd, db = dx * ay, ax * dy, ax * cy, cx * ay, bx * dy, dx * by
    xab, xbc, xcd, xda, xac, xbd = ab - ba, bc - cb, cd - dc, da - ad, ac - ca, bd - db
    abc, bcd = az * xbc - bz * xac + cz * xab, bz * xcd - cz * xbd + dz * xbc
    cda, dab = cz * xda + dz * xac + az * xcd, dz * xab + az * xbd + bz * xda
    la, lb, lc, ld = ax * ax + ay * ay + az * az, bx * bx + by * by + bz * bz, cx * cx + cy * cy + cz * cz, dx * dx + dy * dy + dz * dz
    det = (ld * abc - lc * dab) + (lb * cda - la * bcd)
    az, bz, cz, dz = abs(az), abs(bz), abs(cz), abs(dz)
    sab, sbc, scd, sda, sac, sbd = abs(ab) + abs(ba), abs(bc) + abs(cb), abs(cd) + abs(dc), abs(da) + abs(ad), abs(ac) + abs(ca), abs(bd) + abs(db)
    size = (scd * bz + sbd * cz + sbc * dz) * la + (sda * cz + sac * dz + scd * az) * lb + (sab * dz + sbd * az + sda * bz) * lc + (sbc * az + sac * bz + sab * cz) * ld
    if abs(det) > BOUND_SPHERE3 * size:
        return 1 if det > 0 else -1
    return exact_in_sphere([a, b, c, d], p)
