"""Scalars: integer helpers, rescaling, edge weights, sample sizes, number recognition and text forms."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_pow2(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def is_multiple(n: int, of: int) -> bool:
    return n % of == 0


def next_pow2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def log2_floor(n: int) -> int:
    return n.bit_length() - 1


def log_floor(n: int, base: int) -> int:
    out = 0
    while n >= base:
        n, out = n // base, out + 1
    return out


def popcount(value: Column) -> Column:
    return F.bit_count(value)


def rescale(value: Column, low: float, high: float, to_low: int, to_high: int) -> Column:
    """Linearly from one range to a range of integers, clamped, cut towards zero."""
    part = (F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / (high - low if high > low else 1.0)
    return (part * (to_high - to_low) + to_low).cast("int")


#: Weights of a squared distance d that is a share of the squared diagonal.
EDGE_WEIGHTS: dict[str, Callable[[Column], Column]] = {
    "squared-inverted": lambda d: 1 / (d + 1e-7),
    "inverted": lambda d: 1 / F.sqrt(d + 1e-7),
    "linear": lambda d: 1 - d,
    "log": lambda d: -F.log(d + 1e-7),
    "uniform": lambda d: F.lit(1.0),
}


def weight_range(name: str) -> tuple[float, float]:
    """The values of a weight at distances 1 and 0."""
    return {"squared-inverted": (1 / (1 + 1e-7), 1e7), "inverted": (1 / math.sqrt(1 + 1e-7), math.sqrt(1e7)), "linear": (0.0, 1.0), "log": (-math.log(1 + 1e-7), -math.log(1e-7)), "uniform": (0.0, 1.0)}[name]


def sample_size(kind: str | int, n: int) -> int:
    """`sqrt`, `log2` or a number."""
    if isinstance(kind, int):
        return min(kind, n)
    if kind == "sqrt":
        return math.isqrt(n)
    if kind == "log2":
        return log2_floor(n) if n else 0
    raise ValueError(f"unknown sample size {kind!r}")


def is_int(text: Column) -> Column:
    return text.rlike(r"^[+\-±]?[0-9]+$")


def is_float(text: Column) -> Column:
    return text.rlike(r"^[+\-±]?([0-9]+(\.[0-9x]*)?|\.[0-9]+)([eE][+\-]?[0-9]+)?$")


def vector_text(p: list[Column]) -> Column:
    return F.format_string("[" + ", ".join(["%f"] * len(p)) + "]", *p)


def box_text(low: list[Column], high: list[Column]) -> Column:
    return F.concat(vector_text(low), F.lit(" - "), vector_text(high))


def sphere_text(centre: list[Column], radius: Column) -> Column:
    return F.concat(F.lit("O = "), vector_text(centre), F.lit(" r = "), F.format_string("%f", radius))


def simplex_text(id_: Column, v: Column) -> Column:
    return F.concat(id_.cast("string"), F.lit(": "), F.array_join(F.transform(v, lambda i: F.when(i < 0, F.concat(F.lit("inf"), (-i).cast("string"))).otherwise(i.cast("string"))), " "))
