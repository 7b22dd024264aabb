"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column | str, digits: int) -> Column:
    """A double rounded for output; minus zero becomes zero."""
    value = F.col(value) if isinstance(value, str) else value
    return (F.round(value.cast("double"), digits) + F.lit(0.0)).cast("double")


def num(value: float) -> Column:
    """A double literal."""
    return F.lit(float(value))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(num(low), F.least(num(high), value))


def first_true(*cases: tuple[Column, object], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def flags(*cases: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order, joined by |."""
    return F.concat_ws("|", *[F.when(c, F.lit(name)) for c, name in cases])


def shoelace(x: Column, z: Column) -> Column:
    """Area of a polygon from its arrays of coordinates."""
    n = F.size(x)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x, i) * F.get(z, (i + 1) % n) - F.get(x, (i + 1) % n) * F.get(z, i))
    return F.when(n >= 3, F.abs(F.aggregate(terms, num(0), lambda a, t: a + t)) / 2).otherwise(num(0))


def in_polygon(px: Column, pz: Column, x: Column, z: Column, eps: float = 1e-12) -> Column:
    """Even-odd test by edges that a ray in +x crosses; edges level in z are skipped."""
    n = F.size(x)

    def crossing(i):
        j = (i + n - 1) % n
        xi, zi, xj, zj = F.get(x, i), F.get(z, i), F.get(x, j), F.get(z, j)
        level = F.abs(zj - zi) < eps
        at = (xj - xi) * (pz - zi) / F.when(level, num(1)).otherwise(zj - zi) + xi
        return (~level & ((zi > pz) != (zj > pz)) & (px < at)).cast("int")

    crossings = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crossing), F.lit(0), lambda a, c: a + c)
    return F.when(n >= 3, crossings % 2 == 1).otherwise(F.lit(False))
