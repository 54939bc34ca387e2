"""Column helpers for vectors and small row-major matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def clean(a: str | Column) -> Column:
    """Not-a-number and infinite elements become 0."""
    return F.transform(a, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))


def unit(a: str | Column, least: float = 1e-6) -> Column:
    """Divided by its length, or by ``least`` if that is more."""
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(least)))


def clean_unit(a: str | Column, least: float = 1e-6) -> Column:
    return unit(clean(a), least)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def at(m: str | Column, row: int, col: int, n: int) -> Column:
    return _col(m)[row * n + col]


def matmul(a: str | Column, b: str | Column, n: int) -> Column:
    """The product of two n x n matrices."""
    terms = [sum((at(a, i, k, n) * at(b, k, j, n) for k in range(1, n)), at(a, i, 0, n) * at(b, 0, j, n)) for i in range(n) for j in range(n)]
    return F.array(*terms)


def apply(m: str | Column, v: str | Column, n: int = 3) -> Column:
    """Matrix times vector."""
    return F.array(*[sum((at(m, i, k, n) * _col(v)[k] for k in range(1, n)), at(m, i, 0, n) * _col(v)[0]) for i in range(n)])


def rigid_inverse(m: str | Column) -> Column:
    """The inverse of a 4 x 4 pose whose rotation is orthonormal."""
    rows = []
    for i in range(3):
        back = -(at(m, 0, i, 4) * at(m, 0, 3, 4) + at(m, 1, i, 4) * at(m, 1, 3, 4) + at(m, 2, i, 4) * at(m, 2, 3, 4))
        rows += [at(m, 0, i, 4), at(m, 1, i, 4), at(m, 2, i, 4), back]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def mean_vector(vec: str | Column, dims: int) -> Column:
    """The element-wise average of a group's vectors, as one aggregate for each element."""
    return F.array(*[F.avg(_col(vec)[i]) for i in range(dims)])
