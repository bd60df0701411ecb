"""Small matrices as ARRAY<ARRAY<DOUBLE>> of rows, vectors as ARRAY<DOUBLE>: Column expressions for the filter's algebra."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of x with x worked out once, however often it is mentioned."""
    return F.transform(F.array(x), use)[0]


def vector(*parts: Column | float) -> Column:
    return F.array(*[(p if isinstance(p, Column) else F.lit(p)).cast("double") for p in parts])


def rows(*parts: Column) -> Column:
    return F.array(*parts)


def diagonal(n: int, value: Column | float) -> Column:
    return rows(*[vector(*[value if i == j else 0.0 for j in range(n)]) for i in range(n)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def transpose(m: Column) -> Column:
    return let(m, lambda a: F.transform(F.sequence(F.lit(0), F.size(a[0]) - 1), lambda j: F.transform(a, lambda row: row[j])))


def product(a: Column, b: Column) -> Column:
    return let(transpose(b), lambda columns: F.transform(a, lambda row: F.transform(columns, lambda column: dot(row, column))))


def times(m: Column, v: Column) -> Column:
    return let(v, lambda x: F.transform(m, lambda row: dot(row, x)))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda r, s: F.zip_with(r, s, lambda x, y: x + y))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda r, s: F.zip_with(r, s, lambda x, y: x - y))


def scaled(m: Column, s: Column | float) -> Column:
    return F.transform(m, lambda row: F.transform(row, lambda x: x * s))


def added(a: Column, b: Column) -> Column:
    """Sum of vectors."""
    return F.zip_with(a, b, lambda x, y: x + y)


def skew(v: Column) -> Column:
    """The matrix of v x."""
    return let(v, lambda a: rows(vector(0.0, -a[2], a[1]), vector(a[2], 0.0, -a[0]), vector(-a[1], a[0], 0.0)))


def symmetric(m: Column) -> Column:
    return let(m, lambda a: scaled(plus(a, transpose(a)), 0.5))


def inverse(m: Column) -> Column:
    """In closed form, for 1 to 3 rows; null where the determinant is 0 or there are more rows."""

    def one(a: Column) -> Column:
        return rows(vector(1 / F.nullif(a[0][0], F.lit(0.0))))

    def two(a: Column) -> Column:
        d = F.nullif(a[0][0] * a[1][1] - a[0][1] * a[1][0], F.lit(0.0))
        return let(d, lambda d: rows(vector(a[1][1] / d, -a[0][1] / d), vector(-a[1][0] / d, a[0][0] / d)))

    def three(a: Column) -> Column:
        def cofactor(i: int, j: int) -> Column:
            (p, q), (r, s) = ((i + 1) % 3, (i + 2) % 3), ((j + 1) % 3, (j + 2) % 3)
            return a[p][r] * a[q][s] - a[p][s] * a[q][r]

        d = F.nullif(a[0][0] * cofactor(0, 0) + a[0][1] * cofactor(0, 1) + a[0][2] * cofactor(0, 2), F.lit(0.0))
        return let(d, lambda d: rows(*[vector(*[cofactor(j, i) / d for j in range(3)]) for i in range(3)]))

    def by_size(a: Column) -> Column:
        found = F.when(F.size(a) == 1, one(a)).when(F.size(a) == 2, two(a)).when(F.size(a) == 3, three(a))
        return F.when(F.get(F.get(found, F.lit(0)), F.lit(0)).isNotNull(), found)

    return let(m, by_size)
