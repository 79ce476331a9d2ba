"""Arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: Column, c: Column | float) -> Column:
    return F.transform(a, lambda x: x * c)


def halves(a: Column) -> tuple[Column, Column]:
    """Real and imaginary parts of a complex vector laid out as two halves."""
    half = (F.size(a) / 2).cast("int")
    return F.slice(a, F.lit(1), half), F.slice(a, half + 1, half)


def complex_hadamard(a: Column, b: Column) -> Column:
    (ar, ai), (br, bi) = halves(a), halves(b)
    real = F.zip_with(hadamard(ar, br), hadamard(ai, bi), lambda x, y: x - y)
    imaginary = add(hadamard(ar, bi), hadamard(ai, br))
    return F.concat(real, imaginary)


def dot(a: Column, b: Column) -> Column:
    return total(hadamard(a, b))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def pair_distance(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Length of a - b + eps, as a positive pair is scored."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y + eps) * (x - y + eps))))


def distance(a: Column, b: Column) -> Column:
    """Length of a - b, at least 1e-4."""
    return F.sqrt(F.greatest(squared_distance(a, b), F.lit(1e-8)))


def cosine(a: Column, b: Column, normalize: bool = False) -> Column:
    """The dot product, divided by the lengths only if asked: the engine this is held against leaves them out."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))) if normalize else dot(a, b)


def dimension(df: DataFrame, column: str = "emb") -> int:
    """Length of the vectors of ``column``, as the first row has it; all rows have the same."""
    row = df.select(F.size(column)).first()
    return row[0] if row else 0


def sum_vectors(column: str, dim: int) -> Column:
    """Aggregate: sums by position, one row for a group and task whatever the dimension."""
    return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(dim)])


def max_vectors(column: str, dim: int) -> Column:
    return F.array(*[F.max(F.get(column, F.lit(i))) for i in range(dim)])
