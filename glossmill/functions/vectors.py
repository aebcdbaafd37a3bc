"""Vector expressions over ``array<double>`` columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.text import hash28


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """dot / (norm * norm), never above 1; null where it is undefined (a zero or missing vector)."""
    d, n = dot(a, b), norm(a) * norm(b)
    return F.when(n > 0, d / F.greatest(n, d))


def unit(a: Column) -> Column:
    """The vector by its norm; null for a zero or missing vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def unit_dot(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, never above 1; null if either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(dot(a, b), F.lit(1.0)))


def item_similarity(id_a: Column, id_b: Column, a: Column, b: Column) -> Column:
    """1 for the same item, even without a vector; null if either vector is missing."""
    return F.when(id_a == id_b, F.lit(1.0)).otherwise(cosine(a, b))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def random_vector(item: Column, dims: int, seed: int = 0) -> Column:
    """Numbers in [0, 1) that depend on the item, its place and the seed only, the same in any engine with md5."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: hash28(F.concat_ws("_", item, i.cast("string"), F.lit(str(seed)))) / F.lit(float(1 << 28)))


def as_text(v: Column) -> Column:
    """Six decimals, space-separated."""
    return F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x)), " ")
