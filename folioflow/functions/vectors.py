"""Vector and hash expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def difference_hash(pixels: Column) -> Column:
    """A 64-bit hash of a 9x8 grey image in rows: a bit for every pixel brighter than its right neighbour. Pixels that are null or missing give none."""
    left = F.array(*[F.lit(row * 9 + k) for row in range(8) for k in range(8)])
    return once(pixels, lambda p: F.aggregate(left, F.lit(0).cast("long"), lambda bits, at: F.shiftleft(bits, 1).bitwiseOR(_brighter(p, at))))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value made once a row however often `then` looks at it: an expression inside a lambda is made anew for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def _brighter(pixels: Column, at: Column) -> Column:
    return F.when(F.get(pixels, at) > F.get(pixels, at + 1), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
