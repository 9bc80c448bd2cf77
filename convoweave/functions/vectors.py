"""Vector columns (array<float>) in double precision, inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    other = b if isinstance(b, Column) else F.array(*(F.lit(float(x)) for x in b))
    return F.aggregate(F.zip_with(a, other, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    # the length is an element of an array, since a lambda works out anew for each component what is not bound outside
    return F.transform(F.array(norm(a)), lambda size: F.transform(a, lambda x: x.cast("double") / F.when(size == 0, F.lit(1.0)).otherwise(size)))[0]


def int8(a: Column) -> Column:
    """Components times 127, rounded half away from zero and clipped, as small integers."""
    return F.transform(a, lambda x: F.least(F.greatest(F.round(x.cast("double") * 127), F.lit(-127.0)), F.lit(127.0)).cast("int"))
