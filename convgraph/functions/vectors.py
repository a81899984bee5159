"""Vector arithmetic on ``ARRAY<FLOAT>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector scaled to length one, as doubles."""
    # the norm is made once per vector, as the only element of an array that the scaling is applied to
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / n)), 1)
