"""Arrays of numbers as vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    """Divided by its norm, which is worked out once for all components; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    by = lambda n: F.transform(v, lambda x: x.cast("double") / n)
    return F.transform(F.array(F.when(norm == 0, 1.0).otherwise(norm)), by)[0]
