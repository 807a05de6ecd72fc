"""Column functions over vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is.

    The norm is repeated beside the values, not used inside the lambda, which
    would compute it again for every value.
    """
    norm = l2_norm(vector)
    scale = F.array_repeat(F.when(norm > 0, norm).otherwise(F.lit(1.0)), F.size(vector))
    return F.zip_with(vector, scale, lambda x, by: x.cast("double") / by)


def squared_l2(left: Column, right: Column) -> Column:
    gaps = F.zip_with(left, right, lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)
