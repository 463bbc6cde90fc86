"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_finite_vector(vector: Column) -> Column:
    """Whether there is a vector, not empty, without a null, NaN or infinite component; never null."""
    finite = F.forall(vector, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN is above all numbers
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))
