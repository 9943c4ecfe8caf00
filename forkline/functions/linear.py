"""Linear scoring as plain column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def logit(columns: Sequence[Column], mean: Sequence[float], scale: Sequence[float], weights: Sequence[float],
          intercept: float) -> Column:
    """``intercept + Σ weight·(x − mean)/scale``; a zero scale counts as one."""
    if not len(columns) == len(mean) == len(scale) == len(weights):
        raise ValueError("feature dimension mismatch")
    total = F.lit(0.0)
    for x, m, s, w in zip(columns, mean, scale, weights):
        total = total + F.lit(float(w)) * ((x - F.lit(float(m))) / F.lit(float(s) or 1.0))
    return F.lit(float(intercept)) + total


def sigmoid(z: Column) -> Column:
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + small)).otherwise(small / (F.lit(1.0) + small))
