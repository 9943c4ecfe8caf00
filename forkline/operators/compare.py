"""Signals that compare both models on the same query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.schemas import HI, LO, PSI


def by_role(signals: DataFrame) -> DataFrame:
    """One row per query: ``psi__*`` of the cheap and ``psi_hi__*`` of the strong model, one shuffle for both."""

    def of(role: str, value) -> Column:
        return F.max(F.when(F.col("role") == role, value))

    # Plain numbers as aggregates keep this a hash aggregation.
    return signals.groupBy("query_id").agg(
        F.coalesce(of(LO, F.lit(True)), F.lit(False)).alias("has_lo"),
        F.coalesce(of(HI, F.lit(True)), F.lit(False)).alias("has_hi"),
        *[of(LO, F.col(m)).alias(f"psi__{m}") for m in PSI],
        *[of(HI, F.col(m)).alias(f"psi_hi__{m}") for m in PSI],
    )


def chi(wide: DataFrame, pairs: DataFrame) -> DataFrame:
    """``query_id`` and ``chi__*`` for queries with signals of both models.

    Differences are strong minus cheap; disagreement is about parsed answers and
    false where one of them is missing.
    """
    both = wide.filter("has_lo AND has_hi").join(pairs, "query_id")
    deltas = {
        f"chi__delta_{m}": F.col(f"psi_hi__{m}") - F.col(f"psi__{m}")
        for m in ("entropy", "margin", "mean_logprob", "msp")
    }
    differ = F.coalesce(F.col("parsed_lo") != F.col("parsed_hi"), F.lit(False))
    return both.select("query_id", *[v.alias(k) for k, v in deltas.items()], differ.alias("chi__prediction_disagreement"))


def require_comparable(wide: DataFrame, pairs: DataFrame) -> None:
    """At least one shared query, and graded results of both models for each of them."""
    both = wide.filter("has_lo AND has_hi").select("query_id")
    if not both.limit(1).collect():
        raise ValueError("no query has signals of both models")
    whole = pairs.filter(F.col("y_lo").isNotNull() & F.col("y_hi").isNotNull())
    lost = both.join(whole, "query_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no results of both models for {lost[0]['query_id']!r}")
