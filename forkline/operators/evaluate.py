"""Accuracy and cost of the policy next to three fixed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.operators.policy import RoutingPolicy, decide
from forkline.schemas import TEST


def decisions(splits: DataFrame, pairs: DataFrame, features: DataFrame, policy: RoutingPolicy,
              split: str = TEST) -> DataFrame:
    """Every query of the part with its grades, decision and, where there is none, the reason."""
    rows = (
        splits.filter(F.col("split") == split)
        .select("query_id")
        .join(pairs.select("query_id", "y_lo", "y_hi"), "query_id", "left")
        .join(features.select("query_id", *policy.columns()), "query_id", "left")
    )
    graded = F.col("y_lo").isNotNull() & F.col("y_hi").isNotNull()
    routed = decide(rows, policy)
    return routed.withColumn("skip_reason", F.when(~graded, "no result").otherwise(F.col("skip_reason")))


def report(decided: DataFrame, kappa: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row: counts, accuracy and average cost of the policy, of each model alone and of perfect hindsight.

    A call of the strong model costs ``kappa`` (1 if not given), the cheap one nothing.
    """
    k = 1.0 if kappa is None else float(kappa)
    ok = decided.filter(F.col("skip_reason").isNull())
    y_lo, y_hi, hi = F.col("y_lo"), F.col("y_hi"), F.col("use_strong")

    def rounded(c):
        return F.bround(c, 4)

    done = ok.groupBy(*by).agg(
        F.count("*").alias("n"),
        rounded(F.avg(F.when(hi, y_hi).otherwise(y_lo))).alias("acc_policy"),
        rounded(F.avg(y_lo)).alias("acc_always_lo"),
        rounded(F.avg(y_hi)).alias("acc_always_hi"),
        rounded(F.avg(F.greatest(y_lo, y_hi))).alias("acc_oracle"),
        rounded(F.avg(F.when(hi, F.lit(k)).otherwise(0.0))).alias("cost_policy"),
        rounded(F.avg(F.when((y_lo == 0) & (y_hi == 1), F.lit(k)).otherwise(0.0))).alias("cost_oracle"),
    )
    return done.withColumn("cost_always_lo", F.lit(0.0)).withColumn("cost_always_hi", F.lit(k))


def skipped(decided: DataFrame) -> DataFrame:
    return decided.filter(F.col("skip_reason").isNotNull()).select("query_id", "skip_reason")


def first_skipped(decided: DataFrame, n: int = 20) -> DataFrame:
    """The first skipped queries by id, as the report lists them."""
    return skipped(decided).orderBy("query_id").limit(n)


def skip_counts(decided: DataFrame) -> DataFrame:
    return skipped(decided).groupBy("skip_reason").agg(F.count("*").alias("n"))


# Names of the four policies in the report.
POINTS = (
    ("always_M_lo", "always_lo"), ("always_M_hi", "always_hi"), ("policy_pi", "policy"), ("oracle_pi_star", "oracle"),
)


def cost_points(made: DataFrame) -> DataFrame:
    """The report as four (name, accuracy, cost) rows."""
    items = [
        F.struct(F.lit(name).alias("name"), F.col(f"acc_{c}").alias("accuracy"), F.col(f"cost_{c}").alias("cost"))
        for name, c in POINTS
    ]
    return made.select(F.inline(F.array(*items)))
