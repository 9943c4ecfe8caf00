"""Fit a logistic threshold policy on calibration rows and apply it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forkline.functions.exprs import finite
from forkline.functions.linear import logit, sigmoid
from forkline.operators.newton import TOLERANCE, LinearFit, Task, fit_many
from forkline.operators.table import complete_cases
from forkline.schemas import (
    CALIB, CHI_COLS, LAYER_ALIASES, LAYER_QUERY, LAYER_RESPONSE, PHI_COLS, PSI_COLS, SEED, dotted, undotted,
)

# Schema version, scoring methods, number of thresholds tried.
POLICY_VERSION = "v1"
PROBABILITY, LOGIT = "logistic_probability", "logit"
THRESHOLD_STEPS = 100
LAYER_OF_KIND = {"phi": LAYER_QUERY, "psi": LAYER_RESPONSE}


@dataclass(frozen=True)
class RoutingPolicy:
    """At most a few dozen numbers; the strong model is used when ``score > threshold``."""

    feature_columns: tuple[str, ...]
    scaler_mean: tuple[float, ...]
    scaler_scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float = 0.0
    threshold: float = 0.5
    signal_layers: tuple[str, ...] = (LAYER_RESPONSE,)
    scoring_method: str = PROBABILITY
    pool_lo: str = "M_lo"
    pool_hi: str = "M_hi"
    schema_version: str = POLICY_VERSION
    training: dict[str, str] = field(default_factory=dict)

    def columns(self) -> tuple[str, ...]:
        return tuple(undotted(c) for c in self.feature_columns)

    def score(self) -> Column:
        z = logit([F.col(c) for c in self.columns()], self.scaler_mean, self.scaler_scale, self.weights, self.intercept)
        return sigmoid(z) if self.scoring_method == PROBABILITY else z


def normalise_layers(layers: Sequence[str]) -> tuple[str, ...]:
    return tuple(LAYER_ALIASES.get(x, x) for x in layers)


def kind(column: str) -> str:
    """The family of a signal column: what stands before the two underscores."""
    return column.partition("__")[0]


def runtime_columns(explicit: Sequence[str] | None = None, spec: dict | None = None,
                    include_query: bool = False) -> tuple[str, ...]:
    """Columns of a deployable policy: given ones, else those of a feature spec, else the cheap model's signals.

    Signals that need the strong model cannot be used before routing.
    """
    own = [*(PHI_COLS if include_query else ()), *PSI_COLS]
    sources = (explicit, (spec or {}).get("runtime_columns") or None, own)
    chosen = tuple(map(undotted, next(s for s in sources if s is not None)))
    if any(kind(c) == "chi" or c in CHI_COLS for c in chosen):
        raise ValueError("a runtime policy cannot use signals that compare both models")
    return chosen


class OneClassError(ValueError):
    """The rows of a fit hold one class only."""


def fit_logistic(rows: DataFrame, columns: Sequence[str], label: str = "r", tol: float = TOLERANCE) -> LinearFit:
    """Standardise with the population deviation, then class-balanced L2 logistic regression (C = 1).

    Rows must be complete; every round reads them again, so they should be stored.
    """
    made = rows.select(
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("int").alias("y"), F.array(F.lit(0)).alias("folds"))
    fit = fit_many(made, [Task(0, tuple(range(len(columns))))], tol)[0]
    if fit is None:
        raise OneClassError("two classes are needed")
    return fit


def threshold_steps_below(score: Column) -> Column:
    """How many of the thresholds 0.01, 0.02, …, 0.99 are strictly below the score, compared as doubles."""
    guess = F.floor(score * 100).cast("int")
    exact = (
        guess - 1
        + F.when(guess.cast("double") / 100.0 < score, 1).otherwise(0)
        + F.when((guess + 1).cast("double") / 100.0 < score, 1).otherwise(0)
    )
    return F.least(F.greatest(exact, F.lit(0)), F.lit(THRESHOLD_STEPS - 1))


def threshold_sweep(scored: DataFrame, score: str = "score", label: str = "r") -> DataFrame:
    """``(step, tau, accuracy)`` for 99 thresholds from one histogram of 100 cells.

    At threshold i every row with at least i thresholds below its score is
    routed to the strong model.
    """
    spark = scored.sparkSession
    cells = scored.groupBy(threshold_steps_below(F.col(score)).alias("step")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    grid = spark.range(0, THRESHOLD_STEPS, 1, 1).select(F.col("id").cast("int").alias("step"))
    every = grid.join(F.broadcast(cells), "step", "left").fillna(0, subset=["pos", "neg"])
    rest = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    right = F.sum("pos").over(rest) + F.coalesce(F.sum("neg").over(before), F.lit(0))
    return (
        every.withColumn("accuracy", F.try_divide(right, F.sum(F.col("pos") + F.col("neg")).over(all_rows)))
        .filter("step >= 1")
        .select("step", (F.col("step").cast("double") / 100.0).alias("tau"), "accuracy")
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold with the best accuracy, one row."""
    return sweep.orderBy(F.desc("accuracy"), F.asc("tau")).limit(1)


def fit_policy(table: DataFrame, columns: Sequence[str] | None = None, *, include_query: bool = False,
               pool: tuple[str, str] = ("M_lo", "M_hi"), seed: int = SEED) -> RoutingPolicy:
    """Scaler, weights and threshold from the calibration rows of the analysis table."""
    chosen = runtime_columns(columns, include_query=include_query)
    calib = table.filter(F.col("split") == CALIB)
    rows = complete_cases(calib, chosen).select(*chosen, "r").persist()
    try:
        if rows.count() < 10:
            raise ValueError("fewer than ten usable calibration rows")
        fit = fit_logistic(rows, chosen)
        draft = RoutingPolicy(
            tuple(dotted(c) for c in chosen), fit.mean, fit.scale, fit.weights, fit.intercept,
            pool_lo=pool[0], pool_hi=pool[1],
        )
        best = best_threshold(threshold_sweep(rows.select(draft.score().alias("score"), "r"))).first()
    finally:
        rows.unpersist()
    kinds = {kind(c) for c in chosen}
    layers = tuple(layer for family, layer in LAYER_OF_KIND.items() if family in kinds)
    return RoutingPolicy(
        draft.feature_columns, fit.mean, fit.scale, fit.weights, fit.intercept, best["tau"],
        layers or (LAYER_RESPONSE,), PROBABILITY, pool[0], pool[1],
        training={
            "split": CALIB, "method": "logistic_regression", "seed": str(seed), "n_calib": str(fit.n),
            "positive_rate": repr(fit.n_pos / fit.n), "calib_accuracy_at_tau": repr(best["accuracy"]),
            "excludes_cross_model": "true", "gradient_per_row": repr(fit.gradient), "newton_rounds": str(fit.rounds),
        },
    )


def decide(features: DataFrame, policy: RoutingPolicy) -> DataFrame:
    """Adds ``score, use_strong, model, skip_reason``. Works on tables and streams alike.

    A row that lacks a feature gets no decision but the name of the first
    missing column.
    """
    absent = [c for c in policy.columns() if c not in features.columns]
    if absent:
        raise KeyError(f"missing columns: {absent[:3]}")
    usable = {c: finite(F.col(c)) for c in policy.columns()}
    missing = F.coalesce(*[F.when(v.isNull(), F.lit(dotted(c))) for c, v in usable.items()])
    scored = features.withColumn("skip_reason", F.when(missing.isNotNull(), F.concat(F.lit("missing "), missing)))
    scored = scored.withColumn("score", F.when(F.col("skip_reason").isNull(), policy.score()))
    return scored.withColumn("use_strong", F.col("score") > F.lit(policy.threshold)).withColumn(
        "model", F.when(F.col("use_strong"), policy.pool_hi).when(~F.col("use_strong"), policy.pool_lo)
    )


def agreement(table: DataFrame, policy: RoutingPolicy) -> DataFrame:
    """How often the decision equals the routing need, over rows that can be scored."""
    decided = decide(table, policy).filter(F.col("score").isNotNull())
    return decided.agg(
        F.count("*").alias("n"),
        F.avg((F.col("use_strong").cast("int") == F.col("r")).cast("double")).alias("accuracy"),
        F.lit(policy.threshold).alias("threshold"),
    )
