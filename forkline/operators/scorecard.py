"""Routing buckets, feasibility scorecard, gates, and the choice of a corpus."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forkline.functions.exprs import three_places
from forkline.functions.grading import bucket
from forkline.schemas import BUCKETS, GATES, TIE_BREAK


def bucket_counts(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by, bucket(F.col("y_lo"), F.col("y_hi")).alias("bucket")).agg(F.count("*").alias("n"))


def raw_scorecard(pairs: DataFrame, by: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """Unrounded rates and gates per group; both accuracies over the same rows. ``more`` are further aggregates."""
    b = bucket(F.col("y_lo"), F.col("y_hi"))
    rates = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("y_lo").alias("acc_lo"),
        F.avg("y_hi").alias("acc_hi"),
        *[F.count_if(b == name).alias(f"n_{name}") for name in BUCKETS],
        *more,
    )
    return (
        rates.withColumn("acc_gap", F.col("acc_hi") - F.col("acc_lo"))
        .withColumn("opportunity_rate", F.try_divide("n_opportunity", "n"))
        .withColumn("too_hard_rate", F.try_divide("n_too_hard", "n"))
    )


def scorecard(pairs: DataFrame, by: tuple[str, ...] = (), gates: dict[str, float] = GATES,
              more: tuple[Column, ...] = ()) -> DataFrame:
    """Rates to four places; gates are decided on the unrounded values."""
    raw = raw_scorecard(pairs, by, more)
    rate_cols = ("acc_lo", "acc_hi", "acc_gap", "opportunity_rate", "too_hard_rate")
    gated = raw.withColumns(
        {
            "gate_c_pass": F.col("acc_gap") >= gates["min_accuracy_gap"],
            "gate_d_pass": (F.col("opportunity_rate") >= gates["opportunity_min"])
            & (F.col("too_hard_rate") < gates["too_hard_max"]),
        }
    )
    return gated.withColumns({c: F.bround(c, 4) for c in rate_cols})


def gate_messages(cards: DataFrame, gates: dict[str, float] = GATES, grading: str = "mcq") -> DataFrame:
    """Adds ``passed`` and ``failed``: one line per gate and outcome."""
    # The wording and number formats of the lines.
    gate_a_pass = "gate_a: objective_mcq grading"
    gate_a_fail = "gate_a: grading is not mcq"
    gate_b_pass = "gate_b: frozen protocol layers (Phase A defaults)"
    gap_line = "gate_c: acc_gap={gap} {op} {min_gap} (acc_lo={lo}, acc_hi={hi})"
    both_line = "gate_d: opportunity_rate={opp} >= {opportunity_min}, too_hard_rate={hard} < {too_hard_max}"
    few_line = "gate_d: opportunity_rate={opp} < {opportunity_min}"
    hard_line = "gate_d: too_hard_rate={hard} >= {too_hard_max}"

    opp, hard = F.col("opportunity_rate"), F.col("too_hard_rate")
    c, d = F.col("gate_c_pass"), F.col("gate_d_pass")
    slots = {
        "gap": F.col("acc_gap"), "lo": F.col("acc_lo"), "hi": F.col("acc_hi"), "opp": opp, "hard": hard,
        "min_gap": F.lit(float(gates["min_accuracy_gap"])),
    }

    def line(template: str, **texts) -> Column:
        """Fill number slots with three places and text slots as they are."""
        pieces = [
            (F.lit(head), three_places(slots[name]) if name in slots else F.lit(str({**gates, **texts}[name])))
            if name else (F.lit(head),)
            for head, name, _, _ in Formatter().parse(template)
        ]
        return F.concat(*[x for piece in pieces for x in piece])

    mcq = grading == "mcq"
    passed = [
        F.lit(gate_a_pass if mcq else None),
        F.lit(gate_b_pass),
        F.when(c, line(gap_line, op=">=")),
        F.when(d, line(both_line)),
    ]
    failed = [
        F.lit(None if mcq else gate_a_fail),
        F.when(~c, line(gap_line, op="<")),
        F.when(~d & (opp < gates["opportunity_min"]), line(few_line)),
        F.when(~d & (hard >= gates["too_hard_max"]), line(hard_line)),
    ]

    def lines(items: list[Column]) -> Column:
        return F.array_compact(F.array(*[i.cast("string") for i in items]))

    return cards.withColumn("passed", lines(passed)).withColumn("failed", lines(failed))


def latest_per_dataset(cards: DataFrame, order: str = "run_id") -> DataFrame:
    """The newest scorecard of every dataset by time stamp text; among equals the first run in order."""
    ranked = Window.partitionBy("dataset").orderBy(F.coalesce("timestamp", F.lit("")).desc(), F.asc(order))
    return (
        cards.filter(F.coalesce("dataset", F.lit("")) != "")
        .withColumn("_rn", F.row_number().over(ranked))
        .filter("_rn = 1")
        .drop("_rn")
    )


def ranked_candidates(cards: DataFrame, prefer: tuple[str, ...] = (), order: tuple[str, ...] = TIE_BREAK) -> DataFrame:
    """Candidates that pass both gates, best first: metrics descending, then place in ``prefer``."""
    places = F.array(*[F.lit(p) for p in prefer]) if prefer else F.array().cast("array<string>")
    place = F.coalesce(F.nullif(F.array_position(places, F.col("dataset")), F.lit(0)), F.lit(len(prefer) + 1))
    return (
        cards.filter("gate_c_pass AND gate_d_pass")
        .withColumn("preference", place.cast("int"))
        .orderBy(*[F.coalesce(F.col(m), F.lit(0.0)).desc() for m in order], "preference", "dataset")
    )


def winner(cards: DataFrame, prefer: tuple[str, ...] = (), order: tuple[str, ...] = TIE_BREAK) -> DataFrame:
    """At most one row: the dataset to go on with."""
    return ranked_candidates(cards, prefer, order).limit(1)
