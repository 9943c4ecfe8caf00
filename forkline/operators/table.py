"""The wide analysis table: labels and all signals, one row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.functions.exprs import finite
from forkline.functions.grading import bucket, routing_need
from forkline.schemas import CALIB, CHI_COLS, FEATURE_COLS, LABEL_COLS, PHI_COLS, PSI_COLS, PSI_HI_COLS, TEST, dotted


def analysis_table(splits: DataFrame, pairs: DataFrame, phi: DataFrame, psi_wide: DataFrame,
                   chi: DataFrame, parts: tuple[str, ...] = (CALIB, TEST)) -> DataFrame:
    """Calibration and test queries graded for both models, with every signal that exists.

    Each input is keyed by ``query_id``; signals that are missing, NaN or
    infinite become NULL. The joins share one key, so once the sides are
    partitioned by it no row moves again.
    """
    graded = pairs.filter(F.col("y_lo").isNotNull() & F.col("y_hi").isNotNull()).select("query_id", "y_lo", "y_hi")
    base = splits.filter(F.col("split").isin(*parts)).join(graded, "query_id")

    def side(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return df.select("query_id", *[c for c in columns if c in df.columns])

    wide = (
        base.join(side(phi, PHI_COLS), "query_id", "left")
        .join(side(psi_wide, PSI_COLS + PSI_HI_COLS), "query_id", "left")
        .join(side(chi, CHI_COLS), "query_id", "left")
    )
    labels = {"r": routing_need(F.col("y_lo"), F.col("y_hi")), "bucket": bucket(F.col("y_lo"), F.col("y_hi"))}
    wide = wide.withColumns(labels)
    return wide.select(
        *LABEL_COLS,
        *[(finite(F.col(c)) if c in wide.columns else F.lit(None).cast("double")).alias(c) for c in FEATURE_COLS],
    )


def exported(table: DataFrame) -> DataFrame:
    """The same table under the dotted names used outside."""
    return table.toDF(*[dotted(c) for c in table.columns])


def complete_cases(table: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Rows where every column holds a usable number."""
    as_numbers = table.withColumns({c: number(c, table) for c in columns})
    return as_numbers.dropna(subset=list(columns))


def number(column: str, table: DataFrame) -> Column:
    kind = dict(table.dtypes)[column]
    value = F.expr(f"try_cast(`{column}` AS double)") if kind == "string" else F.col(column)
    return finite(value)


def table_meta(table: DataFrame) -> DataFrame:
    return table.groupBy("split").agg(F.count("*").alias("n_queries"), F.avg("r").alias("positive_rate"))
