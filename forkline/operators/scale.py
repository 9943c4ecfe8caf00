"""Standardisation fitted on the calibration part only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.functions.exprs import finite
from forkline.schemas import CALIB


@dataclass(frozen=True)
class ZScore:
    """Mean and population deviation per column: two numbers per feature, kept on the driver."""

    mean: dict[str, float]
    std: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.std[c] or 1.0) for c in self.mean if c in df.columns}
        )

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(c, self.mean[c], self.std[c]) for c in self.mean], "feature string, mean double, std double"
        )


def fit_zscore(features: DataFrame, splits: DataFrame, columns: list[str] | None = None) -> ZScore:
    """One aggregate over the calibration rows. No values → (0, 1); a single value → deviation 1."""
    columns = columns or [c for c in features.columns if c.startswith("phi__")]
    if not columns:
        return ZScore({}, {})
    calib = features.join(splits.filter(F.col("split") == CALIB).select("query_id"), "query_id", "left_semi")
    row = calib.agg(
        *[F.avg(finite(F.col(c))).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(finite(F.col(c))).alias(f"s_{c}") for c in columns],
        *[F.count(finite(F.col(c))).alias(f"n_{c}") for c in columns],
    ).first()
    mean = {c: row[f"m_{c}"] if row[f"n_{c}"] else 0.0 for c in columns}
    std = {c: row[f"s_{c}"] if row[f"n_{c}"] > 1 else 1.0 for c in columns}
    return ZScore(mean, std)
