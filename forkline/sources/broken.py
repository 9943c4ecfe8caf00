"""One pass that parts good rows from broken ones, with a reason for each."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline.session import stage

REASON = "_reason"


@dataclass(frozen=True)
class Parted:
    """Both sides of one stored table: the rows are judged once, whichever side is read and however often."""

    good: DataFrame
    errors: DataFrame

    def reasons(self) -> DataFrame:
        return self.errors.groupBy(F.col(REASON).alias("reason")).agg(F.count("*").alias("n"))

    def require(self, what: str, key: str) -> DataFrame:
        """The good rows, or an error that names the first broken one."""
        first = self.errors.orderBy(key).limit(1).collect()
        if first:
            raise ValueError(f"{what}: {first[0][REASON]} in {first[0][key]!r}")
        return self.good


def part(rows: DataFrame, reasons: Mapping[str, Column], name: str = "parted") -> Parted:
    """Rows for which no condition holds, and the others with the name of the first that does. NULL does not hold."""
    found = F.coalesce(*[F.when(condition, F.lit(reason)) for reason, condition in reasons.items()])
    judged = stage(rows.withColumn(REASON, found), name)
    return Parted(judged.filter(F.col(REASON).isNull()).drop(REASON), judged.filter(F.col(REASON).isNotNull()))


def part_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> Parted:
    """JSON lines as rows; lines that are no object of the schema, or lack a required field, as errors with their text.

    Only "\\n" ends a line and blank lines are skipped. The reasons are ``malformed`` and ``no <field>``. A line is
    parsed once: a value of another type than the schema's makes the whole line malformed, a field that is no part of
    the schema does not.
    """
    fields = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_line", T.StringType())])
    lines = spark.read.option("lineSep", "\n").text(path).filter(F.trim("value", F.lit(" \t\r")) != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}
    parsed = lines.select("value", F.from_json("value", fields, options).alias("row"))
    whole = parsed.select(F.col("value").alias("_text"), "row.*")
    reasons = {"malformed": F.col("_line").isNotNull(), **{f"no {c}": F.col(c).isNull() for c in required}}
    made = part(whole, reasons, "json-lines")
    return Parted(made.good.drop("_line", "_text"), made.errors.select(F.col("_text").alias("line"), REASON))
