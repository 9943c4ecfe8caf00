"""Corpus preparation: normalise, drop invalid rows, subsample by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forkline.functions.text import strip
from forkline.operators.hash_order import first_per_group
from forkline.schemas import SEED
from forkline.session import stage


def normalise_rows(queries: DataFrame) -> DataFrame:
    return queries.withColumns(
        {
            "text": strip(F.col("text")),
            "choices": F.transform("choices", strip),
            "answer_index": F.col("answer_index").cast("int"),
        }
    )


def is_valid() -> Column:
    """Decided on the raw columns, so that a reader of ids alone never builds the trimmed texts."""
    n = F.size("choices")
    return F.coalesce(
        (strip(F.col("text")) != "") & (n >= 2) & (F.col("answer_index") >= 0) & (F.col("answer_index") < n),
        F.lit(False),
    )


def clean(queries: DataFrame) -> DataFrame:
    """Normalised rows with a text, at least two choices and an answer among them."""
    return normalise_rows(queries.filter(is_valid()))


def stratum(metadata_key: str | None) -> Column:
    """The metadata value, or 'unknown' where it is missing; without a key the dataset name."""
    if metadata_key is None:
        return F.col("dataset")
    return F.coalesce(F.try_element_at("metadata", F.lit(metadata_key)), F.lit("unknown"))


def stratum_quotas(strata: DataFrame, target: int, column: str = "stratum") -> DataFrame:
    """Largest-remainder shares of ``target`` rows per stratum: ``(stratum, n, quota)``.

    The windows run over one row per stratum, not over the corpus. Exact in
    integers: share = target·n / total, its remainder decides who gets the rest.
    """
    counts = strata.groupBy(column).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    product = F.lit(target).cast("decimal(38,0)") * F.col("n").cast("decimal(19,0)")
    shares = (
        counts.withColumn("_total", F.sum("n").over(every))
        .withColumn("_base", F.floor(product / F.col("_total")).cast("long"))
        .withColumn("_rest", (product % F.col("_total").cast("decimal(19,0)")).cast("long"))
        .withColumn("_open", F.lit(target) - F.sum("_base").over(every))
    )
    turn = F.row_number().over(Window.orderBy(F.desc("_rest"), F.asc(column)))
    return shares.select(
        column, "n",
        F.when(F.col("_total") <= target, F.col("n"))
        .otherwise(F.col("_base") + (turn <= F.col("_open")).cast("long")).alias("quota"),
    )


def stratified_ids(queries: DataFrame, target: int, metadata_key: str | None, seed: int = SEED) -> DataFrame:
    """``(query_id, stratum)`` of a subsample of exactly ``target`` rows (all rows if there are fewer)."""
    strata = queries.select("query_id", stratum(metadata_key).alias("stratum"))
    quotas = stratum_quotas(strata, target).select("stratum", "quota")
    return first_per_group(strata, "stratum", quotas, seed)


def prepare(queries: DataFrame, *, subsample_when_above: int | None = None, target_size: int | None = None,
            stratify_by: str | None = None, seed: int = SEED) -> tuple[DataFrame, dict[str, int]]:
    """Clean rows, subsampled only when there are more than ``subsample_when_above``, and the row counters."""
    counted = queries.agg(
        F.count("*").alias("n_loaded"), F.count_if(is_valid()).alias("n_after_clean")
    ).first()
    cleaned = clean(queries)
    meta = {
        "n_loaded": counted["n_loaded"],
        "n_dropped_invalid": counted["n_loaded"] - counted["n_after_clean"],
        "n_after_clean": counted["n_after_clean"],
        "n_final": counted["n_after_clean"],
        "subsampled": 0,
    }
    if subsample_when_above is not None and target_size is not None and meta["n_after_clean"] > subsample_when_above:
        # Stored, so that its known size lets the texts stay where they are.
        ids = stage(stratified_ids(cleaned, target_size, stratify_by, seed).select("query_id"), "subsample")
        cleaned = cleaned.join(ids, "query_id", "left_semi")
        meta.update(n_final=min(target_size, meta["n_after_clean"]), subsampled=1)
    return cleaned, meta


def counters(queries: DataFrame) -> DataFrame:
    """One row: loaded, dropped, clean rows, and ids that occur more than once among the clean ones.

    One aggregate per id first, so a repeated id cannot pile up in one task.
    """
    per_id = queries.groupBy("query_id").agg(
        F.count("*").alias("_n"), F.count_if(is_valid()).alias("_ok")
    )
    return per_id.agg(
        F.sum("_n").alias("n_loaded"),
        F.sum(F.col("_n") - F.col("_ok")).alias("n_dropped_invalid"),
        F.sum("_ok").alias("n_after_clean"),
        F.count_if(F.col("_ok") > 1).alias("n_duplicate_ids"),
    )
