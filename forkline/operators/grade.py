"""Grading of stored model output, pending work, upserts and per-split bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.functions.grading import is_correct, parsed_answer, prompt_digest
from forkline.functions.scores import has_trace
from forkline.functions.text import chat_messages, question_text, user_message, choice_lines
from forkline.operators.response import known_protocols
from forkline.schemas import HI, LO


def prompts(queries: DataFrame) -> DataFrame:
    """``(query_id, user_message, messages, prompt_sha256)`` for every query."""
    subject = F.try_element_at("metadata", F.lit("subject"))
    user = user_message(question_text(F.col("text"), subject), choice_lines(F.col("choices")))
    return queries.select("query_id", user.alias("user_message")).select(
        "query_id",
        "user_message",
        chat_messages(F.col("user_message")).alias("messages"),
        prompt_digest(F.col("user_message")).alias("prompt_sha256"),
    )


def grade(outputs: DataFrame, queries: DataFrame) -> DataFrame:
    """Parse the answer out of ``raw_output`` and compare it with the key.

    Of ``queries`` the answer key and ``n_choices`` are needed, or the choices themselves. Outputs without a query are
    dropped; all columns of ``outputs`` are kept.
    """
    n_choices = F.col("n_choices") if "n_choices" in queries.columns else F.size("choices")
    keys = queries.select("query_id", n_choices.alias("_n"), F.col("answer_index").alias("_key"))
    parsed = parsed_answer(F.col("raw_output"), F.col("_n"))
    return (
        outputs.join(keys, "query_id")
        .withColumn("parsed_answer", parsed)
        .withColumn("correct", is_correct(F.col("parsed_answer"), F.col("_key")))
        .drop("_n", "_key")
    )


def pending(queries: DataFrame, results: DataFrame, roles: tuple[str, ...] = (LO, HI), force: bool = False) -> DataFrame:
    """``(query_id, role)`` pairs that still need a model run."""
    wanted = queries.select("query_id", F.explode(F.array(*[F.lit(r) for r in roles])).alias("role"))
    if force:
        return wanted
    response = F.col("model_response")
    done = results.filter(has_trace(response["trace"], response["protocol_version"], known_protocols()))
    return wanted.join(done.select("query_id", "role"), ["query_id", "role"], "left_anti")


def upsert(cached: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("query_id", "role")) -> DataFrame:
    """Rows of ``new`` replace cached rows with the same key."""
    both = cached.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return newest(both, keys, "_age").drop("_age")


def newest(rows: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """Per key the row with the highest version; partial aggregation keeps hot keys small.

    Of rows with the same version the one with the greatest other values is taken, column by column; maps have no
    order and do not count.
    """
    rest = [c for c in rows.columns if c not in keys]
    ordered = [c for c, kind in rows.dtypes if c in rest and c != version and "map<" not in kind and kind != "variant"]
    best = F.max_by(F.struct(*rest), F.struct(version, *ordered))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def in_requested_order(results: DataFrame, requested: DataFrame, position: str = "position") -> DataFrame:
    """For the sink: requested ids first, in their order, then the others by id."""
    return (
        results.join(requested.select("query_id", position), "query_id", "left")
        .orderBy(F.col(position).asc_nulls_last(), "query_id")
        .drop(position)
    )


def pair(results: DataFrame) -> DataFrame:
    """One row per query with both models' grades: ``y_lo, y_hi, parsed_lo, parsed_hi`` (NULL where missing)."""

    def of(role: str, column: str):
        return F.max(F.when(F.col("role") == role, F.col(column)))

    return results.groupBy("query_id").agg(
        of(LO, "correct").alias("y_lo"),
        of(HI, "correct").alias("y_hi"),
        of(LO, "parsed_answer").alias("parsed_lo"),
        of(HI, "parsed_answer").alias("parsed_hi"),
    )


def bundles(results: DataFrame, splits: DataFrame, parts: tuple[str, ...] | None = None) -> DataFrame:
    """Results with their split, ready for ``partitionBy('split')``."""
    wanted = splits if parts is None else splits.filter(F.col("split").isin(*parts))
    return results.join(wanted, "query_id")


def missing_results(results: DataFrame, splits: DataFrame) -> DataFrame:
    """``(query_id, split)`` of queries that lack the result of one of the models."""
    whole = pair(results).filter(F.col("y_lo").isNotNull() & F.col("y_hi").isNotNull())
    return splits.join(whole.select("query_id"), "query_id", "left_anti")


def write_bundles(results: DataFrame, splits: DataFrame, path: str) -> None:
    """One folder per split. A query without both results is an error."""
    lost = missing_results(results, splits).limit(1).collect()
    if lost:
        raise ValueError(f"no result of both models for {lost[0]['query_id']!r}")
    bundles(results, splits).write.mode("overwrite").partitionBy("split").parquet(path)
