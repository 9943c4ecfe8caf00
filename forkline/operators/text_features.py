"""Text signals of a query: lengths, lexical density, option overlap. One pass, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.functions.exprs import array_mean, let
from forkline.functions.text import (
    choice_lines, compression_ratio, mattr, pair_means, prompt_words, question_text, set_jaccard, strip, user_message, words,
)
from forkline.schemas import AMBIGUITY, MATTR_WINDOW, STRUCTURAL, ZLIB_LEVEL


WORDS = ("_text_words", "_choice_words")


def _with_words(queries: DataFrame) -> DataFrame:
    """Words of text and options, found once for all signals."""
    if set(WORDS) <= set(queries.columns):
        return queries
    return queries.withColumns({"_text_words": words(F.col("text")), "_choice_words": F.transform("choices", words)})


def structural(queries: DataFrame, *, window: int = MATTR_WINDOW, level: int = ZLIB_LEVEL,
               counter: Callable[[Column], Column] | None = None, with_compression: bool = True) -> DataFrame:
    """Adds ``phi__structural__*``.

    ``counter`` counts the tokens of a text column; by default words. A real
    tokenizer can be plugged in as a pandas UDF.
    """
    subject = F.try_element_at("metadata", F.lit("subject"))
    made = _with_words(queries)
    if counter is not None:
        # A Python counter cannot run inside a lambda; options are counted as rows of their own.
        made = _count_options(made, counter)
    question = question_text(F.col("text"), subject)
    made = made.withColumn("_t", F.struct(question.alias("question"), choice_lines(F.col("choices")).alias("lines")))
    made = made.withColumn("_question", F.col("_t.question")).withColumn(
        "_prompt", user_message(F.col("_t.question"), F.col("_t.lines"))
    )

    def spread_of(counts: Column) -> Column:
        """Mean, population deviation and total of a few counts, from exact integer sums."""
        sums = F.aggregate(
            counts,
            F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q")),
            lambda a, x: F.struct(
                (a["s"] + x).alias("s"), (a["q"] + x.cast("long") * x.cast("long")).alias("q")
            ),
        )

        def of(t: Column) -> Column:
            n = F.size(counts)
            return F.struct(
                F.coalesce(F.try_divide(t["s"], n), F.lit(0.0)).alias("mean"),
                F.when(n > 1, F.sqrt((n * t["q"] - t["s"] * t["s"]).cast("double")) / n).otherwise(0.0).alias("std"),
                F.when(t["s"] == 0, 1.0).otherwise(t["s"].cast("double")).alias("total"),
            )

        return let(sums, of)

    made = made.withColumns(
        {
            "_tokens": prompt_words(subject, F.col("_text_words"), F.col("_choice_words")),
            "_opt": let(F.transform("_choice_words", F.size) if counter is None else F.col("_option_counts"), spread_of),
        }
    )
    # The question is the prompt's subject line and the text.
    head_n = F.when(subject.isNotNull() & (subject != ""), F.size(words(F.concat(F.lit("Subject: "), subject)))).otherwise(0)
    question_n = head_n + F.size("_text_words") if counter is None else counter(F.col("_question"))
    prompt_n = F.size("_tokens") if counter is None else counter(F.col("_prompt"))
    made = made.withColumn("_q_n", question_n.cast("double"))
    values = {
        "prompt_token_len": prompt_n.cast("double"),
        "question_token_len": F.col("_q_n"),
        "mean_option_token_len": F.col("_opt.mean"),
        "std_option_token_len": F.col("_opt.std"),
        "question_option_ratio": F.col("_q_n") / F.col("_opt.total"),
        "mattr": mattr(F.col("_tokens"), window),
    }
    if with_compression:
        values["compression_ratio"] = compression_ratio(F.col("_prompt"), level)
    out = made.withColumns({f"phi__structural__{k}": values[k] for k in STRUCTURAL if k in values})
    made_here = [c for c in WORDS if c not in queries.columns]
    return out.drop("_t", "_question", "_prompt", "_tokens", "_q_n", "_opt", "_option_counts", *made_here)


def _count_options(queries: DataFrame, counter: Callable[[Column], Column]) -> DataFrame:
    """Token counts of each option with a counter that only takes plain columns (at most a few dozen options)."""
    per_option = (
        queries.select("query_id", F.posexplode("choices").alias("_pos", "_choice"))
        .withColumn("_n", counter(F.col("_choice")))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_n"))).alias("_c"))
        .select("query_id", F.transform("_c", lambda s: s["_n"]).alias("_option_counts"))
    )
    return queries.join(per_option, "query_id", "left").withColumn(
        "_option_counts", F.coalesce("_option_counts", F.array().cast("array<int>"))
    )


def ambiguity(queries: DataFrame) -> DataFrame:
    """Adds ``phi__ambiguity__*``: overlap of the text with its options and of the options with each other."""
    overlaps = let(
        F.array_distinct("_text_words"),
        lambda stem: let(
            F.transform("_choice_words", F.array_distinct),
            lambda sets: let(
                F.transform(sets, lambda s: set_jaccard(stem, s)),
                lambda j: F.struct(
                    F.coalesce(F.array_max(j), F.lit(0.0)).alias("max"),
                    F.coalesce(array_mean(j), F.lit(0.0)).alias("mean"),
                    pair_means(sets).alias("pairs"),
                ),
            ),
        ),
    )
    lengths = F.transform("choices", lambda c: F.char_length(strip(c)))
    spread = F.coalesce(F.array_max(lengths) - F.array_min(lengths), F.lit(0)).cast("double")
    made = _with_words(queries).withColumn("_overlap", overlaps)
    values = dict(zip(AMBIGUITY, (F.col("_overlap.max"), F.col("_overlap.mean"), F.col("_overlap.pairs"), spread)))
    return made.withColumns({f"phi__ambiguity__{k}": v for k, v in values.items()}).drop("_overlap", *[c for c in WORDS if c not in queries.columns])


def text_features(queries: DataFrame, **options) -> DataFrame:
    """``query_id`` and the eleven text signals."""
    made = ambiguity(structural(_with_words(queries), **options))
    return made.select("query_id", *[c for c in made.columns if c.startswith("phi__")])
