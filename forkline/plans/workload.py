"""How the given tables play the roles of the jobs' inputs. Whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.functions.exprs import let, letter
from forkline.operators import compare, corpus, geometry, grade, response, scale, split, text_features
from forkline.operators.policy import RoutingPolicy
from forkline.operators.table import analysis_table
from forkline.schemas import HI, LO
from forkline.session import scratch_path, side_by_side, spread, stage
from forkline.sources.tables import read_splits, write_splits

# Sizes small enough for the smallest data set; the fractions are the usual ones.
RULE = split.SplitRule(holdout_n=40, test_fraction=0.20, test_min=20, test_max=1000)
SUBSAMPLE = 120
N_OPTIONS = 8
SCORE_SPREAD = 20.0
GENERATED_MAX = 8
EOS_IDS = (0, 7)

# A fixed policy, so that routing can be checked without a fit.
FIXED_POLICY = RoutingPolicy(
    feature_columns=("psi.entropy", "psi.margin", "psi.msp", "psi.top_probability_ratio"),
    scaler_mean=(1.75, 0.15, 0.3, 2.0),
    scaler_scale=(0.2, 0.1, 0.1, 0.0),
    weights=(0.8, -0.5, -0.3, 0.05),
    intercept=0.1,
    threshold=0.55,
    pool_lo="cheap",
    pool_hi="strong",
)
KAPPA = 2.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query_id(number: Column) -> Column:
    return F.concat(F.lit("documents:"), number.cast("string"))


def _as_question(text: Column) -> Column:
    """A text as a question with four options: the last half of its words in four equal runs.

    Every word is used. Texts of fewer than eight words get no option.
    """

    def of(words: Column) -> Column:
        n = F.size(words)
        run = F.floor(n / 8).cast("int")
        options = F.transform(
            F.sequence(F.lit(0), F.lit(3)),
            lambda i: F.array_join(F.slice(words, n - run * 4 + i * run + 1, run), " "),
        )
        return F.struct(
            F.array_join(F.slice(words, 1, n - run * 4), " ").alias("text"),
            F.when(run > 0, options).otherwise(F.array().cast("array<string>")).alias("choices"),
        )

    return let(F.split(text, " "), of)


def _questions(rows: DataFrame, number: str, dataset: str, subject: Column) -> DataFrame:
    # inline() of a one-element array computes text and options once per row,
    # whatever filters and projections follow.
    return rows.select(number, subject.alias("_subject"), F.inline(F.array(_as_question(F.col("text"))))).select(
        F.concat(F.lit(f"{dataset}:"), F.col(number).cast("string")).alias("query_id"),
        F.lit(dataset).alias("dataset"),
        "text",
        "choices",
        F.pmod(number, F.lit(4)).cast("int").alias("answer_index"),
        F.when(F.col("_subject").isNotNull(), F.create_map(F.lit("subject"), F.col("_subject"))).alias("metadata"),
    )


def raw_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spread(table(spark, sf, "documents")), "doc_id", "documents", F.col("lang"))


def second_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(table(spark, sf, "benchmark"), "item_id", "benchmark", F.lit(None).cast("string"))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.clean(raw_queries(spark, sf))


def splits(spark: SparkSession, sf: str) -> DataFrame:
    return split.assign(queries(spark, sf), RULE)


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Stored answers of both models: right where the label says so, in three ways of writing."""
    labels = table(spark, sf, "labels")
    key = F.pmod("doc_id", F.lit(4))
    told = letter(F.pmod(key + 1 - F.col("_ok"), F.lit(4)).cast("int"))
    style = F.pmod("doc_id", F.lit(3))
    written = (
        F.when(style == 0, told)
        .when(style == 1, F.concat(F.lit("("), told, F.lit(") because")))
        .otherwise(F.concat(F.lit("\n\n "), F.lower(told), F.lit(" ")))
    )
    both = labels.select(
        "doc_id",
        F.inline(
            F.array(
                F.struct(F.lit(LO).alias("role"), F.lit("cheap").alias("model"), F.col("toxic").alias("_ok")),
                F.struct(F.lit(HI).alias("role"), F.lit("strong").alias("model"), F.col("quality").alias("_ok")),
            )
        ),
    )
    return both.select(query_id(F.col("doc_id")).alias("query_id"), "role", "model", written.alias("raw_output"))


def _spellings() -> list[str]:
    return [s for i in range(N_OPTIONS) for c in (chr(65 + i),) for s in (f" {c}", c, f" {c.lower()}", c.lower())]


def _best_letter(scores: Column) -> Column:
    return letter((F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Stored scores of both models from the halves of each vector.

    Cheap model: 32 first-token log-probabilities, four spellings of eight
    letters. Strong model: eight option scores, four numbers each.
    """
    x = F.transform("embedding", lambda v: v.cast("double") * SCORE_SPREAD)
    lo_map = F.map_from_arrays(F.array(*[F.lit(s) for s in _spellings()]), F.slice("x", 1, 4 * N_OPTIONS))
    four = F.sequence(F.lit(0), F.lit(N_OPTIONS - 1))
    lo_best = F.transform(four, lambda i: F.array_max(F.slice(F.col("x"), i * 4 + 1, 4)))
    hi_scores = F.transform(
        four,
        lambda i: F.aggregate(F.slice(F.col("x"), i * 4 + 1 + 4 * N_OPTIONS, 4), F.lit(0.0), lambda a, v: a + v) / 4,
    )
    labels = F.array(*[F.lit(chr(65 + i)) for i in range(N_OPTIONS)])
    no_map = F.lit(None).cast("map<string,double>")
    generation = "struct<generated_text:string,finish_reason:string,generated_token_ids:array<int>,generated_token_logprobs:array<double>>"
    cand = "struct<labels:array<string>,scores:array<double>,ranking:array<string>,option_count:int>"

    def response(letter_: Column, candidates: Column, by_token: Column) -> Column:
        trace = F.struct(
            F.lit(N_OPTIONS).alias("n_choices"), letter_.alias("predicted_letter"),
            candidates.cast(cand).alias("candidates"), no_map.alias("choice_logprobs"),
            by_token.alias("candidate_token_logprobs"), F.lit(None).cast(generation).alias("generation"),
        )
        return F.struct(F.lit("mcq_letter").alias("protocol_version"), trace.alias("trace"))

    based = table(spark, sf, "embeddings").select("vec_id", x.alias("x")).select(
        "vec_id", "x", lo_best.alias("lo_best"), hi_scores.alias("hi")
    )
    candidates = F.struct(
        labels.alias("labels"), F.col("hi").alias("scores"), labels.alias("ranking"), F.lit(N_OPTIONS).alias("option_count")
    )
    lo = response(_best_letter(F.col("lo_best")), F.lit(None), lo_map)
    hi = response(_best_letter(F.col("hi")), candidates, no_map)
    roles = F.array(
        F.struct(F.lit(LO).alias("role"), lo.alias("model_response")),
        F.struct(F.lit(HI).alias("role"), hi.alias("model_response")),
    )
    return based.select(query_id(F.col("vec_id")).alias("query_id"), F.inline(roles))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Graded answers with the stored scores where there are any."""
    graded = grade.grade(outputs(spark, sf), queries(spark, sf))
    return graded.join(traces(spark, sf), ["query_id", "role"], "left")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return grade.pair(grade.grade(outputs(spark, sf), queries(spark, sf)))


def psi(spark: SparkSession, sf: str, temperature: float = 1.0) -> DataFrame:
    return response.psi(traces(spark, sf), temperature, strict=False)


def psi_wide(spark: SparkSession, sf: str) -> DataFrame:
    return compare.by_role(psi(spark, sf))


def chi(spark: SparkSession, sf: str) -> DataFrame:
    return compare.chi(psi_wide(spark, sf), pairs(spark, sf))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(query_id(F.col("vec_id")).alias("query_id"), "embedding")


def stored_corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Answer keys of the clean queries, and their parts, as stored tables; texts stay where they are."""
    keys = queries(spark, sf).select("query_id", F.size("choices").alias("n_choices"), "answer_index")
    q = stage(keys, "keys")
    path = scratch_path(spark, "splits")
    write_splits(split.assign(q, RULE), path)
    return q, read_splits(spark, path)


def phi_text(q: DataFrame, s: DataFrame, **options) -> DataFrame:
    return text_features.text_features(split.eval_rows(q, s), **options)


def phi_scaled(spark: SparkSession, sf: str, q: DataFrame, s: DataFrame) -> DataFrame:
    """Stored before the fit: the signals are read once to fit and once to scale."""
    text, geo = side_by_side(
        spark, [lambda: stage(phi_text(q, s), "phi-text"), lambda: geometry.geometry(vectors(spark, sf), s)]
    )
    raw = stage(text.join(geo, "query_id", "left"), "phi-raw")
    return scale.fit_zscore(raw, s).transform(raw)


def analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table, stored: validation, probes and the policy fit all read it."""
    q, s = stored_corpus(spark, sf)
    p, wide, phi = side_by_side(
        spark,
        [
            lambda: stage(grade.pair(grade.grade(outputs(spark, sf), q)), "pairs"),
            lambda: stage(psi_wide(spark, sf), "psi-wide"),
            lambda: phi_scaled(spark, sf, queries(spark, sf), s),
        ],
    )
    return stage(analysis_table(s, p, phi, wide, compare.chi(wide, p)), "analysis")


def evaluation_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts, paired grades and the cheap model's signals: all that evaluation needs."""
    q, s = stored_corpus(spark, sf)
    return s, grade.pair(grade.grade(outputs(spark, sf), q)), psi_wide(spark, sf)


def lineitem_table(spark: SparkSession, sf: str) -> DataFrame:
    """A large table with a binary target, for the ranking metrics."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


def arrivals(spark: SparkSession, sf: str, stream: bool) -> DataFrame:
    """Events as arriving queries: the user number stands for the query asked."""
    if stream:
        schema = table(spark, sf, "events").schema
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    else:
        rows = table(spark, sf, "events")
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), query_id(F.col("user_id")).alias("query_id"))
