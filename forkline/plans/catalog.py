"""The registered queries: every job run over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.functions import text as X
from forkline.functions.exprs import letter
from forkline.functions.grading import finish_reason, parsed_answer, first_line
from forkline.functions.scores import has_trace
from forkline.operators import (
    compare, corpus, evaluate, geometry, grade, knn, policy, probe, rank_metrics, response, scale, scorecard, split,
    text_features,
)
from forkline.operators.newton import TOLERANCE
from forkline.operators.table import table_meta
from forkline.plans import workload as W
from forkline.schemas import (
    CALIB, CHI_COLS, FEATURE_COLS, HI, HOLDOUT, LABEL_COLS, LO, PHI_GEOMETRY_COLS, PSI, PSI_COLS, TEST,
)
from forkline.session import scratch_path, stage
from forkline.sources import registry, tables
from forkline.streaming import routing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PLACES = 6


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles to a fixed number of places, for comparison with another engine."""
    return df.select(
        *[F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def joined(items: Column) -> Column:
    return F.array_join(items, " | ")


# --- corpus -------------------------------------------------------------------


@query
def corpus_clean(spark, sf):
    q = W.queries(spark, sf)
    return q.select(
        "query_id", F.md5("text").alias("text_md5"), F.md5(joined(F.col("choices"))).alias("choices_md5"),
        F.size("choices").alias("n_choices"), "answer_index", F.col("metadata.subject").alias("subject"),
    )


@query
def corpus_counters(spark, sf):
    return corpus.counters(W.raw_queries(spark, sf))


def _source_rows(spark, sf) -> DataFrame:
    q = W.raw_queries(spark, sf)
    number = F.substring_index("query_id", ":", -1).cast("long")
    return q.select(number.alias("doc"), F.col("metadata.subject").alias("lang"), "text", "choices")


def _normalised(df: DataFrame) -> DataFrame:
    return df.select(
        "query_id", F.md5("text").alias("text_md5"), F.size("choices").alias("n_choices"), "answer_index",
        F.try_element_at("metadata", F.lit("subject")).alias("subject"), "reject_reason",
    )


@query
def source_arc(spark, sf):
    """Key looked up in the option labels, else a letter; rows are numbered in document order."""
    src = _source_rows(spark, sf)
    digits, capitals = (F.array(*[F.lit(x) for x in s]) for s in ("1234", "ABCD"))
    pick = F.pmod("doc", F.lit(4)).cast("int")
    key = (
        F.when(F.pmod("doc", F.lit(3)) == 0, F.concat(F.lit(" "), F.lower(letter(pick)), F.lit(" ")))
        .when(F.pmod("doc", F.lit(3)) == 1, (pick + 1).cast("string"))
        .otherwise(letter(pick))
    )
    rows = src.select(
        "doc", F.concat(F.lit("d"), "doc").alias("id"), F.concat(F.lit("  "), "text").alias("question"),
        F.struct(
            F.col("choices").alias("text"), F.when(F.pmod("doc", F.lit(2)) == 0, digits).otherwise(capitals).alias("label")
        ).alias("choices"),
        key.alias("answerKey"),
    )
    numbered = registry.row_numbers(rows, "doc")
    out = registry.normalise(numbered, registry.get_source("ARC-Challenge"), "test")
    return _normalised(out)


@query
def source_mmlu(spark, sf):
    src = _source_rows(spark, sf)
    even = F.pmod("doc", F.lit(2)) == 0
    pick = F.pmod("doc", F.lit(4)).cast("int")
    rows = src.select(
        "doc", F.col("text").alias("question"), F.when(even, F.col("choices")).alias("options"),
        F.when(~even, F.col("choices")).alias("choices"),
        F.when(F.pmod("doc", F.lit(3)) == 0, pick).alias("answer_index"), letter(pick).alias("answer"),
        F.when(F.pmod("doc", F.lit(5)) > 0, F.col("lang")).otherwise("").alias("subject"),
        F.concat(F.lit("cat-"), "lang").alias("category"),
    )
    return _normalised(registry.normalise(rows, registry.get_source("MMLU-Pro"), "test", "doc"))


@query
def source_truthfulqa(spark, sf):
    src = _source_rows(spark, sf)
    pick = F.pmod("doc", F.lit(4)).cast("int")
    labels = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: ((i == pick) & (F.pmod("doc", F.lit(7)) != 0)).cast("int")
    )
    rows = src.select(
        "doc", F.col("text").alias("question"), F.struct(F.col("choices"), labels.alias("labels")).alias("mc1_targets")
    )
    return _normalised(registry.normalise(rows, registry.get_source("TruthfulQA"), "validation", "doc"))


@query
def source_hellaswag(spark, sf):
    src = _source_rows(spark, sf)
    odd = F.pmod("doc", F.lit(2)) == 1
    rows = src.select(
        "doc", F.when(odd, F.col("text")).alias("ctx"), F.col("text").alias("ctx_a"), F.col("lang").alias("ctx_b"),
        F.col("choices").alias("endings"), F.pmod("doc", F.lit(4)).cast("string").alias("label"),
    )
    return _normalised(registry.normalise(rows, registry.get_source("HellaSwag"), "validation", "doc"))


@query
def row_numbers(spark, sf):
    return registry.row_numbers(W.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query
def stratum_quotas(spark, sf):
    strata = W.queries(spark, sf).select(corpus.stratum("subject").alias("stratum"))
    return corpus.stratum_quotas(strata, W.SUBSAMPLE)


@query
def stratified_subsample(spark, sf):
    return corpus.stratified_ids(W.queries(spark, sf), W.SUBSAMPLE, "subject")


# --- parts --------------------------------------------------------------------


@query
def split_sizes(spark, sf):
    return W.splits(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


@query
def split_members(spark, sf):
    return W.splits(spark, sf)


@query
def holdout_members(spark, sf):
    return split.holdout_only(W.queries(spark, sf), W.RULE)


@query
def split_violations(spark, sf):
    """Checked against a partition with faults: the raw corpus has rows the parts do not cover."""
    return split.violations(W.raw_queries(spark, sf), W.splits(spark, sf))


@query
def split_leaks(spark, sf):
    """All documents asked for: those of the holdout and those outside the corpus must be refused."""
    return split.leaks(W.splits(spark, sf), W.raw_queries(spark, sf))


@query
def select_calib(spark, sf):
    q, s = W.stored_corpus(spark, sf)
    return split.select_split(q, s, CALIB, 50).select("query_id", "answer_index")


@query
def eval_ids(spark, sf):
    return split.eval_ids(W.splits(spark, sf))


@query
def cv_folds(spark, sf):
    p = W.pairs(spark, sf)
    labels = p.select("query_id", grade_need().alias("r"))
    return split.folds(labels)


def grade_need() -> Column:
    from forkline.functions.grading import routing_need

    return routing_need(F.col("y_lo"), F.col("y_hi"))


# --- grading ------------------------------------------------------------------


@query
def prompts(spark, sf):
    p = grade.prompts(W.queries(spark, sf))
    return p.select("query_id", "prompt_sha256", F.size("messages").alias("n_messages"),
                    F.sha2(F.element_at("messages", 2)["content"], 256).alias("user_sha256"))


@query
def parse_answers(spark, sf):
    c = W.table(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", F.md5(first_line(F.col("text"))).alias("line_md5"),
        parsed_answer(F.col("text"), F.lit(10)).alias("parsed_answer"),
    )


@query
def grade_results(spark, sf):
    return grade.grade(W.outputs(spark, sf), W.queries(spark, sf)).select(
        "query_id", "role", "model", "parsed_answer", "correct"
    )


@query
def pending(spark, sf):
    return grade.pending(W.queries(spark, sf), W.results(spark, sf))


@query
def trace_present(spark, sf):
    r = W.results(spark, sf)
    m = F.col("model_response")
    flag = has_trace(m["trace"], m["protocol_version"], response.known_protocols())
    return r.groupBy("role").agg(F.count("*").alias("n"), F.count_if(flag).alias("n_with_trace"))


def _new_answers(spark, sf) -> DataFrame:
    """Assistant turns as fresh cheap-model answers: the last turn of a conversation counts."""
    c = W.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    turns = c.select(
        W.query_id(F.col("conv_id")).alias("query_id"), F.lit(LO).alias("role"), F.lit("cheap-2").alias("model"),
        F.col("text").alias("raw_output"), "turn",
    )
    last = grade.newest(turns, ("query_id", "role"), "turn").drop("turn")
    return grade.grade(last, W.queries(spark, sf))


@query
def upsert_results(spark, sf):
    cached = grade.grade(W.outputs(spark, sf), W.queries(spark, sf))
    merged = grade.upsert(cached, _new_answers(spark, sf))
    return merged.select("query_id", "role", "model", "parsed_answer", "correct")


@query
def bundles(spark, sf):
    """Rows, right answers and missing results per part, as the bundle writer checks them."""
    q, s = W.stored_corpus(spark, sf)
    r = grade.grade(W.outputs(spark, sf), q)
    whole = grade.bundles(r, s).groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("correct").alias("n_correct"))
    lost = grade.missing_results(r, s).groupBy("split").agg(F.count("*").alias("n_missing"))
    return whole.join(lost, "split", "left").fillna(0, subset=["n_missing"])


@query
def finish_reasons(spark, sf):
    """Token runs derived from the text lengths of the documents."""
    ids = F.transform(
        F.sequence(F.lit(1), F.pmod("n_chars", F.lit(10)).cast("int")), lambda i: F.pmod(F.col("doc_id") * i, F.lit(11)).cast("int")
    )
    run = F.when(F.pmod("n_chars", F.lit(10)) > 0, ids).otherwise(F.array().cast("array<int>"))
    return W.table(spark, sf, "documents").select(
        "doc_id", finish_reason(run, W.EOS_IDS, W.GENERATED_MAX).alias("finish_reason")
    )


# --- scorecard ----------------------------------------------------------------


@query
def bucket_counts(spark, sf):
    return scorecard.bucket_counts(W.pairs(spark, sf))


@query
def scorecard_overall(spark, sf):
    return scorecard.scorecard(W.pairs(spark, sf))


@query
def scorecard_by_split(spark, sf):
    q, s = W.stored_corpus(spark, sf)
    p = grade.pair(grade.grade(W.outputs(spark, sf), q))
    return scorecard.scorecard(p.join(s, "query_id"), ("split",))


def _candidates(spark, sf) -> DataFrame:
    """A scorecard per language and source: sources are the runs of a corpus, languages the corpora."""
    docs = W.table(spark, sf, "documents").select(W.query_id(F.col("doc_id")).alias("query_id"), "lang", "source", "doc_id")
    rows = W.pairs(spark, sf).join(docs, "query_id")
    newest = F.lpad(F.max("doc_id").cast("string"), 12, "0").alias("timestamp")
    cards = scorecard.scorecard(rows, ("lang", "source"), more=(newest,))
    return cards.withColumnsRenamed({"lang": "dataset", "source": "run_id"})


@query
def latest_scorecards(spark, sf):
    return scorecard.latest_per_dataset(_candidates(spark, sf)).select(
        "dataset", "run_id", "timestamp", "n", "acc_gap", "opportunity_rate", "gate_c_pass", "gate_d_pass"
    )


@query
def gate_messages(spark, sf):
    cards = scorecard.gate_messages(_candidates(spark, sf))
    return cards.select(
        "dataset", "run_id", F.array_join("passed", "; ").alias("passed"), F.array_join("failed", "; ").alias("failed")
    )


@query
def winner(spark, sf):
    latest = scorecard.latest_per_dataset(_candidates(spark, sf))
    return scorecard.winner(latest, ("de", "en")).select("dataset", "run_id", "preference")


@query
def ranked_candidates(spark, sf):
    ranked = scorecard.ranked_candidates(_candidates(spark, sf), ("de", "en"))
    return ranked.select("dataset", "run_id", "preference", "acc_gap", "opportunity_rate")


# --- text signals -------------------------------------------------------------


@query
def phi_structural(spark, sf):
    made = text_features.structural(W.queries(spark, sf), with_compression=False)
    return rounded(made.select("query_id", *[c for c in made.columns if c.startswith("phi__")]), 9)


@query
def phi_ambiguity(spark, sf):
    made = text_features.ambiguity(W.queries(spark, sf))
    return rounded(made.select("query_id", *[c for c in made.columns if c.startswith("phi__")]), 9)


@query
def mattr_documents(spark, sf):
    docs = W.spread(W.table(spark, sf, "documents"))
    return rounded(docs.select("doc_id", X.mattr(X.words(F.col("text")), 50).alias("mattr")), 9)


@query
def compression_documents(spark, sf):
    docs = W.spread(W.table(spark, sf, "documents"))
    return rounded(docs.select("doc_id", X.compression_ratio(F.col("text"), 6).alias("compression_ratio")))


@query
def chat_tokens(spark, sf):
    p = grade.prompts(W.queries(spark, sf))
    return p.select("query_id", X.chat_token_count(F.col("messages")).alias("n_tokens"))


@query
def corpus_index(spark, sf):
    """Two corpora through one text-signal job."""
    both = W.raw_queries(spark, sf).unionByName(W.second_corpus(spark, sf))
    q = stage(corpus.clean(both), "both-corpora")
    s = split.assign(q, W.RULE)
    return tables.corpus_index(text_features.text_features(q, with_compression=False), q, s)


# --- response and comparison signals ------------------------------------------


def _psi(df: DataFrame, role: str) -> DataFrame:
    return rounded(df.filter(F.col("role") == role).select("query_id", *PSI, F.col("prediction.parsed_answer").alias("parsed_answer")))


@query
def psi_lo(spark, sf):
    return _psi(W.psi(spark, sf), LO)


@query
def psi_hi(spark, sf):
    return _psi(W.psi(spark, sf), HI)


@query
def psi_tempered(spark, sf):
    return _psi(W.psi(spark, sf, 2.0), LO)


@query
def chi(spark, sf):
    return rounded(W.chi(spark, sf))


@query
def option_candidates(spark, sf):
    """Scores and ranking of the options from first-token log-probabilities."""
    t = W.traces(spark, sf).filter(F.col("role") == LO)
    trace = F.col("model_response.trace")
    made = t.select(
        "query_id",
        response.score_candidates("first_token_letter", trace["n_choices"], trace["candidate_token_logprobs"]).alias("c"),
    )
    return made.select(
        "query_id", F.array_join("c.ranking", "").alias("ranking"), F.col("c.option_count").alias("option_count"),
        F.round(F.array_max("c.scores"), PLACES).alias("best"), F.round(F.array_min("c.scores"), PLACES).alias("worst"),
    )


@query
def raw_view(spark, sf):
    signals = W.psi(spark, sf).filter(F.col("role") == LO).select("query_id")
    made = response.with_raw_view(signals, W.queries(spark, sf))
    return made.select("query_id", F.md5("raw.query").alias("question_md5"), F.col("raw.answer").alias("answer"))


@query
def generation_steps(spark, sf):
    """Each vector read as eight steps over a vocabulary of eight tokens."""
    e = W.table(spark, sf, "embeddings")
    logits = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double") * W.SCORE_SPREAD),
    )
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.col("vec_id") + i, F.lit(8)).cast("int"))
    steps = e.select("vec_id", F.posexplode(response.packed_steps(logits, ids, 3)).alias("step", "s"))
    return steps.select(
        "vec_id", "step", F.round("s.logprob", PLACES).alias("logprob"),
        F.array_join(F.transform("s.top", lambda t: t["token_id"].cast("string")), ",").alias("top_ids"),
        F.round(F.get("s.top", F.lit(0))["logprob"], PLACES).alias("top_logprob"),
    )


# --- scaled signals and geometry ----------------------------------------------


def _text_phi(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = W.stored_corpus(spark, sf)[1]
    return stage(W.phi_text(W.queries(spark, sf), s, with_compression=False), "phi-text"), s


@query
def zscore_fit(spark, sf):
    phi, s = _text_phi(spark, sf)
    return rounded(scale.fit_zscore(phi, s).table(spark))


@query
def phi_zscore(spark, sf):
    phi, s = _text_phi(spark, sf)
    return rounded(scale.fit_zscore(phi, s).transform(phi), 5)


def _geometry(spark, sf) -> DataFrame:
    return geometry.geometry(W.vectors(spark, sf), W.splits(spark, sf))


@query
def geometry_density(spark, sf):
    """Axes, centroid distance, neighbour similarity and outlier score of calibration and test vectors."""
    g = _geometry(spark, sf)
    return rounded(g.select("query_id", *PHI_GEOMETRY_COLS), 5)


@query
def geometry_axes(spark, sf):
    s = W.splits(spark, sf).filter(F.col("split") != HOLDOUT)
    rows = stage(W.vectors(spark, sf).select("query_id", F.col("embedding").cast("array<double>").alias("vector")).join(s, "query_id"), "axes")
    return rounded(geometry.fit_axes(rows.filter(F.col("split") == CALIB)).project(rows).drop("centroid_distance"), 5)


@query
def knn_euclidean(spark, sf):
    v = W.vectors(spark, sf)
    hits = knn.nearest(v, v, 6, vector="embedding")
    return rounded(hits)


@query
def knn_cosine_others(spark, sf):
    v = W.vectors(spark, sf)
    hits = knn.without_self(knn.nearest(v, v, 6, metric="cosine", vector="embedding"), 5)
    return rounded(hits)


@query
def knn_recall(spark, sf):
    """Whether the approximate mode finds nine in ten of the exact neighbours, for several k, over all vectors.

    The cells to look into are chosen on a sample of queries; both modes share one index.
    """
    v = W.vectors(spark, sf)
    sides = knn.merge_copies(v, v, 10, vector="embedding")
    index = knn.build_index(sides.base, sides.kind)
    probes = knn.probes_for(sides, index, 10)
    exact = stage(knn.search(sides, 10, index=index), "exact")
    near = stage(knn.search(sides, 10, probes=probes, index=index), "near")
    found = knn.recall(near, exact, (1, 5, 10))
    return found.select("k", "n", (F.col("recall") >= 0.9).alias("nine_in_ten"))


# --- wide table ---------------------------------------------------------------

# Deflate has no SQL form; its column is in analysis_full.
IN_SQL = tuple(c for c in FEATURE_COLS if "compression" not in c)


@query
def analysis_calib(spark, sf):
    a = W.analysis(spark, sf).filter(F.col("split") == CALIB)
    return rounded(a.select(*LABEL_COLS, *IN_SQL), 5)


@query
def analysis_test(spark, sf):
    a = W.analysis(spark, sf).filter(F.col("split") == TEST)
    return rounded(a.select(*LABEL_COLS, *IN_SQL), 5)


@query
def analysis_full(spark, sf):
    return rounded(W.analysis(spark, sf))


def _light_analysis(spark, sf) -> DataFrame:
    """The wide table without query signals: responses, comparisons and labels."""
    from forkline.operators.table import analysis_table

    q, s = W.stored_corpus(spark, sf)
    p = stage(grade.pair(grade.grade(W.outputs(spark, sf), q)), "pairs")
    wide = stage(W.psi_wide(spark, sf), "psi-wide")
    return stage(analysis_table(s, p, q.select("query_id"), wide, compare.chi(wide, p)), "light")


@query
def analysis_meta(spark, sf):
    return rounded(table_meta(_light_analysis(spark, sf)))


# --- validation ---------------------------------------------------------------


def _univariates(spark, sf) -> DataFrame:
    calib = W.analysis(spark, sf).filter(F.col("split") == CALIB)
    return rank_metrics.univariates(calib, IN_SQL)


@query
def univariates(spark, sf):
    return rounded(_univariates(spark, sf), 5)


@query
def family_summary(spark, sf):
    return rounded(rank_metrics.family_summary(_univariates(spark, sf)), 5)


@query
def univariates_lineitem(spark, sf):
    t = W.lineitem_table(spark, sf)
    return rounded(
        rank_metrics.univariates(t, ("quantity", "price", "discount", "tax"), ("returned",)).drop("family")
    )


@query
def psi_variance(spark, sf):
    calib = _light_analysis(spark, sf).filter(F.col("split") == CALIB)
    return rounded(rank_metrics.feature_variance(calib, PSI_COLS))


@query
def linear_probes(spark, sf):
    return rounded(probe.linear_probes(W.analysis(spark, sf).filter(F.col("split") == CALIB)))


TWO = ("psi__entropy", "psi__margin")


@query
def linear_probe_two(spark, sf):
    """A probe of two signals, small enough to be fitted in SQL as well."""
    calib = _light_analysis(spark, sf).filter(F.col("split") == CALIB)
    return rounded(probe.linear_probes(calib, (("psi", "two", TWO),)), 5)


# --- policy -------------------------------------------------------------------


def _routed(spark, sf) -> DataFrame:
    wide = W.psi_wide(spark, sf)
    return policy.decide(wide, W.FIXED_POLICY)


@query
def decisions(spark, sf):
    """Every document routed with the fixed policy; those without scores are skipped with the reason."""
    docs = W.table(spark, sf, "documents").select(W.query_id(F.col("doc_id")).alias("query_id"))
    rows = docs.join(W.psi_wide(spark, sf), "query_id", "left")
    routed = policy.decide(rows, W.FIXED_POLICY)
    return rounded(routed.select("query_id", "score", "use_strong", "model", "skip_reason"))


def _scored(spark, sf) -> DataFrame:
    routed = _routed(spark, sf).select("query_id", "score")
    return routed.join(W.pairs(spark, sf), "query_id").select("query_id", "score", grade_need().alias("r"))


@query
def threshold_sweep(spark, sf):
    return rounded(policy.threshold_sweep(_scored(spark, sf)))


@query
def threshold_best(spark, sf):
    return rounded(policy.best_threshold(policy.threshold_sweep(_scored(spark, sf))))


@query
def policy_fit(spark, sf):
    """Weights of a policy fitted on the calibration part."""
    p = policy.fit_policy(_light_analysis(spark, sf))
    rows = [(c, m, s, w) for c, m, s, w in zip(p.feature_columns, p.scaler_mean, p.scaler_scale, p.weights)]
    made = spark.createDataFrame(rows, "feature string, mean double, scale double, weight double")
    return rounded(made.withColumns({"intercept": F.lit(p.intercept), "threshold": F.lit(p.threshold)}))


@query
def policy_fit_two(spark, sf):
    """A policy of two signals, with what its fit leaves of the gradient, and its threshold."""
    p = policy.fit_policy(_light_analysis(spark, sf), TWO)
    rows = [(c, m, s, w) for c, m, s, w in zip(p.feature_columns, p.scaler_mean, p.scaler_scale, p.weights)]
    made = spark.createDataFrame(rows, "feature string, mean double, scale double, weight double")
    settled = float(p.training["gradient_per_row"]) <= TOLERANCE
    return rounded(made.withColumns({"intercept": F.lit(p.intercept), "threshold": F.lit(p.threshold), "settled": F.lit(settled)}), 5)


@query
def policy_agreement(spark, sf):
    return rounded(policy.agreement(_light_analysis(spark, sf), W.FIXED_POLICY))


def _decisions(spark, sf) -> DataFrame:
    s, p, wide = W.evaluation_inputs(spark, sf)
    return evaluate.decisions(s, p, wide, W.FIXED_POLICY)


@query
def evaluate_policies(spark, sf):
    return evaluate.report(_decisions(spark, sf), W.KAPPA)


@query
def cost_points(spark, sf):
    return evaluate.cost_points(evaluate.report(_decisions(spark, sf), W.KAPPA))


@query
def skip_counts(spark, sf):
    return evaluate.skip_counts(_decisions(spark, sf))


@query
def first_skipped(spark, sf):
    return evaluate.first_skipped(_decisions(spark, sf))


# --- streams ------------------------------------------------------------------


@query
def decide_stream(spark, sf):
    """Arriving queries routed by a stream until all input is processed."""
    features = stage(W.psi_wide(spark, sf), "stream-features")
    stream = routing.decide_stream(W.arrivals(spark, sf, True), features, W.FIXED_POLICY)
    out = stream.select("event_id", "query_id", "score", "use_strong", "model", "skip_reason")
    return rounded(routing.run_to_table(out, scratch_path(spark, "routed"), scratch_path(spark, "routed-state")))


@query
def hi_rate_windows(spark, sf):
    features = stage(W.psi_wide(spark, sf), "stream-features")
    stream = routing.decide_stream(W.arrivals(spark, sf, True), features, W.FIXED_POLICY)
    out = routing.hi_rate_windows(stream, kappa=W.KAPPA)
    made = routing.run_windows(out, scratch_path(spark, "windows"), scratch_path(spark, "windows-state"))
    return rounded(made.select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("window_start", "window_end")],
        "n", "n_hi", "hi_rate", "cost",
    ))


@query
def stream_latest(spark, sf):
    """Events as results arriving in several micro-batches for a (user, type); the newest per key is kept."""
    arrived = scratch_path(spark, "arrivals")
    events = W.table(spark, sf, "events").select(
        W.query_id(F.col("user_id")).alias("query_id"), F.col("event_type").alias("role"),
        F.col("event_id").alias("version"), "value",
    )
    events.repartition(4, "version").write.parquet(arrived)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    store = scratch_path(spark, "result-store")
    routing.store_results(rows, store, scratch_path(spark, "result-store-state"))
    return routing.current_results(spark, store, routing.ddl(events))


# --- tables written and read back ---------------------------------------------


@query
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    tables.write_table_csv(_light_analysis(spark, sf), path)
    back = tables.read_table_csv(spark, path)
    return rounded(back.select(*LABEL_COLS, *PSI_COLS, *CHI_COLS))


@query
def signal_round_trip(spark, sf):
    path = scratch_path(spark, "signals")
    tables.write_signals(tables.psi_records(W.psi(spark, sf).filter(F.col("role") == LO)), path)
    back = tables.read_signals(spark, path)
    return rounded(back.select(
        "query_id", "signal_type", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in PSI],
        F.col("prediction.parsed_answer").alias("parsed_answer"), "metrics_version",
    ))


@query
def legacy_signals(spark, sf):
    """Signal rows in an old flat layout, written from the labels and read in today's."""
    path = scratch_path(spark, "legacy")
    labels = W.table(spark, sf, "labels")
    old = labels.select(
        W.query_id(F.col("doc_id")).alias("query_id"), F.lit("query_derived").alias("signal_type"),
        (F.col("doc_id") / 8).alias("entropy"), F.col("quality").alias("answer_disagreement"),
        F.struct(F.lit("B").alias("letter"), (F.col("doc_id") / 16).alias("probability")).alias("prediction"),
        F.col("toxic").alias("disagreement"), F.col("quality").alias("correct"),
    )
    tables.write_jsonl(old, path)
    back = tables.read_signals(spark, path)
    return rounded(back.select(
        "query_id", "signal_type", F.try_element_at("metrics", F.lit("entropy")).alias("entropy"),
        "prediction_disagreement", F.col("prediction.parsed_answer").alias("parsed_answer"),
        F.col("prediction.confidence").alias("confidence"),
        F.try_element_at("extra", F.lit("disagreement")).alias("disagreement"),
        F.map_contains_key("extra", "correct").alias("kept_result_field"),
    ))


@query
def policy_round_trip(spark, sf):
    """A stored policy read back and applied to the whole table."""
    path = scratch_path(spark, "policy") + "/routing/policy.json"
    tables.save_policy(spark, W.FIXED_POLICY, path)
    loaded = tables.load_policy(spark, tables.find_policy(spark, path.rsplit("/routing", 1)[0]))
    routed = policy.decide(W.psi_wide(spark, sf), loaded)
    return routed.groupBy("model").agg(F.count("*").alias("n"))
