"""Registered queries over what is written, read back, parted, extended or plugged in."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.functions.text import strip
from forkline.operators import geometry, policy, rank_metrics, response, split, text_features
from forkline.operators.table import complete_cases
from forkline.operators.text_vectors import document_frequencies, text_vectors
from forkline.plans import workload as W
from forkline.plans.catalog import _candidates, _light_analysis, rounded
from forkline.schemas import CALIB, FEATURE_COLS, HI, LO, PHI_COLS, PHI_GEOMETRY_COLS, PSI, PSI_COLS, TEST, dotted
from forkline.session import scratch_path, stage
from forkline.sources import registry, tables
from forkline.sources.broken import part_jsonl
from forkline.streaming import routing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def number(column: str = "query_id"):
    return F.substring_index(column, ":", -1).cast("bigint")


# --- corpora, parts -----------------------------------------------------------


@query
def corpus_saved(spark, sf):
    """A corpus and its parts, stored, checked on both sides and read back."""
    path = scratch_path(spark, "corpus")
    q = stage(W.queries(spark, sf), "queries")
    tables.save_corpus(q, split.assign(q, W.RULE), path)
    queries, parts = tables.load_corpus_tables(spark, path)
    return queries.join(parts, "query_id").select(
        "query_id", "split", F.md5("text").alias("text_md5"), F.size("choices").alias("n_choices"), "answer_index")


@query
def corpus_loaded(spark, sf):
    """Source files of two splits, each in many files, loaded as one corpus with ids by place in the files."""
    q = W.raw_queries(spark, sf).withColumn("doc", number())
    pick = F.pmod("doc", F.lit(4)).cast("int")
    rows = q.select(
        "doc", F.concat(F.lit("d"), "doc").alias("id"), F.concat(F.lit("  "), "text").alias("question"),
        F.struct(F.col("choices").alias("text"), F.expr("if(doc % 2 = 0, array('1','2','3','4'), array('A','B','C','D'))").alias("label")).alias("choices"),
        F.when((F.col("doc") % 2 == 0) & (F.col("doc") % 3 > 0), (pick + 1).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.element_at(F.split(F.lit("a,b,c,d"), ","), pick + 1))).alias("answerKey"))
    path = scratch_path(spark, "source")
    for name, mine in (("validation", F.col("doc") % 3 == 0), ("test", F.col("doc") % 3 > 0)):
        tables.write_ordered(rows.filter(mine), f"{path}/{name}", "doc")
    out = registry.load_corpus(spark, registry.get_source("ARC-Challenge"), path)
    return out.select("query_id", F.md5("text").alias("text_md5"), F.size("choices").alias("n_choices"), "answer_index",
                      F.col("metadata.native_id").alias("native_id"))


@query
def sorted_sink(spark, sf):
    """Rows written in order of their ids, read back with their places in the files."""
    path = scratch_path(spark, "sorted")
    tables.write_ordered(W.table(spark, sf, "documents").select(W.query_id(F.col("doc_id")).alias("query_id")), path, "query_id")
    return registry.file_row_numbers(spark.read.schema("query_id string").parquet(path))


@query
def extended_parts(spark, sf):
    """Parts frozen for a third of the corpus, then extended twice; no id moves."""
    path = scratch_path(spark, "parts")
    ids = stage(W.queries(spark, sf).select("query_id"), "ids")
    for rest in (1, 2):
        split.extend_parts(spark, path, ids.filter(number() % 3 < rest), W.RULE)
        if rest == 1:
            frozen = stage(tables.read_splits(spark, f"{path}/parts"), "frozen").withColumnRenamed("split", "before")
    now = split.extend_parts(spark, path, ids, W.RULE)
    return now.join(frozen, "query_id", "left").select(
        "query_id", "split", (F.col("before").isNotNull() & (F.col("before") != F.col("split"))).alias("moved"))


@query
def holdout_faults(spark, sf):
    """A holdout with ids that are there twice and ids outside the corpus."""
    q = W.queries(spark, sf)
    held = split.holdout_only(q, W.RULE).select("query_id")
    bad = held.unionByName(held.filter(number() % 2 == 0)).unionByName(
        W.second_corpus(spark, sf).select("query_id").filter(number() % 10 == 0))
    return split.holdout_faults(q, bad)


@query
def registered_source(spark, sf):
    """A normaliser that a caller registers, used through the registry."""

    def plain(df: DataFrame) -> DataFrame:
        return df.select("*", strip(F.col("body")).alias("text"), F.col("options").alias("_choices"),
                         F.col("right").alias("answer_index"), F.lit(None).cast("map<string,string>").alias("metadata"))

    registry.register(registry.SourceSpec("benchmark-items", plain, ("test",), aliases=("items",)))
    try:
        spec = registry.get_source("items")
        rows = W.second_corpus(spark, sf).select(
            number().alias("item"), F.col("text").alias("body"), F.col("choices").alias("options"), F.col("answer_index").alias("right"))
        out = registry.normalise(rows, spec, "test", "item")
    finally:
        registry.unregister("benchmark-items")
    return out.select("query_id", F.md5("text").alias("text_md5"), F.size("choices").alias("n_choices"), "answer_index", "reject_reason")


# --- broken rows --------------------------------------------------------------


@query
def lines_parted(spark, sf):
    """Documents as JSON lines, some of them broken on purpose; good rows and reasons from one parse."""
    d = W.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text", F.pmod("doc_id", F.lit(7)).alias("h"))
    whole = F.to_json(F.struct("id", "lang", "text"))
    line = (
        F.when(F.col("h") == 1, F.expr("left(to_json(struct(id, lang, text)), length(to_json(struct(id, lang, text))) - 1)"))
        .when(F.col("h") == 2, F.to_json(F.struct("lang", "text")))
        .when(F.col("h") == 3, F.to_json(F.struct(F.concat(F.lit("x"), "id").alias("id"), "lang", "text")))
        .when(F.col("h") == 4, F.to_json(F.struct("id", "lang", F.concat("text", F.lit("\u0085")).alias("text"))))
        .otherwise(whole)
    )
    path = scratch_path(spark, "lines")
    d.select(F.explode(F.when(F.col("h") == 4, F.array(line, F.lit("  "))).otherwise(F.array(line))).alias("value")).write.text(path)
    made = part_jsonl(spark, path, "id BIGINT, lang STRING, text STRING", ("id",))
    good = made.good.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(F.char_length("text")).alias("chars"))
    none = F.lit(None).cast("bigint")
    return good.select(F.lit("good").alias("reason"), "n", "ids", "chars").unionByName(
        made.reasons().select("reason", "n", none.alias("ids"), none.alias("chars")))


@query
def traces_parted(spark, sf):
    """Traces broken on purpose: counts per reason and role, and the signals of the others, from one pass."""
    h, m = F.pmod(number(), F.lit(6)), F.col("model_response")
    t = W.traces(spark, sf)
    t = t.withColumn("model_response", (
        F.when(h == 0, m.withField("protocol_version", F.lit("other")))
        .when(h == 1, m.withField("trace.predicted_letter", F.lit(None).cast("string")))
        .when(h == 2, m.withField("trace.predicted_letter", F.lit("Z")))
        .when(h == 3, m.withField("protocol_version", F.lit("mcq_letter_v1")))
        .when(h == 4, m.withField("trace.candidates", F.lit(None)).withField("trace.candidate_token_logprobs", F.lit(None)))
        .otherwise(m)))
    made = response.psi_parted(t)
    good = made.good.groupBy("role").agg(F.count("*").alias("n"), F.avg("entropy").alias("mean_entropy"))
    bad = made.errors.groupBy("role", F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))
    return rounded(good.select(F.lit("good").alias("reason"), "role", "n", "mean_entropy").unionByName(
        bad.select("reason", "role", "n", F.lit(None).cast("double").alias("mean_entropy"))))


@query
def complete_rows(spark, sf):
    """Rows whose response signals are all numbers, where one column is text with some words in it."""
    t = _light_analysis(spark, sf)
    t = t.withColumn("psi__entropy", F.when(number() % 5 == 0, "n/a").otherwise(F.col("psi__entropy").cast("string")))
    return t.groupBy("split").agg(F.count("*").alias("n")).join(
        complete_cases(t, PSI_COLS).groupBy("split").agg(F.count("*").alias("n_complete")), "split")


# --- stored signals, vectors, reports ------------------------------------------


@query
def embeddings_stored(spark, sf):
    path = scratch_path(spark, "vectors")
    tables.write_embeddings(W.vectors(spark, sf), path, "embedding")
    back = tables.read_embeddings(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(back.select("query_id", F.size("embedding").alias("width"), total.alias("total")), 5)


@query
def phi_old_layout(spark, sf):
    """Text signals in blocks under their old names, written as JSON lines and read as flat columns."""
    s = W.splits(spark, sf)
    made = W.phi_text(W.queries(spark, sf), s, with_compression=False).join(s, "query_id")

    def block(prefix: str):
        return F.struct(*[F.col(c).alias(c.rsplit("__", 1)[1]) for c in made.columns if c.startswith(prefix)])

    path = scratch_path(spark, "phi-old")
    tables.write_jsonl(made.select(
        "query_id", "split", block("phi__structural").alias("load"), block("phi__ambiguity").alias("ambiguity"),
        F.struct((F.col("phi__structural__prompt_token_len") / 8).alias("retrieval_density")).alias("novelty")), path)
    back = tables.read_phi(spark, path)
    kept = [c for c in PHI_COLS if "compression" not in c and (c not in PHI_GEOMETRY_COLS or "knn" in c)]
    return rounded(back.select("query_id", "split", *kept), 9)


@query
def meta_of_signals(spark, sf):
    """Meta row of a stored signal table, counted while it is written."""
    signals = W.psi(spark, sf).filter(F.col("role") == LO)
    made = tables.write_with_meta(signals, scratch_path(spark, "signals"), PSI, metrics_version="v4")
    return made.withColumn("metric_keys", F.array_join("metric_keys", ","))


@query
def scorecards_from_files(spark, sf):
    """Scorecards of many runs, each in a folder of its own, found by pattern; the newest per corpus."""
    path = scratch_path(spark, "scorecards")
    cards = _candidates(spark, sf)
    cards.withColumn("folder", F.concat_ws("-", "dataset", "run_id")).write.partitionBy("folder").json(path)
    return tables.read_scorecards(spark, f"{path}/folder=*").select(
        "dataset", "run_id", "timestamp", "n", "acc_gap", "opportunity_rate", "gate_c_pass", "gate_d_pass")


# --- policies -----------------------------------------------------------------


@query
def policy_defaults(spark, sf):
    """A stored policy with little in it and old layer names, loaded with its defaults and applied."""
    path = scratch_path(spark, "policy-small")
    made = spark.range(1).select(
        F.array(F.lit("psi.entropy"), F.lit("psi.msp")).alias("feature_columns"),
        F.array(F.lit("query"), F.lit("model_response"), F.lit("cross_model")).alias("signal_layers"),
        F.struct(F.array(F.lit(0.5), F.lit(-0.25)).alias("weights")).alias("model"))
    tables.write_jsonl(made, path)
    loaded = tables.load_policy(spark, path)
    decided = policy.decide(W.psi_wide(spark, sf), loaded)
    return rounded(decided.select("query_id", "score", "model", F.lit(",".join(loaded.signal_layers)).alias("layers"),
                                  F.lit(loaded.threshold).alias("threshold")))


@query
def runtime_features(spark, sf):
    """Every feature with the number of rows that have it and whether a policy may use it at run time."""

    def allowed(column: str) -> bool:
        try:
            return policy.runtime_columns([column]) == (column,)
        except ValueError:
            return False

    t = _light_analysis(spark, sf)
    counts = t.agg(*[F.count(c).alias(c) for c in FEATURE_COLS])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(dotted(c)).alias("feature"), F.col(c).alias("n"), F.lit(allowed(c)).alias("allowed")) for c in FEATURE_COLS])))


@query
def feature_spec(spark, sf):
    """The three best response signals, stored as a feature spec, read back and taken as a policy's columns."""
    calib = _light_analysis(spark, sf).filter(F.col("split") == CALIB)
    best = rank_metrics.univariates(calib, PSI_COLS, ("r",)).orderBy(F.desc_nulls_last("auroc"), "feature").limit(3)
    path = scratch_path(spark, "spec")
    tables.save_feature_spec(spark, [r["feature"] for r in best.select("feature").collect()], path)
    chosen = policy.runtime_columns(spec=tables.load_feature_spec(spark, path))
    return calib.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(dotted(c)).alias("feature"), F.col(c).alias("v"))
                                            for i, c in enumerate(chosen)])).alias("x")).groupBy("x.place", "x.feature").agg(F.count("x.v").alias("n"))


# --- plugged in ---------------------------------------------------------------


@query
def counted_tokens(spark, sf):
    """Text signals with a caller's token counter, which counts in the Arrow column and makes no Python strings."""

    @F.arrow_udf("int")
    def spaced(text: pa.Array) -> pa.Array:
        return pc.count_substring_regex(text, "[^ ]+").cast(pa.int32())

    made = text_features.structural(W.queries(spark, sf), counter=spaced, with_compression=False)
    names = ("prompt_token_len", "question_token_len", "mean_option_token_len", "question_option_ratio")
    return rounded(made.select("query_id", *[f"phi__structural__{n}" for n in names]), 9)


@query
def registered_protocol(spark, sf):
    """A caller's protocol beside the library's: the strong model's traces are read at another temperature."""
    response.register_protocol("tempered", lambda rows, temperature: response.mcq_letter(rows, 2.0 * temperature))
    try:
        m = F.col("model_response")
        t = W.traces(spark, sf).withColumn(
            "model_response", F.when(F.col("role") == HI, m.withField("protocol_version", F.lit("tempered"))).otherwise(m))
        made = response.psi(t, strict=True)
    finally:
        response.unregister_protocol("tempered")
    return rounded(made.select("query_id", "role", "entropy", "msp", "trace_valid"))


# --- streams ------------------------------------------------------------------


@query
def late_rows(spark, sf):
    """Arrivals of a first run, and a fifth of them once more in a second: rows in windows and rows too late for one."""
    features = stage(W.psi_wide(spark, sf), "stream-features")
    events, path = W.arrivals(spark, sf, False), scratch_path(spark, "arrivals")
    windows, state = scratch_path(spark, "late-windows"), scratch_path(spark, "late-state")
    total = dict.fromkeys(("arrived", "skipped", "untimed", "counted"), 0)
    for part in (events, events.filter("event_id % 5 = 0")):
        part.write.mode("append").parquet(path)
        arriving = spark.readStream.schema(events.schema).parquet(path)
        made, counts = routing.counted_windows(routing.decide_stream(arriving, features, W.FIXED_POLICY), windows, state)
        total = {k: total[k] + counts[k] for k in total}
    return made.agg(F.sum("n").alias("in_windows")).select(
        *[F.lit(v).cast("bigint").alias(k) for k, v in total.items()], "in_windows", (F.lit(total["counted"]) - F.col("in_windows")).alias("late"))


# --- vectors of texts -----------------------------------------------------------


@query
def document_vectors(spark, sf):
    """Hashed and projected vectors of all documents, a row per place."""
    docs = W.table(spark, sf, "documents").select(W.query_id(F.col("doc_id")).alias("query_id"), "text")
    made = text_vectors(docs)
    return rounded(made.select("query_id", F.posexplode("embedding").alias("place", "v")).select(
        "query_id", "place", F.col("v").cast("double").alias("v")), 5)


@query
def text_geometry(spark, sf):
    """Geometry signals of queries from vectors of their texts, frequencies fitted on the calibration part."""
    q = stage(W.queries(spark, sf).select("query_id", "text"), "texts")
    s = stage(split.assign(q, W.RULE), "parts")
    calib = q.join(s.filter(F.col("split") == CALIB), "query_id", "left_semi")
    vectors = text_vectors(q, fitted=document_frequencies(calib))
    used = s.filter(F.col("split").isin(CALIB, TEST))
    made = geometry.geometry(vectors, used)
    return rounded(made.select("query_id", *[c for c in PHI_GEOMETRY_COLS if "lof" not in c]), 4)
