"""Explicit schemas, feature names and the fixed values the results depend on."""

from __future__ import annotations

# Split names, model roles, bucket names.
HOLDOUT, CALIB, TEST = "selection_holdout", "calib", "test"
LO, HI = "M_lo", "M_hi"
BUCKETS = ("easy", "opportunity", "lo_only", "too_hard")

# Feature names per block.
STRUCTURAL = (
    "prompt_token_len", "question_token_len", "mean_option_token_len", "std_option_token_len",
    "question_option_ratio", "mattr", "compression_ratio",
)
AMBIGUITY = (
    "stem_choice_overlap_max", "stem_choice_overlap_mean", "choice_choice_overlap", "choice_length_range",
)
GEOMETRY = ("pc1", "pc2", "pc3", "centroid_distance", "mean_knn_similarity", "lof_score")
PSI = (
    "effective_support", "entropy", "margin", "mean_logprob", "msp", "normalized_entropy",
    "option_count", "predicted_logprob", "top2_gap", "top_probability_ratio",
)
CHI = ("delta_entropy", "delta_margin", "delta_mean_logprob", "delta_msp", "prediction_disagreement")

# Names of signal layers and their older spellings.
LAYER_QUERY, LAYER_RESPONSE, LAYER_CROSS = "model_independent", "model_dependent", "cross_model"
LAYER_ALIASES = {"query": LAYER_QUERY, "model_response": LAYER_RESPONSE}
SIGNAL_TYPES = ("model_independent", "model_response", "cross_model_comparative")

# Defaults of the jobs.
SEED = 42
MATTR_WINDOW = 25
ZLIB_LEVEL = 6
KNN_K = 10
PCA_COMPONENTS = 3
CV_FOLDS = 5
STEP_TOP_K = 32
GATES = {"min_accuracy_gap": 0.03, "opportunity_min": 0.05, "too_hard_max": 0.70}
TIE_BREAK = ("acc_gap", "opportunity_rate")

# Inside the jobs "__" stands for the dot of the exported feature names.
def _cols(prefix: str, names: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"{prefix}__{n}" for n in names)


PHI_STRUCTURAL_COLS = _cols("phi__structural", STRUCTURAL)
PHI_AMBIGUITY_COLS = _cols("phi__ambiguity", AMBIGUITY)
PHI_GEOMETRY_COLS = _cols("phi__embedding_geometry", GEOMETRY)
PHI_COLS = PHI_STRUCTURAL_COLS + PHI_AMBIGUITY_COLS + PHI_GEOMETRY_COLS
PSI_COLS = _cols("psi", PSI)
PSI_HI_COLS = _cols("psi_hi", PSI)
CHI_COLS = _cols("chi", CHI)
FEATURE_COLS = PHI_COLS + PSI_COLS + PSI_HI_COLS + CHI_COLS
LABEL_COLS = ("query_id", "split", "r", "bucket", "y_lo", "y_hi")

# (family, block, columns): the seven blocks of the family summary and the probes.
FAMILY_BLOCKS = (
    ("phi", "structural", PHI_STRUCTURAL_COLS),
    ("phi", "ambiguity", PHI_AMBIGUITY_COLS),
    ("phi", "embedding_geometry", PHI_GEOMETRY_COLS),
    ("phi", "all", PHI_COLS),
    ("psi", "psi_lo", PSI_COLS),
    ("psi", "psi_hi", PSI_HI_COLS),
    ("chi", "all", CHI_COLS),
)


def dotted(column: str) -> str:
    return column.replace("__", ".")


def undotted(column: str) -> str:
    return column.replace(".", "__")


QUERY_DDL = (
    "query_id STRING, dataset STRING, text STRING, choices ARRAY<STRING>, answer_index INT, "
    "metadata MAP<STRING,STRING>"
)
CANDIDATES_DDL = "STRUCT<labels: ARRAY<STRING>, scores: ARRAY<DOUBLE>, ranking: ARRAY<STRING>, option_count: INT>"
GENERATION_DDL = (
    "STRUCT<generated_text: STRING, finish_reason: STRING, generated_token_ids: ARRAY<INT>, "
    "generated_token_logprobs: ARRAY<DOUBLE>>"
)
TRACE_DDL = (
    f"STRUCT<n_choices: INT, predicted_letter: STRING, candidates: {CANDIDATES_DDL}, "
    "choice_logprobs: MAP<STRING,DOUBLE>, candidate_token_logprobs: MAP<STRING,DOUBLE>, "
    f"generation: {GENERATION_DDL}>"
)
RESULT_DDL = (
    "query_id STRING, role STRING, model STRING, raw_output STRING, parsed_answer INT, correct INT, "
    "latency_ms DOUBLE, token_count INT, "
    f"model_response STRUCT<protocol_version: STRING, trace: {TRACE_DDL}>"
)
SPLIT_DDL = ("query_id STRING, split STRING")
POLICY_DDL = (
    "schema_version STRING, signal_layers ARRAY<STRING>, feature_columns ARRAY<STRING>, "
    "scaler STRUCT<mean: ARRAY<DOUBLE>, scale: ARRAY<DOUBLE>>, "
    "model STRUCT<scoring_method: STRING, weights: ARRAY<DOUBLE>, intercept: DOUBLE, threshold: DOUBLE>, "
    "pool STRUCT<lo: STRING, hi: STRING>, training MAP<STRING,STRING>"
)
SCORECARD_DDL = (
    "run_id STRING, dataset STRING, n BIGINT, acc_lo DOUBLE, acc_hi DOUBLE, acc_gap DOUBLE, "
    "opportunity_rate DOUBLE, too_hard_rate DOUBLE, gate_c_pass BOOLEAN, gate_d_pass BOOLEAN, timestamp STRING"
)
