"""SQL counterparts of the queries in ``stored``."""

from __future__ import annotations

import re

from forkline.plans import oracle as O
from forkline.plans import workload as W
from forkline.plans.oracle import CHI_, GEO_COLS, PSI, PSI_, PSI_HI, TEXT_COLS, dotted, lit, r, strip, with_

RULE = W.RULE
FEATURES = [*TEXT_COLS, "phi__structural__compression_ratio", *GEO_COLS, *PSI_, *PSI_HI, *CHI_]
NUM = "split_part({}, ':', 2)::BIGINT".format

O.split_cte("third_splits", "clean WHERE num % 3 = 0", "clean")
O.rank_ctes("light_r", "light WHERE split = 'calib'", {dotted(c): c for c in PSI_}, ["r"], "light")

WORDS = O.words("text")
SLOT = "(('0x' || substr(md5(w), 1, 8))::BIGINT)"


def vector_ctes(prefix: str, source: str, fitted: str, *needs: str) -> None:
    for name, of in (("in", source), ("fit", fitted)):
        O.cte(f"{prefix}_{name}", f"""
SELECT query_id, ({SLOT} // 2) % 65536 AS slot, sum(CASE WHEN {SLOT} % 2 = 1 THEN -1 ELSE 1 END)::DOUBLE AS c
FROM (SELECT query_id, unnest({WORDS}) AS w FROM {of}) GROUP BY ALL HAVING c <> 0""", *needs)
    O.cte(f"{prefix}_idf", f"""
SELECT slot, ln(((SELECT count(*) FROM {fitted}) + 1) / (coalesce(n, 0) + 1.0)) + 1 AS idf
FROM (SELECT DISTINCT slot FROM {prefix}_in) LEFT JOIN (SELECT slot, count(*) AS n FROM {prefix}_fit GROUP BY slot) USING (slot)""",
          f"{prefix}_in", f"{prefix}_fit")
    O.cte(f"{prefix}_sum", f"""
SELECT query_id, (d // 2) % 64 AS place, sum(CASE WHEN d % 2 = 0 THEN y ELSE -y END) AS x FROM (
  SELECT query_id, sign(c) * (1 + ln(abs(c))) * idf AS y, unnest(list_transform(range(4), lambda j: ('0x' || substr(md5(slot::VARCHAR), 3 * j + 1, 3))::BIGINT)) AS d
  FROM {prefix}_in JOIN {prefix}_idf USING (slot)) GROUP BY ALL""", f"{prefix}_in", f"{prefix}_idf")
    O.cte(f"{prefix}_vec", f"""
SELECT query_id, list(CASE WHEN l = 0 THEN 0 ELSE x / l END ORDER BY place)::FLOAT[]::DOUBLE[] AS v FROM (
  SELECT query_id, place, coalesce(x, 0) AS x, sqrt(sum(coalesce(x, 0) * coalesce(x, 0)) OVER (PARTITION BY query_id)) AS l
  FROM (SELECT query_id, unnest(range(64)) AS place FROM {source}) LEFT JOIN {prefix}_sum USING (query_id, place)) GROUP BY query_id""",
          f"{prefix}_sum")


O.cte("all_docs", "SELECT 'documents:' || doc_id AS query_id, text FROM documents")
O.cte("calib_texts", "SELECT c.query_id, c.text FROM clean c JOIN splits s ON s.query_id = c.query_id WHERE s.split = 'calib'", "clean", "splits")
vector_ctes("dv", "all_docs", "all_docs", "all_docs")
vector_ctes("tv", "clean", "calib_texts", "clean", "calib_texts")

ARC_SPLIT = "CASE WHEN num % 3 = 0 THEN 'validation' ELSE 'test' END"
PLACE = "(('0x' || substr(md5('42:' || query_id), 1, 12))::BIGINT / 281474976710656.0)"
H7 = "doc_id % 7"
SPACED = "len(list_filter(string_split({}, ' '), lambda w: w <> ''))".format

ORACLE = {
    "corpus_saved": with_("clean splits", """
SELECT c.query_id, s.split, md5(c.text) AS text_md5, len(c.choices) AS n_choices, c.answer_index
FROM clean c JOIN splits s ON s.query_id = c.query_id"""),
    "corpus_loaded": with_("raw", f"""
SELECT 'ARC-Challenge:' || part || ':' || (row_number() OVER (PARTITION BY part ORDER BY num) - 1) AS query_id, md5({strip('text')}) AS text_md5,
  len(choices) AS n_choices, answer_index, 'd' || num AS native_id
FROM (SELECT *, {ARC_SPLIT} AS part FROM raw)"""),
    "sorted_sink": """
SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS row_index FROM (SELECT 'documents:' || doc_id AS query_id FROM documents)""",
    "extended_parts": with_("clean third_splits", f"""
SELECT c.query_id, coalesce(s.split, CASE WHEN {PLACE.replace('query_id', 'c.query_id')} < {RULE.test_fraction} THEN 'test' ELSE 'calib' END) AS split,
  false AS moved
FROM clean c LEFT JOIN third_splits s ON s.query_id = c.query_id"""),
    "holdout_faults": with_("splits", f"""
SELECT query_id, 'twice' AS reason FROM splits WHERE split = 'selection_holdout' AND {NUM('query_id')} % 2 = 0
UNION ALL SELECT 'benchmark:' || item_id, 'outside the corpus' FROM benchmark WHERE item_id % 10 = 0"""),
    "registered_source": with_("raw2", f"""
SELECT 'benchmark-items:test:' || num AS query_id, md5({strip('text')}) AS text_md5, len(choices) AS n_choices, answer_index,
  NULL::VARCHAR AS reject_reason FROM raw2"""),
    "lines_parted": f"""
SELECT 'good' AS reason, count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(length(text) + ({H7} = 4)::INT)::BIGINT AS chars
FROM documents WHERE {H7} NOT IN (1, 2, 3)
UNION ALL SELECT CASE {H7} WHEN 2 THEN 'no id' ELSE 'malformed' END AS reason, count(*), NULL, NULL
FROM documents WHERE {H7} IN (1, 2, 3) GROUP BY 1""",
    "traces_parted": with_("psi", f"""
SELECT 'good' AS reason, role, count(*) AS n, {r('avg(entropy)', 6, 'mean_entropy')} FROM psi WHERE {NUM('query_id')} % 6 IN (3, 5) GROUP BY role
UNION ALL SELECT CASE {NUM('query_id')} % 6 WHEN 0 THEN 'unknown protocol' WHEN 4 THEN 'no scores' ELSE 'broken trace' END AS reason, role,
  count(*), NULL FROM psi WHERE {NUM('query_id')} % 6 NOT IN (3, 5) GROUP BY 1, 2"""),
    "complete_rows": with_("light", f"""
SELECT split, count(*) AS n, count(*) FILTER ({NUM('query_id')} % 5 <> 0 AND {' AND '.join(f'{c} IS NOT NULL' for c in PSI_)}) AS n_complete
FROM light GROUP BY split HAVING n_complete > 0"""),
    "embeddings_stored": f"""
SELECT 'documents:' || vec_id AS query_id, len(embedding) AS width, {r('list_sum(embedding::DOUBLE[])', 5, 'total')} FROM embeddings""",
    "phi_old_layout": with_("phi_text", f"""
SELECT query_id, split, {', '.join(r(c, 9, c) for c in TEXT_COLS)},
  {r('phi__structural__prompt_token_len / 8', 9, 'phi__embedding_geometry__mean_knn_similarity')} FROM phi_text"""),
    "meta_of_signals": f"""
SELECT count(*) AS n_queries, 0::BIGINT AS n_without_metrics, {lit(','.join(sorted(PSI)))} AS metric_keys, 'v4' AS metrics_version FROM embeddings""",
    "scorecards_from_files": O.ORACLE["latest_scorecards"],
    "policy_defaults": with_("psi", f"""
SELECT query_id, {r('v', 6, 'score')}, CASE WHEN v > 0.5 THEN 'M_hi' ELSE 'M_lo' END AS model,
  'model_independent,model_dependent,cross_model' AS layers, 0.5::DOUBLE AS threshold
FROM (SELECT query_id, 1 / (1 + exp(-(0.5 * entropy - 0.25 * msp))) AS v FROM psi WHERE role = 'M_lo')"""),
    "runtime_features": with_("light", " UNION ALL ".join(
        f"SELECT {lit(dotted(c))} AS feature, {f'count({c})' if not c.startswith('phi__') else '0::BIGINT'} AS n, "
        f"{'false' if c.startswith('chi__') else 'true'} AS allowed FROM light" if not c.startswith("phi__")
        else f"SELECT {lit(dotted(c))} AS feature, 0::BIGINT AS n, true AS allowed" for c in FEATURES)),
    "feature_spec": with_("light light_r_uni", f"""
SELECT place::INTEGER AS place, feature, (SELECT count(psi__entropy) FROM light WHERE split = 'calib') AS n
FROM (SELECT feature, row_number() OVER (ORDER BY auroc DESC NULLS LAST, feature) - 1 AS place FROM light_r_uni) WHERE place < 3"""),
    "counted_tokens": with_("prompt", f"""
SELECT query_id, {SPACED('prompt')}::DOUBLE AS phi__structural__prompt_token_len, q AS phi__structural__question_token_len,
  {r('list_avg(o)', 9, 'phi__structural__mean_option_token_len')},
  {r('q / CASE WHEN list_sum(o) = 0 THEN 1 ELSE list_sum(o) END', 9, 'phi__structural__question_option_ratio')}
FROM (SELECT *, {SPACED('question')}::DOUBLE AS q, list_transform(choices, lambda x: {SPACED('x')}) AS o FROM prompt)"""),
    "registered_protocol": with_("psi psi2", f"""
SELECT query_id, role, {r('entropy', 6, 'entropy')}, {r('msp', 6, 'msp')}, true AS trace_valid FROM (
  SELECT query_id, role, entropy, msp FROM psi WHERE role = 'M_lo' UNION ALL SELECT query_id, role, entropy, msp FROM psi2 WHERE role = 'M_hi')"""),
    "late_rows": """
WITH a AS (SELECT event_id, ts::TIMESTAMP AS ts, user_id IN (SELECT vec_id FROM embeddings) AS ok, 1 AS run FROM events),
b AS (SELECT * FROM a UNION ALL SELECT event_id, ts, ok, 2 FROM a WHERE event_id % 5 = 0),
c AS (SELECT *, run = 2 AND ok AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM a WHERE ok) - INTERVAL 10 MINUTE AS late FROM b)
SELECT count(*) AS arrived, count(*) FILTER (NOT ok) AS skipped, 0::BIGINT AS untimed, count(*) FILTER (ok) AS counted,
  count(*) FILTER (ok AND NOT late) AS in_windows, count(*) FILTER (late) AS late FROM c""",
    "document_vectors": with_("dv_vec", f"""
SELECT query_id, place::INTEGER AS place, {r('v', 5, 'v')} FROM (SELECT query_id, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS place FROM dv_vec)"""),
}


def on_text_vectors() -> None:
    """The geometry signals once more, over the vectors of the texts: every step that rests on ``vec``, under another name."""
    rests: list[str] = ["vec"]
    for name, (needs, _) in O.CTES.items():
        if set(needs) & set(rests):
            rests.append(name)
    named = re.compile(r"\b(" + "|".join(rests) + r")\b")
    renamed = lambda text: named.sub(lambda m: "tv_vec" if m[1] == "vec" else f"t_{m[1]}", text)
    for name in rests[1 : rests.index("geometry") + 1]:
        needs, sql = O.CTES[name]
        O.cte(f"t_{name}", renamed(sql), *map(renamed, needs))


on_text_vectors()
ORACLE["text_geometry"] = with_(
    "t_geometry", f"SELECT query_id, {', '.join(r(c, 4, c) for c in GEO_COLS if 'lof' not in c)} FROM t_geometry")
