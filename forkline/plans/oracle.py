"""SQL counterparts of the registered queries, for another engine on the same tables.

Each is written from the definition of its result, by brute force where that is
simplest, and shares no code with the Spark jobs.
"""

from __future__ import annotations

from forkline.plans import workload as W

# Fixed values, stated here once more: white space, words, the system prompt, the names of signals and their blocks.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000")
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
SYSTEM_PROMPT = """\
You answer multiple-choice questions.

Rules:
- Read the question and all options carefully.
- Reply with exactly one line containing only the letter label of the correct option (A, B, C, …).
- Do not include explanation, punctuation, or any other text.
"""
PSI = (
    "effective_support", "entropy", "margin", "mean_logprob", "msp", "normalized_entropy", "option_count", "predicted_logprob",
    "top2_gap", "top_probability_ratio")
CHI = ("delta_entropy", "delta_margin", "delta_mean_logprob", "delta_msp", "prediction_disagreement")
TEXT_BLOCKS = {
    "structural": ("prompt_token_len", "question_token_len", "mean_option_token_len", "std_option_token_len", "question_option_ratio",
                   "mattr", "compression_ratio"),
    "ambiguity": ("stem_choice_overlap_max", "stem_choice_overlap_mean", "choice_choice_overlap", "choice_length_range"),
    "embedding_geometry": ("pc1", "pc2", "pc3", "centroid_distance", "mean_knn_similarity", "lof_score"),
}
BLOCK_MEMBERS = [
    *(("phi", block, f"phi.{block}.{n}") for block, names in TEXT_BLOCKS.items() for n in names),
    *(("phi", "all", f"phi.{block}.{n}") for block, names in TEXT_BLOCKS.items() for n in names),
    *(("psi", family, f"{prefix}.{n}") for family, prefix in (("psi_lo", "psi"), ("psi_hi", "psi_hi")) for n in PSI),
    *(("chi", "all", f"chi.{n}") for n in CHI),
]


def dotted(column: str) -> str:
    return ".".join(column.split("__"))


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS, WRD = lit(WHITE_SPACE), lit(WORD)
LINE_END = lit(r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\x{2028}\x{2029}]")
LONE = lit(r"(?:^|[^\p{L}\p{N}_])([A-Za-z])(?:[^\p{L}\p{N}_]|$)")


def r(expr: str, places: int = 6, name: str | None = None) -> str:
    half = 0.5 * 10 ** -places
    shown = f"CASE WHEN abs({expr}) < {half!r} THEN 0.0 ELSE round({expr}, {places}) END"
    return f"{shown} AS {name}" if name else shown


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {WRD}), lambda wd: lower(wd))"


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {WRD}))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (
        f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 "
        f"ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END)"
    )


def parse(raw: str, n: str) -> tuple[str, str]:
    line = f"{strip(f'string_split_regex({strip(raw)}, {LINE_END})[1]')}"
    found = f"regexp_extract({line}, {LONE}, 1)"
    index = f"(ascii(upper({found})) - 65)"
    return line, f"CASE WHEN {found} <> '' AND {index} < {n} THEN {index}::INTEGER END"


BUCKET = (
    "CASE WHEN y_lo <> 0 AND y_hi <> 0 THEN 'easy' WHEN y_lo = 0 AND y_hi <> 0 THEN 'opportunity' "
    "WHEN y_lo <> 0 AND y_hi = 0 THEN 'lo_only' ELSE 'too_hard' END"
)
NEED = "CASE WHEN y_lo = 0 AND y_hi = 1 THEN 1 ELSE 0 END"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def with_(names: str | list[str], body: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in CTES[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names.split() if isinstance(names, str) else names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + body


def question_cte(name: str, table: str, number: str, lang: str) -> None:
    cte(name, f"""
SELECT '{table}:' || num AS query_id, num, lang, CAST(num % 4 AS INTEGER) AS answer_index,
  array_to_string(w[1:n - 4 * c], ' ') AS text,
  CASE WHEN c > 0 THEN list_transform(range(0, 4),
       lambda i: array_to_string(w[n - 4 * c + i * c + 1 : n - 4 * c + i * c + c], ' ')) ELSE [] END AS choices
FROM (SELECT num, lang, w, len(w) AS n, len(w) // 8 AS c
      FROM (SELECT {number} AS num, {lang} AS lang, string_split(text, ' ') AS w FROM {table}))""")


question_cte("raw", "documents", "doc_id", "lang")
question_cte("raw2", "benchmark", "item_id", "NULL::VARCHAR")
for raw, clean in (("raw", "clean"), ("raw2", "clean2")):
    cte(clean, f"""
SELECT query_id, num, lang, answer_index, {strip('text')} AS text,
  list_transform(choices, lambda x: {strip('x')}) AS choices
FROM {raw} WHERE {strip('text')} <> '' AND len(choices) >= 2 AND answer_index >= 0 AND answer_index < len(choices)""", raw)


def split_cte(name: str, source: str, *needs: str) -> None:
    rule = W.RULE
    cte(name, f"""
SELECT query_id, CASE WHEN rn <= {rule.holdout_n} THEN 'selection_holdout'
  WHEN rn <= {rule.holdout_n} + t THEN 'test' ELSE 'calib' END AS split
FROM (SELECT query_id, rn, greatest({rule.test_min}, least({rule.test_max},
        round_even({rule.test_fraction} * (n - {rule.holdout_n}), 0))) AS t
      FROM (SELECT query_id, row_number() OVER (ORDER BY md5('42:' || query_id), query_id) AS rn, count(*) OVER () AS n
            FROM {source}))""", *needs)


split_cte("splits", "clean", "clean")
told = "chr(CAST(65 + (doc_id % 4 + 1 - ok) % 4 AS INTEGER))"
cte("outputs", f"""
SELECT 'documents:' || doc_id AS query_id, role, model,
  CASE doc_id % 3 WHEN 0 THEN {told} WHEN 1 THEN '(' || {told} || ') because'
       ELSE chr(10) || chr(10) || ' ' || lower({told}) || ' ' END AS raw_output
FROM (SELECT doc_id, 'M_lo' AS role, 'cheap' AS model, toxic AS ok FROM labels
      UNION ALL SELECT doc_id, 'M_hi', 'strong', quality FROM labels)""")
_, parsed = parse("o.raw_output", "len(c.choices)")
cte("graded", f"""
SELECT query_id, role, model, parsed_answer, CASE WHEN parsed_answer = answer_index THEN 1 ELSE 0 END AS correct
FROM (SELECT o.query_id, o.role, o.model, c.answer_index, {parsed} AS parsed_answer
      FROM outputs o JOIN clean c ON o.query_id = c.query_id)""", "outputs", "clean")
cte("pairs", """
SELECT query_id, max(correct) FILTER (role = 'M_lo') AS y_lo, max(correct) FILTER (role = 'M_hi') AS y_hi,
  max(parsed_answer) FILTER (role = 'M_lo') AS parsed_lo, max(parsed_answer) FILTER (role = 'M_hi') AS parsed_hi
FROM graded GROUP BY query_id""", "graded")
cte("scores", f"""
SELECT 'documents:' || vec_id AS query_id, 'M_lo' AS role,
  list_transform(range(0, 8), lambda i: list_max(e[i * 4 + 1 : i * 4 + 4])) AS s
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * {W.SCORE_SPREAD}) AS e FROM embeddings)
UNION ALL
SELECT 'documents:' || vec_id, 'M_hi', list_transform(range(0, 8), lambda i: list_sum(e[i * 4 + 33 : i * 4 + 36]) / 4)
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * {W.SCORE_SPREAD}) AS e FROM embeddings)""")


def psi_cte(name: str, temperature: float) -> None:
    cte(name, f"""
SELECT query_id, role, parsed_answer, exp(h) AS effective_support, h AS entropy, d[1] - d[2] AS margin,
  best AS mean_logprob, d[1] AS msp, h / ln(8) AS normalized_entropy, 8.0::DOUBLE AS option_count, best AS predicted_logprob,
  d[1] - d[2] AS top2_gap, CASE WHEN d[2] > 1e-12 THEN d[1] / d[2] ELSE 1e6 END AS top_probability_ratio
FROM (SELECT query_id, role, best, parsed_answer, list_reverse_sort(p) AS d,
        -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0.0 END)) AS h
      FROM (SELECT query_id, role, list_max(s) AS best, chr(CAST(64 + list_position(s, list_max(s)) AS INTEGER)) AS parsed_answer,
              list_transform(ex, lambda x: x / list_sum(ex)) AS p
            FROM (SELECT query_id, role, s,
                    list_transform(s, lambda x: exp((x - list_max(s)) / {temperature})) AS ex FROM scores)))""", "scores")


psi_cte("psi", 1.0)
psi_cte("psi2", 2.0)
cte("chi", """
SELECT l.query_id, h.entropy - l.entropy AS chi__delta_entropy, h.margin - l.margin AS chi__delta_margin,
  h.mean_logprob - l.mean_logprob AS chi__delta_mean_logprob, h.msp - l.msp AS chi__delta_msp,
  coalesce(p.parsed_lo <> p.parsed_hi, false) AS chi__prediction_disagreement
FROM psi l JOIN psi h ON l.query_id = h.query_id AND l.role = 'M_lo' AND h.role = 'M_hi'
JOIN pairs p ON p.query_id = l.query_id""", "psi", "pairs")

# Text signals.
question = "CASE WHEN lang IS NOT NULL AND lang <> '' THEN 'Subject: ' || lang || chr(10) || chr(10) || text ELSE text END"
cte("prompt", f"""
SELECT query_id, num, lang, text, choices, question,
  question || chr(10) || chr(10) || array_to_string(list_transform(choices,
    lambda x, i: chr(CAST(64 + i AS INTEGER)) || '. ' || x), chr(10)) || chr(10) || chr(10) || 'Answer:' || chr(10) AS prompt
FROM (SELECT *, {question} AS question FROM clean)""", "clean")


def mattr_ctes(prefix: str, source: str, key: str, text: str, window: int, *needs: str) -> None:
    """By definition: the share of different words, averaged over all windows."""
    cte(f"{prefix}_mattr", f"""
SELECT {key}, CASE WHEN n = 0 THEN NULL WHEN n < {window} THEN len(list_distinct(t))::DOUBLE / n
  ELSE list_sum(list_transform(range(1, n - {window} + 2), lambda i: len(list_distinct(t[i:i + {window} - 1]))))::DOUBLE
    / {window} / (n - {window} + 1) END AS mattr
FROM (SELECT {key}, t, len(t) AS n FROM (SELECT {key}, {words(text)} AS t FROM {source}))""", *needs)


mattr_ctes("prompt", "prompt", "query_id", "prompt", 25, "prompt")
mattr_ctes("doc", "documents", "doc_id", "text", 50)
cte("structural", f"""
SELECT p.query_id, {n_words('prompt')}::DOUBLE AS phi__structural__prompt_token_len,
  {n_words('question')}::DOUBLE AS phi__structural__question_token_len,
  list_avg(o) AS phi__structural__mean_option_token_len,
  sqrt(len(o) * list_sum(list_transform(o, lambda x: x * x)) - list_sum(o) * list_sum(o)) / len(o) AS phi__structural__std_option_token_len,
  {n_words('question')}::DOUBLE / CASE WHEN list_sum(o) = 0 THEN 1 ELSE list_sum(o) END AS phi__structural__question_option_ratio,
  m.mattr AS phi__structural__mattr
FROM (SELECT *, list_transform(choices, lambda x: {n_words('x')}) AS o FROM prompt) p
LEFT JOIN prompt_mattr m ON m.query_id = p.query_id""", "prompt", "prompt_mattr")
pair_list = ", ".join(jaccard(f"sets[{i}]", f"sets[{j}]") for i in range(1, 5) for j in range(i + 1, 5))
stem_list = ", ".join(jaccard("stem", f"sets[{i}]") for i in range(1, 5))
cte("ambiguity", f"""
SELECT query_id, list_max(j) AS phi__ambiguity__stem_choice_overlap_max, list_sum(list_sort(j)) / 4 AS phi__ambiguity__stem_choice_overlap_mean,
  list_sum(list_sort(c)) / 6 AS phi__ambiguity__choice_choice_overlap,
  (list_max(len_) - list_min(len_))::DOUBLE AS phi__ambiguity__choice_length_range
FROM (SELECT query_id, [{stem_list}] AS j, [{pair_list}] AS c, len_
      FROM (SELECT query_id, list_distinct({words('text')}) AS stem,
              list_transform(choices, lambda x: list_distinct({words('x')})) AS sets,
              list_transform(choices, lambda x: length(x)) AS len_ FROM clean))""", "clean")
TEXT_COLS = [
    *(f"phi__structural__{c}" for c in (
        "prompt_token_len", "question_token_len", "mean_option_token_len", "std_option_token_len",
        "question_option_ratio", "mattr")),
    *(f"phi__ambiguity__{c}" for c in (
        "stem_choice_overlap_max", "stem_choice_overlap_mean", "choice_choice_overlap", "choice_length_range")),
]
cte("phi_text", """
SELECT s.*, a.* EXCLUDE (query_id), sp.split FROM structural s JOIN ambiguity a ON a.query_id = s.query_id
JOIN splits sp ON sp.query_id = s.query_id AND sp.split IN ('calib', 'test')""", "structural", "ambiguity", "splits")

# Geometry.
cte("vec", """
SELECT 'documents:' || vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings""")
cte("rows_", """
SELECT v.query_id, v.v, s.split FROM vec v JOIN splits s ON s.query_id = v.query_id
WHERE s.split IN ('calib', 'test')""", "vec", "splits")
cte("centroid", """
SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM
  (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rows_ WHERE split = 'calib') GROUP BY i)""", "rows_")
# Axes: the covariance, deflated once per axis; its squares, squared again and again, leave the leading direction.
cte("cov0", """
SELECT list(m ORDER BY i) AS s FROM (SELECT i, list(v ORDER BY j) AS m FROM (
  SELECT a.i, b.i AS j, sum(a.x * b.x) AS v
  FROM (SELECT query_id, generate_subscripts(v, 1) AS i, unnest(v) - unnest(c) AS x FROM rows_, centroid WHERE split = 'calib') a
  JOIN (SELECT query_id, generate_subscripts(v, 1) AS i, unnest(v) - unnest(c) AS x FROM rows_, centroid WHERE split = 'calib') b
  USING (query_id) GROUP BY 1, 2) GROUP BY i)""", "rows_", "centroid")
DIAGONAL = "list_transform(range(1, len({0}) + 1), lambda i: {0}[i][i])"
for axis in (1, 2, 3):
    cte(f"axis{axis}", f"""
WITH RECURSIVE p(s, k) AS (
  SELECT s, 0 FROM cov{axis - 1}
  UNION ALL
  SELECT list_transform(q, lambda a: list_transform(a, lambda x: x / list_sum({DIAGONAL.format('q')}))), k + 1
  FROM (SELECT list_transform(s, lambda a: list_transform(s, lambda b: list_dot_product(a, b))) AS q, k FROM p WHERE k < 34)),
column_ AS (SELECT s[list_position(d, list_max(d))] AS u FROM (SELECT s, {DIAGONAL.format('s')} AS d FROM p WHERE k = 34)),
unit AS (SELECT list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS u FROM column_),
big AS (SELECT u, list_transform(u, lambda x: abs(x)) AS a FROM unit)
SELECT CASE WHEN u[list_position(a, list_max(a))] < 0 THEN list_transform(u, lambda x: -x) ELSE u END AS u FROM big""", f"cov{axis - 1}")
    cte(f"cov{axis}", f"""
SELECT list_transform(s, lambda a, i: list_transform(a, lambda x, j: x - l * u[i] * u[j])) AS s
FROM (SELECT s, u, list_dot_product(u, list_transform(s, lambda a: list_dot_product(a, u))) AS l FROM cov{axis - 1}, axis{axis})""",
        f"cov{axis - 1}", f"axis{axis}")
cte("axes", f"""
SELECT query_id, {', '.join(f'list_dot_product(v, a{i}.u) - list_dot_product(c, a{i}.u) AS pc{i}' for i in (1, 2, 3))}
FROM rows_, centroid, {', '.join(f'axis{i} a{i}' for i in (1, 2, 3))}""", "rows_", "centroid", "axis1", "axis2", "axis3")
cte("cosine_hits", """
SELECT query_id, base_id, d FROM (
  SELECT q.query_id, b.query_id AS base_id, d, row_number() OVER (PARTITION BY q.query_id ORDER BY d, b.query_id) AS rn
  FROM rows_ q, rows_ b, LATERAL (SELECT 1 - list_cosine_similarity(q.v, b.v) AS d) WHERE b.split = 'calib')
WHERE rn <= 10""", "rows_")
cte("near", """
SELECT q.query_id, q.split, b.query_id AS base_id, list_distance(q.v, b.v) AS d
FROM rows_ q, rows_ b WHERE b.split = 'calib'""", "rows_")
cte("base_hits", """
SELECT query_id, base_id, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, base_id) AS rn
  FROM near WHERE split = 'calib' AND base_id <> query_id) WHERE rn <= 10""", "near")
cte("kdist", "SELECT query_id AS base_id, max(d) AS kd FROM base_hits GROUP BY query_id", "base_hits")
cte("lrd", """
SELECT h.query_id AS base_id, 1 / (avg(greatest(kd, d)) + 1e-10) AS lrd
FROM base_hits h JOIN kdist USING (base_id) GROUP BY h.query_id""", "base_hits", "kdist")
cte("lof_raw", """
SELECT query_id, any_value(split) AS split, avg(lrd) * (avg(greatest(kd, d)) + 1e-10) AS raw
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, base_id) AS rn FROM near)
JOIN kdist USING (base_id) JOIN lrd USING (base_id) WHERE rn <= 10 GROUP BY query_id""", "near", "kdist", "lrd")
cte("geometry", """
SELECT g.query_id, 1 - list_cosine_similarity(g.v, c.c) AS phi__embedding_geometry__centroid_distance,
  x.pc1 AS phi__embedding_geometry__pc1, x.pc2 AS phi__embedding_geometry__pc2, x.pc3 AS phi__embedding_geometry__pc3,
  k.sim AS phi__embedding_geometry__mean_knn_similarity,
  (l.raw - st.m) / CASE WHEN st.s = 0 THEN 1 ELSE st.s END AS phi__embedding_geometry__lof_score
FROM rows_ g JOIN axes x ON x.query_id = g.query_id CROSS JOIN centroid c
JOIN (SELECT query_id, avg(1 - d) AS sim FROM cosine_hits GROUP BY query_id) k ON k.query_id = g.query_id
JOIN lof_raw l ON l.query_id = g.query_id
CROSS JOIN (SELECT avg(raw) AS m, stddev_pop(raw) AS s FROM lof_raw WHERE split = 'calib') st""",
    "rows_", "axes", "centroid", "cosine_hits", "lof_raw")
GEO_COLS = [f"phi__embedding_geometry__{c}" for c in ("pc1", "pc2", "pc3", "centroid_distance", "mean_knn_similarity", "lof_score")]

# Standardised text and geometry signals.
cte("phi_all", f"""
SELECT t.*, {', '.join(f'g.{c}' for c in GEO_COLS)} FROM phi_text t LEFT JOIN geometry g ON g.query_id = t.query_id""",
    "phi_text", "geometry")


def zscore_cte(name: str, source: str, cols: list[str]) -> None:
    def scaled(c: str) -> str:
        return (
            f"(t.{c} - s.m_{c}) / CASE WHEN s.s_{c} = 0 OR s.n_{c} < 2 THEN 1 ELSE s.s_{c} END AS {c}"
        )

    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, count({c}) AS n_{c}" for c in cols)
    cte(name, f"""
SELECT t.query_id, {', '.join(scaled(c) for c in cols)}
FROM {source} t CROSS JOIN (SELECT {stats} FROM {source} WHERE split = 'calib') s""", source)


zscore_cte("phi_text_z", "phi_text", TEXT_COLS)
zscore_cte("phi_all_z", "phi_all", TEXT_COLS + GEO_COLS)
PSI_ = [f"psi__{m}" for m in PSI]
PSI_HI = [f"psi_hi__{m}" for m in PSI]
CHI_ = [f"chi__{m}" for m in CHI]


def analysis_cte(name: str, phi: str | None, phi_cols: list[str]) -> None:
    needs = ["splits", "pairs", "psi", "chi"] + ([phi] if phi else [])
    cols = ", ".join(
        [f"f.{c}" for c in phi_cols] + [f"l.{m} AS psi__{m}" for m in PSI] + [f"h.{m} AS psi_hi__{m}" for m in PSI]
        + [f"c.{c}" for c in CHI_[:-1]] + [f"c.{CHI_[-1]}::INTEGER::DOUBLE AS {CHI_[-1]}"]
    )
    join = f"LEFT JOIN {phi} f ON f.query_id = s.query_id" if phi else ""
    cte(name, f"""
SELECT s.query_id, s.split, {NEED} AS r, {BUCKET} AS bucket, y_lo, y_hi, {cols}
FROM splits s JOIN pairs p ON p.query_id = s.query_id {join}
LEFT JOIN psi l ON l.query_id = s.query_id AND l.role = 'M_lo'
LEFT JOIN psi h ON h.query_id = s.query_id AND h.role = 'M_hi'
LEFT JOIN chi c ON c.query_id = s.query_id
WHERE s.split IN ('calib', 'test')""", *needs)


analysis_cte("light", None, [])
analysis_cte("analysis", "phi_all_z", TEXT_COLS + GEO_COLS)
ALL_COLS = TEXT_COLS + GEO_COLS + PSI_ + PSI_HI + CHI_
LABELS = "query_id, split, r, bucket, y_lo, y_hi"


def rank_ctes(prefix: str, source: str, features: dict[str, str], targets: list[str], *needs: str) -> None:
    """Ranking metrics by definition: average ranks, then rank sums; precision at every distinct value."""
    feats = ", ".join(f"{{'feature': {lit(f)}, 'v': {e}}}" for f, e in features.items())
    targs = ", ".join(f"{{'target': {lit(t)}, 'y': {t}}}" for t in targets)
    cte(f"{prefix}_long", f"""
SELECT f.feature, f.v AS v, t.target, t.y AS y FROM (
  SELECT f, unnest([{targs}]) AS t FROM (SELECT unnest([{feats}]) AS f, {', '.join(targets)} FROM {source}))
WHERE f.v IS NOT NULL""", *needs)
    cte(f"{prefix}_val", f"""
SELECT feature, target, v, count(*) AS c, sum(y) AS p FROM {prefix}_long GROUP BY ALL""", f"{prefix}_long")
    cte(f"{prefix}_rank", f"""
SELECT *, sum(c) OVER up - c + (c + 1) / 2.0 AS rk, sum(p) OVER down AS tp, sum(c) OVER down AS seen
FROM {prefix}_val WINDOW up AS (PARTITION BY feature, target ORDER BY v), down AS (PARTITION BY feature, target ORDER BY v DESC)""",
        f"{prefix}_val")
    cte(f"{prefix}_sum", f"""
SELECT feature, target, sum(c)::DOUBLE AS n, sum(p)::DOUBLE AS p, sum(p * rk)::DOUBLE AS rs, min(v) AS lo, max(v) AS hi,
  sum(p * tp::DOUBLE / seen) AS ap, sum(c * rk * rk)::DOUBLE AS rr, sum(v * p)::DOUBLE AS vp, sum(v * (c - p))::DOUBLE AS vn
FROM {prefix}_rank GROUP BY feature, target""", f"{prefix}_rank")
    cte(f"{prefix}_uni", f"""
SELECT *, CASE WHEN auroc IS NULL THEN NULL WHEN mean_positive > mean_negative THEN 'positive'
  WHEN mean_positive < mean_negative THEN 'negative' WHEN spearman > 0 THEN 'positive' WHEN spearman < 0 THEN 'negative' END AS direction
FROM (SELECT feature, target, n::BIGINT AS n, p::BIGINT AS n_pos, (n - p)::BIGINT AS n_neg,
  CASE WHEN p > 0 THEN CASE WHEN lo = hi THEN lo ELSE vp / p END END AS mean_positive,
  CASE WHEN n > p THEN CASE WHEN lo = hi THEN lo ELSE vn / (n - p) END END AS mean_negative,
  CASE WHEN p > 0 AND n > p THEN (rs - p * (p + 1) / 2) / (p * (n - p)) END AS auroc,
  CASE WHEN p > 0 AND n > p THEN ap / p END AS auprc,
  CASE WHEN p > 0 AND n > p AND lo <> hi THEN
    (rs - p * (n + 1) / 2) / sqrt((rr - n * ((n + 1) / 2) * ((n + 1) / 2)) * (p - p * p / n)) END AS spearman
  FROM {prefix}_sum WHERE n >= 5)""", f"{prefix}_sum")


cte("calib_a", "SELECT * FROM analysis WHERE split = 'calib'", "analysis")
rank_ctes("a", "calib_a", {dotted(c): c for c in ALL_COLS}, ["r", "y_lo", "y_hi"], "calib_a")
cte("items", """
SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, l_quantity::DOUBLE AS quantity,
  l_extendedprice::DOUBLE AS price, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax FROM lineitem""")
rank_ctes("li", "items", {c: c for c in ("quantity", "price", "discount", "tax")}, ["returned"], "items")
members = ", ".join(f"({lit(f)}, {lit(b)}, {lit(c)})" for f, b, c in BLOCK_MEMBERS)


def uni_select(prefix: str, places: int, family: bool) -> str:
    fam = ", string_split(feature, '.')[1] AS family" if family else ""
    doubles = ", ".join(
        r(c, places, c) for c in ("mean_positive", "mean_negative", "auroc", "auprc", "spearman")
    )
    return f"SELECT feature, target, n, n_pos, n_neg, {doubles}, direction{fam} FROM {prefix}_uni"


# Policy.
pol = W.FIXED_POLICY
z = f"{pol.intercept} + " + " + ".join(
    f"{w} * ((l.{c.split('.')[1]} - {m}) / {s or 1.0})"
    for c, m, s, w in zip(pol.feature_columns, pol.scaler_mean, pol.scaler_scale, pol.weights)
)
cte("routed", f"""
SELECT query_id, score, score > {pol.threshold} AS use_strong,
  CASE WHEN score > {pol.threshold} THEN '{pol.pool_hi}' ELSE '{pol.pool_lo}' END AS model
FROM (SELECT l.query_id, 1 / (1 + exp(-({z}))) AS score FROM psi l WHERE role = 'M_lo')""", "psi")
MISSING = lit("missing " + pol.feature_columns[0])
cte("scored", f"""
SELECT d.query_id, d.score, {NEED} AS r FROM routed d JOIN pairs p ON p.query_id = d.query_id""", "routed", "pairs")
cte("sweep", """
SELECT i::INTEGER AS step, i / 100.0::DOUBLE AS tau,
  avg(CASE WHEN (score > i / 100.0::DOUBLE)::INTEGER = r THEN 1.0 ELSE 0.0 END) AS accuracy
FROM scored, range(1, 100) t(i) GROUP BY i""", "scored")
cte("decided", f"""
SELECT s.query_id, p.y_lo, p.y_hi, d.score, d.use_strong,
  CASE WHEN p.y_lo IS NULL THEN 'no result' WHEN d.score IS NULL THEN {MISSING} END AS skip_reason
FROM splits s LEFT JOIN pairs p ON p.query_id = s.query_id LEFT JOIN routed d ON d.query_id = s.query_id
WHERE s.split = 'test'""", "splits", "pairs", "routed")
cte("report", f"""
SELECT count(*) AS n, round_even(avg(CASE WHEN use_strong THEN y_hi ELSE y_lo END), 4) AS acc_policy,
  round_even(avg(y_lo), 4) AS acc_always_lo, round_even(avg(y_hi), 4) AS acc_always_hi,
  round_even(avg(greatest(y_lo, y_hi)), 4) AS acc_oracle,
  round_even(avg(CASE WHEN use_strong THEN {W.KAPPA}::DOUBLE ELSE 0.0 END), 4) AS cost_policy,
  round_even(avg(CASE WHEN y_lo = 0 AND y_hi = 1 THEN {W.KAPPA}::DOUBLE ELSE 0.0 END), 4) AS cost_oracle,
  0.0::DOUBLE AS cost_always_lo, {W.KAPPA}::DOUBLE AS cost_always_hi
FROM decided WHERE skip_reason IS NULL""", "decided")
cte("arrived", f"""
SELECT e.event_id, e.ts, 'documents:' || e.user_id AS query_id, d.score, d.use_strong, d.model,
  CASE WHEN d.score IS NULL THEN {MISSING} END AS skip_reason
FROM events e LEFT JOIN routed d ON d.query_id = 'documents:' || e.user_id""", "routed")


# Scorecards.
def card(by: str) -> str:
    cols = f"{by}, " if by else ""
    return f"""
SELECT {cols}n, acc_lo AS raw_lo, acc_hi AS raw_hi, acc_hi - acc_lo AS raw_gap, n_opportunity::DOUBLE / n AS raw_opp,
  n_too_hard::DOUBLE / n AS raw_hard, n_easy, n_opportunity, n_lo_only, n_too_hard FROM (
  SELECT {cols}count(*) AS n, avg(y_lo) AS acc_lo, avg(y_hi) AS acc_hi, count(*) FILTER (b = 'easy') AS n_easy,
    count(*) FILTER (b = 'opportunity') AS n_opportunity, count(*) FILTER (b = 'lo_only') AS n_lo_only,
    count(*) FILTER (b = 'too_hard') AS n_too_hard
  FROM (SELECT *, {BUCKET} AS b FROM __SRC__) {f'GROUP BY {by}' if by else ''})"""


CARD_COLS = """n, round_even(raw_lo, 4) AS acc_lo, round_even(raw_hi, 4) AS acc_hi, n_easy, n_opportunity, n_lo_only, n_too_hard,
  round_even(raw_gap, 4) AS acc_gap, round_even(raw_opp, 4) AS opportunity_rate, round_even(raw_hard, 4) AS too_hard_rate,
  raw_gap >= 0.03 AS gate_c_pass, raw_opp >= 0.05 AND raw_hard < 0.7 AS gate_d_pass"""
cte("pairs_split", "SELECT p.*, s.split FROM pairs p JOIN splits s ON s.query_id = p.query_id", "pairs", "splits")
cte("pairs_source", """
SELECT p.*, d.lang, d.source, d.doc_id FROM pairs p JOIN documents d ON p.query_id = 'documents:' || d.doc_id""", "pairs")
cte("candidates", f"""
SELECT c.lang AS dataset, c.source AS run_id, t.ts AS timestamp, {CARD_COLS}
FROM ({card('lang, source').replace('__SRC__', 'pairs_source')}) c
JOIN (SELECT lang, source, lpad(max(doc_id)::VARCHAR, 12, '0') AS ts FROM pairs_source GROUP BY lang, source) t
  ON t.lang = c.lang AND t.source = c.source""", "pairs_source")
cte("latest", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY timestamp DESC, run_id) AS rn FROM candidates)
WHERE rn = 1""", "candidates")
PREF = "CASE dataset WHEN 'de' THEN 1 WHEN 'en' THEN 2 ELSE 3 END"


def fmt(x: str) -> str:
    return f"printf('%.3f', {x})"


# Source rows.
def source_sql(name: str, split: str, text: str, n: str, answer: str, subject: str, needs: str = "raw") -> str:
    return with_(needs, f"""
SELECT '{name}:{split}:' || num AS query_id, md5({text}) AS text_md5, {n} AS n_choices, {answer} AS answer_index,
  {subject} AS subject, CASE WHEN {answer} IS NULL THEN 'bad answer' END AS reject_reason FROM raw""")


ORACLE: dict[str, str] = {
    "corpus_clean": with_("clean", """
SELECT query_id, md5(text) AS text_md5, md5(array_to_string(choices, ' | ')) AS choices_md5, len(choices)::INTEGER AS n_choices,
  answer_index, lang AS subject FROM clean"""),
    "corpus_counters": with_("raw clean", """
SELECT (SELECT count(*) FROM raw) AS n_loaded, (SELECT count(*) FROM raw) - (SELECT count(*) FROM clean) AS n_dropped_invalid,
  (SELECT count(*) FROM clean) AS n_after_clean,
  (SELECT count(*) FROM (SELECT query_id FROM clean GROUP BY 1 HAVING count(*) > 1)) AS n_duplicate_ids"""),
    "source_arc": source_sql(
        "ARC-Challenge", "test", strip("text"), "len(choices)::INTEGER",
        "(CASE num % 3 WHEN 0 THEN num % 4 WHEN 1 THEN CASE WHEN num % 2 = 0 THEN num % 4 END ELSE num % 4 END)::INTEGER",
        "NULL::VARCHAR",
    ).replace("' || num AS query_id", "' || (row_number() OVER (ORDER BY num) - 1) AS query_id"),
    "source_mmlu": with_("raw", f"""
SELECT 'MMLU_PRO:test:' || num AS query_id, md5({strip('text')}) AS text_md5,
  CASE WHEN len(choices) > 0 THEN len(choices)::INTEGER END AS n_choices, (num % 4)::INTEGER AS answer_index,
  CASE WHEN num % 5 > 0 THEN lang ELSE 'cat-' || lang END AS subject,
  CASE WHEN len(choices) = 0 THEN 'no choices' END AS reject_reason FROM raw"""),
    "source_truthfulqa": source_sql(
        "TruthfulQA", "validation", strip("text"), "len(choices)::INTEGER",
        "(CASE WHEN num % 7 <> 0 THEN num % 4 END)::INTEGER", "NULL::VARCHAR",
    ),
    "source_hellaswag": source_sql(
        "HellaSwag", "validation",
        f"CASE WHEN num % 2 = 1 AND text <> '' THEN text ELSE {strip(chr(40) + 'text || chr(32) || lang' + chr(41))} END",
        "len(choices)::INTEGER", "(num % 4)::INTEGER", "NULL::VARCHAR",
    ),
    "row_numbers": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents",
    "split_sizes": with_("splits", "SELECT split, count(*) AS n FROM splits GROUP BY split"),
    "split_members": with_("splits", "SELECT query_id, split FROM splits"),
    "holdout_members": with_("splits", "SELECT query_id, split FROM splits WHERE split = 'selection_holdout'"),
    "split_violations": with_("raw splits", """
SELECT (SELECT count(*) FROM (SELECT query_id FROM splits GROUP BY 1 HAVING count(*) > 1)) AS n_in_two_parts,
  (SELECT count(*) FROM splits WHERE query_id NOT IN (SELECT query_id FROM raw)) AS n_unknown,
  (SELECT count(*) FROM raw WHERE query_id NOT IN (SELECT query_id FROM splits)) AS n_uncovered,
  (3 - (SELECT count(DISTINCT split) FROM splits))::INTEGER AS n_empty_parts"""),
    "split_leaks": with_("raw splits", """
SELECT r.query_id, CASE WHEN s.split IS NULL THEN 'unknown' ELSE 'holdout' END AS reason
FROM raw r LEFT JOIN splits s ON s.query_id = r.query_id WHERE s.split IS NULL OR s.split = 'selection_holdout'"""),
    "select_calib": with_("clean splits", """
SELECT c.query_id, c.answer_index FROM clean c JOIN splits s ON s.query_id = c.query_id WHERE s.split = 'calib'
ORDER BY md5('42:' || c.query_id), c.query_id LIMIT 50"""),
    "eval_ids": with_("splits", "SELECT query_id, split FROM splits WHERE split IN ('calib', 'test')"),
    "cv_folds": with_("pairs", f"""
SELECT query_id, r, ((row_number() OVER (PARTITION BY r ORDER BY md5('42:' || query_id), query_id) - 1) % 5)::INTEGER AS fold
FROM (SELECT query_id, {NEED} AS r FROM pairs)"""),
    "prompts": with_("prompt", """
SELECT query_id, sha256(prompt) AS prompt_sha256, 2 AS n_messages, sha256(prompt) AS user_sha256 FROM prompt"""),
    "grade_results": with_("graded", "SELECT query_id, role, model, parsed_answer, correct FROM graded"),
    "pending": with_("clean graded", """
SELECT c.query_id, t.role FROM clean c, (VALUES ('M_lo'), ('M_hi')) t(role)
WHERE NOT EXISTS (SELECT 1 FROM graded g JOIN embeddings e ON g.query_id = 'documents:' || e.vec_id
  WHERE g.query_id = c.query_id AND g.role = t.role)"""),
    "trace_present": with_("graded", """
SELECT g.role, count(*) AS n, count(e.vec_id) AS n_with_trace
FROM graded g LEFT JOIN embeddings e ON g.query_id = 'documents:' || e.vec_id GROUP BY g.role"""),
    "bundles": with_("graded splits pairs", """
SELECT a.split, a.n_rows, a.n_correct, coalesce(b.n_missing, 0) AS n_missing FROM
  (SELECT split, count(*) AS n_rows, sum(correct)::BIGINT AS n_correct FROM graded JOIN splits USING (query_id) GROUP BY split) a
LEFT JOIN (SELECT split, count(*) AS n_missing FROM splits WHERE query_id NOT IN
  (SELECT query_id FROM pairs WHERE y_lo IS NOT NULL AND y_hi IS NOT NULL) GROUP BY split) b ON a.split = b.split"""),
    "finish_reasons": f"""
SELECT doc_id, CASE WHEN n_chars % 10 = 0 THEN 'unknown' WHEN (doc_id * (n_chars % 10)) % 11 IN {W.EOS_IDS} THEN 'eos'
  WHEN n_chars % 10 >= {W.GENERATED_MAX} THEN 'length' ELSE 'unknown' END AS finish_reason FROM documents""",
    "bucket_counts": with_("pairs", f"SELECT {BUCKET} AS bucket, count(*) AS n FROM pairs GROUP BY 1"),
    "scorecard_overall": with_("pairs", f"SELECT {CARD_COLS} FROM ({card('').replace('__SRC__', 'pairs')})"),
    "scorecard_by_split": with_(
        "pairs_split", f"SELECT split, {CARD_COLS} FROM ({card('split').replace('__SRC__', 'pairs_split')})"
    ),
    "latest_scorecards": with_("latest", """
SELECT dataset, run_id, timestamp, n, acc_gap, opportunity_rate, gate_c_pass, gate_d_pass FROM latest"""),
    "gate_messages": with_("candidates", f"""
SELECT dataset, run_id, concat_ws('; ', 'gate_a: objective_mcq grading', 'gate_b: frozen protocol layers (Phase A defaults)',
  CASE WHEN gate_c_pass THEN 'gate_c: acc_gap=' || {fmt('acc_gap')} || ' >= 0.030 (acc_lo=' || {fmt('acc_lo')} || ', acc_hi=' || {fmt('acc_hi')} || ')' END,
  CASE WHEN gate_d_pass THEN 'gate_d: opportunity_rate=' || {fmt('opportunity_rate')} || ' >= 0.05, too_hard_rate=' || {fmt('too_hard_rate')} || ' < 0.7' END) AS passed,
 concat_ws('; ',
  CASE WHEN NOT gate_c_pass THEN 'gate_c: acc_gap=' || {fmt('acc_gap')} || ' < 0.030 (acc_lo=' || {fmt('acc_lo')} || ', acc_hi=' || {fmt('acc_hi')} || ')' END,
  CASE WHEN NOT gate_d_pass AND opportunity_rate < 0.05 THEN 'gate_d: opportunity_rate=' || {fmt('opportunity_rate')} || ' < 0.05' END,
  CASE WHEN NOT gate_d_pass AND too_hard_rate >= 0.7 THEN 'gate_d: too_hard_rate=' || {fmt('too_hard_rate')} || ' >= 0.7' END) AS failed
FROM candidates"""),
    "winner": with_("latest", f"""
SELECT dataset, run_id, ({PREF})::INTEGER AS preference FROM latest WHERE gate_c_pass AND gate_d_pass
ORDER BY acc_gap DESC, opportunity_rate DESC, 3, dataset LIMIT 1"""),
    "ranked_candidates": with_("candidates", f"""
SELECT dataset, run_id, ({PREF})::INTEGER AS preference, acc_gap, opportunity_rate FROM candidates
WHERE gate_c_pass AND gate_d_pass"""),
    "phi_structural": with_("structural", f"SELECT query_id, {', '.join(r(c, 9, c) for c in TEXT_COLS[:6])} FROM structural"),
    "phi_ambiguity": with_("ambiguity", f"SELECT query_id, {', '.join(r(c, 9, c) for c in TEXT_COLS[6:])} FROM ambiguity"),
    "mattr_documents": with_("doc_mattr", f"""
SELECT d.doc_id, {r('m.mattr', 9, 'mattr')} FROM documents d LEFT JOIN doc_mattr m ON m.doc_id = d.doc_id"""),
    "chat_tokens": with_("prompt", f"""
SELECT query_id, ({n_words('prompt')} + {n_words(lit(SYSTEM_PROMPT))})::INTEGER AS n_tokens FROM prompt"""),
}

_, conv_parsed = parse("text", "10")
ORACLE["parse_answers"] = f"""
SELECT conv_id, turn, md5({_}) AS line_md5, {conv_parsed} AS parsed_answer FROM conversations"""
_, new_parsed = parse("t.text", "len(c.choices)")
cte("fresh", f"""
SELECT query_id, 'M_lo' AS role, 'cheap-2' AS model, parsed_answer, CASE WHEN parsed_answer = answer_index THEN 1 ELSE 0 END AS correct
FROM (SELECT c.query_id, c.answer_index, {new_parsed} AS parsed_answer
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'assistant') t
  JOIN clean c ON c.query_id = 'documents:' || t.conv_id WHERE t.rn = 1)""", "clean")
ORACLE["upsert_results"] = with_("graded fresh", """
SELECT query_id, role, model, parsed_answer, correct FROM graded
WHERE (query_id, role) NOT IN (SELECT query_id, role FROM fresh)
UNION ALL SELECT query_id, role, model, parsed_answer, correct FROM fresh""")

quota = f"""
SELECT lang AS stratum, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= {W.SUBSAMPLE} - sum(base) OVER () THEN 1 ELSE 0 END AS quota
FROM (SELECT lang, n, ({W.SUBSAMPLE} * n) // total AS base, ({W.SUBSAMPLE} * n) % total AS rest
  FROM (SELECT lang, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM clean GROUP BY lang))"""
cte("quotas", quota, "clean")
ORACLE["stratum_quotas"] = with_("quotas", "SELECT stratum, n, quota::BIGINT AS quota FROM quotas")
ORACLE["stratified_subsample"] = with_("clean quotas", """
SELECT query_id, lang AS stratum FROM (SELECT query_id, lang,
  row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || query_id), query_id) AS rn FROM clean) c
JOIN quotas q ON q.stratum = c.lang WHERE rn <= quota""")

cte("corpora", "SELECT query_id, 'documents' AS dataset FROM clean UNION ALL SELECT query_id, 'benchmark' FROM clean2", "clean", "clean2")
split_cte("corpora_splits", "corpora", "corpora")
ORACLE["corpus_index"] = with_("corpora corpora_splits", """
SELECT dataset, count(*) AS n_queries, count(*) FILTER (split = 'calib') AS n_calib, count(*) FILTER (split = 'test') AS n_test
FROM corpora JOIN corpora_splits USING (query_id) GROUP BY dataset""")


def psi_sql(source: str, role: str) -> str:
    return with_(source, f"SELECT query_id, {', '.join(r(c, 6, c) for c in PSI)}, parsed_answer FROM {source} WHERE role = '{role}'")


ORACLE["psi_lo"], ORACLE["psi_hi"] = psi_sql("psi", "M_lo"), psi_sql("psi", "M_hi")
ORACLE["psi_tempered"] = psi_sql("psi2", "M_lo")
ORACLE["chi"] = with_("chi", f"SELECT query_id, {', '.join(r(c, 6, c) for c in CHI_[:-1])}, {CHI_[-1]} FROM chi")
ORACLE["option_candidates"] = with_("scores", f"""
SELECT query_id, string_agg(chr(CAST(64 + i AS INTEGER)), '' ORDER BY x DESC, i) AS ranking, 8 AS option_count,
  {r('max(x)', 6, 'best')}, {r('min(x)', 6, 'worst')}
FROM (SELECT query_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM scores WHERE role = 'M_lo') GROUP BY query_id""")
ORACLE["raw_view"] = with_("clean", """
SELECT v.query_id, md5(c.text) AS question_md5, chr(65 + c.answer_index) AS answer
FROM (SELECT 'documents:' || vec_id AS query_id FROM embeddings) v LEFT JOIN clean c ON c.query_id = v.query_id""")
ORACLE["generation_steps"] = f"""
SELECT vec_id, step::INTEGER AS step, {r('l[(vec_id + step) % 8 + 1] - lz', 6, 'logprob')},
  array_to_string(list_transform(list_sort(list_transform(l, lambda x, i: {{'neg': lz - x, 'i': i - 1}}))[1:3], lambda e: e.i::VARCHAR), ',') AS top_ids,
  {r('list_max(l) - lz', 6, 'top_logprob')}
FROM (SELECT vec_id, step, l, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) AS lz
  FROM (SELECT vec_id, step, list_transform(embedding[step * 8 + 1 : step * 8 + 8], lambda x: x::DOUBLE * {W.SCORE_SPREAD}) AS l
    FROM embeddings, range(0, 8) t(step)))"""
ORACLE["zscore_fit"] = with_("phi_text", " UNION ALL ".join(
    f"SELECT {lit(c)} AS feature, {r(f'avg({c})', 6, 'mean')}, {r(f'stddev_pop({c})', 6, 'std')} FROM phi_text WHERE split = 'calib'"
    for c in TEXT_COLS
))
ORACLE["phi_zscore"] = with_("phi_text_z", f"SELECT query_id, {', '.join(r(c, 5, c) for c in TEXT_COLS)} FROM phi_text_z")
ORACLE["geometry_density"] = with_("geometry", f"SELECT query_id, {', '.join(r(c, 5, c) for c in GEO_COLS)} FROM geometry")

ORACLE["geometry_axes"] = with_("axes", f"SELECT query_id, {', '.join(r(c, 5, c) for c in ('pc1', 'pc2', 'pc3'))} FROM axes")


def knn_sql(distance: str, k: int, others: bool) -> str:
    drop = "WHERE a.query_id <> b.query_id" if others else ""
    return with_("vec", f"""
SELECT query_id, base_id, {r('d', 6, 'distance')}, rn::INTEGER AS rank FROM (
  SELECT query_id, base_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, base_id) AS rn
  FROM (SELECT a.query_id, b.query_id AS base_id, {distance} AS d FROM vec a, vec b {drop})) WHERE rn <= {k}""")


ORACLE["knn_euclidean"] = knn_sql("list_distance(a.v, b.v)", 6, False)
ORACLE["knn_cosine_others"] = knn_sql("1 - list_cosine_similarity(a.v, b.v)", 5, True)
ORACLE["knn_recall"] = "SELECT k::INTEGER AS k, count(*) AS n, true AS nine_in_ten FROM embeddings, (VALUES (1), (5), (10)) t(k) GROUP BY k"
for part in ("calib", "test"):
    ORACLE[f"analysis_{part}"] = with_(
        "analysis", f"SELECT {LABELS}, {', '.join(r(c, 5, c) for c in ALL_COLS)} FROM analysis WHERE split = '{part}'"
    )
ORACLE["analysis_meta"] = with_("light", f"SELECT split, count(*) AS n_queries, {r('avg(r)', 6, 'positive_rate')} FROM light GROUP BY split")
ORACLE["univariates"] = with_("a_uni", uni_select("a", 5, True))
ORACLE["univariates_lineitem"] = with_("li_uni", uni_select("li", 6, False))
ORACLE["family_summary"] = with_("a_uni", f"""
SELECT target, family, block, n_features, {', '.join(r(c, 5, c) for c in (
    'mean_auroc', 'std_auroc', 'min_auroc', 'max_auroc', 'q25_auroc', 'median_auroc', 'q75_auroc'))},
  {r('q75_auroc - q25_auroc', 5, 'iqr_auroc')}
FROM (SELECT u.target, m.family, m.block, count(*) AS n_features, avg(auroc) AS mean_auroc, stddev_pop(auroc) AS std_auroc,
  min(auroc) AS min_auroc, max(auroc) AS max_auroc, quantile_cont(auroc, 0.25) AS q25_auroc, median(auroc) AS median_auroc,
  quantile_cont(auroc, 0.75) AS q75_auroc
  FROM a_uni u JOIN (VALUES {members}) m(family, block, feature) ON m.feature = u.feature
  WHERE auroc IS NOT NULL GROUP BY u.target, m.family, m.block)""")
ORACLE["psi_variance"] = with_("light", " UNION ALL ".join(
    f"SELECT {lit(dotted(c))} AS feature, count({c}) AS n, {r(f'var_pop({c})', 6, 'variance')}, {r(f'stddev_pop({c})', 6, 'std')}, "
    f"{r(f'min({c})', 6, 'min')}, {r(f'max({c})', 6, 'max')}, 'psi' AS family FROM light WHERE split = 'calib'"
    for c in PSI_
))
ORACLE["decisions"] = with_("routed", f"""
SELECT 'documents:' || d.doc_id AS query_id, {r('score', 6, 'score')}, use_strong, model,
  CASE WHEN score IS NULL THEN {MISSING} END AS skip_reason
FROM documents d LEFT JOIN routed r ON r.query_id = 'documents:' || d.doc_id""")
SWEEP = f"step, {r('tau', 6, 'tau')}, {r('accuracy', 6, 'accuracy')}"
ORACLE["threshold_sweep"] = with_("sweep", f"SELECT {SWEEP} FROM sweep")
ORACLE["threshold_best"] = with_("sweep", f"""
SELECT {SWEEP} FROM (SELECT * FROM sweep ORDER BY round(sweep.accuracy, 12) DESC, sweep.tau LIMIT 1)""")
ORACLE["policy_agreement"] = with_("light routed", f"""
SELECT count(*) AS n, {r('avg(CASE WHEN d.use_strong::INTEGER = l.r THEN 1.0 ELSE 0.0 END)', 6, 'accuracy')}, {pol.threshold}::DOUBLE AS threshold
FROM light l JOIN routed d ON d.query_id = l.query_id""")
ORACLE["evaluate_policies"] = with_("report", "SELECT * FROM report")
ORACLE["cost_points"] = with_("report", """
SELECT 'always_M_lo' AS name, acc_always_lo AS accuracy, cost_always_lo AS cost FROM report
UNION ALL SELECT 'always_M_hi', acc_always_hi, cost_always_hi FROM report
UNION ALL SELECT 'policy_pi', acc_policy, cost_policy FROM report
UNION ALL SELECT 'oracle_pi_star', acc_oracle, cost_oracle FROM report""")
ORACLE["skip_counts"] = with_("decided", "SELECT skip_reason, count(*) AS n FROM decided WHERE skip_reason IS NOT NULL GROUP BY 1")
ORACLE["first_skipped"] = with_("decided", """
SELECT query_id, skip_reason FROM decided WHERE skip_reason IS NOT NULL ORDER BY query_id LIMIT 20""")
ORACLE["decide_stream"] = with_("arrived", f"SELECT event_id, query_id, {r('score', 6, 'score')}, use_strong, model, skip_reason FROM arrived")
ORACLE["hi_rate_windows"] = with_("arrived", f"""
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(h + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
  n, n_hi, {r('n_hi::DOUBLE / n', 6, 'hi_rate')}, {r(f'n_hi * {W.KAPPA}::DOUBLE', 6, 'cost')}
FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n, count(*) FILTER (use_strong) AS n_hi
      FROM arrived WHERE skip_reason IS NULL GROUP BY 1)""")
ORACLE["stream_latest"] = """
SELECT 'documents:' || user_id AS query_id, event_type AS role, event_id AS version, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"""
ORACLE["csv_round_trip"] = with_("light", f"SELECT {LABELS}, {', '.join(r(c, 6, c) for c in PSI_ + CHI_)} FROM light")
ORACLE["signal_round_trip"] = with_("psi", f"""
SELECT query_id, 'model_response' AS signal_type, {', '.join(r(c, 6, c) for c in PSI)}, parsed_answer, 'v4' AS metrics_version
FROM psi WHERE role = 'M_lo'""")
ORACLE["legacy_signals"] = f"""
SELECT 'documents:' || doc_id AS query_id, 'model_independent' AS signal_type, {r('doc_id / 8', 6, 'entropy')},
  quality = 1 AS prediction_disagreement, 'B' AS parsed_answer, {r('doc_id / 16', 6, 'confidence')},
  toxic::VARCHAR AS disagreement, false AS kept_result_field FROM labels"""
ORACLE["policy_round_trip"] = with_("routed", "SELECT model, count(*) AS n FROM routed GROUP BY model")


def newton_sql(fits: str, rows: str) -> str:
    """Newton steps of two-feature fits from ``fits (f)`` and ``rows (f, y, z1, z2, wt)``, with the 3 x 3 system written out."""
    def det(m: list[str]) -> str:
        a, b, c, d, e, f, g, h, i = m
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    m = ["h11", "h12", "h13", "h12", "h22", "h23", "h13", "h23", "h33"]
    solved = [det([("g1", "g2", "g3")[i // 3] if i % 3 == k else x for i, x in enumerate(m)]) for k in range(3)]
    slope = "wt * p * (1 - p)"
    return f"""
newton AS (
  SELECT f, 0 AS it, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS b FROM {fits}
  UNION ALL
  SELECT f, it + 1, w1 - {solved[0]} / {det(m)}, w2 - {solved[1]} / {det(m)}, b - {solved[2]} / {det(m)}
  FROM (
    SELECT f, it, w1, w2, b, sum(wt * (p - y) * z1) + w1 AS g1, sum(wt * (p - y) * z2) + w2 AS g2, sum(wt * (p - y)) AS g3,
      sum({slope} * z1 * z1) + 1 AS h11, sum({slope} * z1 * z2) AS h12, sum({slope} * z1) AS h13, sum({slope} * z2 * z2) + 1 AS h22,
      sum({slope} * z2) AS h23, sum({slope}) AS h33
    FROM (SELECT n.*, t.y, t.z1, t.z2, t.wt, 1 / (1 + exp(-(w1 * z1 + w2 * z2 + b))) AS p
          FROM newton n JOIN {rows} t ON t.f = n.f WHERE it < 25)
    GROUP BY f, it, w1, w2, b)),
weights AS (SELECT * FROM newton WHERE it = 25)"""


TWO_ROWS = "SELECT query_id, r AS y, psi__entropy AS a, psi__margin AS b FROM light WHERE split = 'calib' AND psi__entropy IS NOT NULL AND psi__margin IS NOT NULL"
SCALED = """
  SELECT f, any_value(n) AS n, any_value(p) AS p, any_value(ma) AS ma, any_value(mb) AS mb, any_value(sa) AS sa, any_value(sb) AS sb
  FROM (SELECT f, count(*) OVER x AS n, sum(y) OVER x AS p, avg(a) OVER x AS ma, avg(b) OVER x AS mb,
    stddev_pop(a) OVER x AS sa, stddev_pop(b) OVER x AS sb FROM trained WINDOW x AS (PARTITION BY f)) GROUP BY f"""
Z = """
  SELECT f, y, (a - ma) / sa AS z1, (b - mb) / sb AS z2, CASE WHEN y = 1 THEN n / (2.0 * p) ELSE n / (2.0 * (n - p)) END AS wt
  FROM trained JOIN scaled USING (f)"""
ORACLE["linear_probe_two"] = with_("light", f"""
SELECT * FROM (WITH RECURSIVE given AS ({TWO_ROWS}),
folds_ AS (SELECT least(5, sum(r), count(*) - sum(r))::BIGINT AS k FROM light WHERE split = 'calib'),
dealt AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('42:' || query_id), query_id) - 1) % k AS fold, k FROM given, folds_),
trained AS (SELECT f, d.* FROM dealt d, (SELECT unnest(range(k)) AS f FROM folds_) WHERE fold <> f),
scaled AS ({SCALED}),
z AS ({Z}),
{newton_sql('scaled', 'z')},
probs AS (SELECT w.f, d.y, 1 / (1 + exp(-(w1 * (d.a - ma) / sa + w2 * (d.b - mb) / sb + w.b))) AS v
  FROM dealt d JOIN weights w ON w.f = d.fold JOIN scaled s ON s.f = w.f),
val AS (SELECT f, v, count(*) AS c, sum(y) AS p FROM probs GROUP BY f, v),
ranked AS (SELECT *, sum(c) OVER up - c + (c + 1) / 2.0 AS rk, sum(p) OVER down AS tp, sum(c) OVER down AS seen
  FROM val WINDOW up AS (PARTITION BY f ORDER BY v), down AS (PARTITION BY f ORDER BY v DESC)),
scored AS (SELECT f, (sum(p * rk) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(c) - sum(p))) AS auroc,
    sum(p * tp / seen) / sum(p) AS ap FROM ranked GROUP BY f HAVING sum(p) > 0 AND sum(p) < sum(c))
SELECT 'psi' AS family, 'two' AS block, 2 AS n_features, k::INTEGER AS cv_folds, {r('avg(auroc)', 5, 'cv_auroc_mean')},
  {r('stddev_pop(auroc)', 5, 'cv_auroc_std')}, {r('avg(ap)', 5, 'cv_auprc_mean')}, {r('stddev_pop(ap)', 5, 'cv_auprc_std')}
FROM scored, folds_ GROUP BY k)""")
ORACLE["policy_fit_two"] = with_("light", f"""
SELECT * FROM (WITH RECURSIVE given AS ({TWO_ROWS}),
trained AS (SELECT 0 AS f, * FROM given),
scaled AS ({SCALED}),
z AS ({Z}),
{newton_sql('scaled', 'z')},
scores_ AS (SELECT y, 1 / (1 + exp(-(w1 * z1 + w2 * z2 + b))) AS v FROM z, weights),
tried AS (SELECT t / 100.0::DOUBLE AS tau, avg(((v > t / 100.0::DOUBLE) = (y = 1))::INT) AS acc FROM scores_, range(1, 100) u(t) GROUP BY t),
best AS (SELECT tau FROM tried ORDER BY acc DESC, tau LIMIT 1)
SELECT feature, {r('mean', 5, 'mean')}, {r('scale', 5, 'scale')}, {r('weight', 5, 'weight')}, {r('intercept', 5, 'intercept')},
  tau AS threshold, true AS settled
FROM (SELECT unnest(['psi.entropy', 'psi.margin']) AS feature, unnest([ma, mb]) AS mean, unnest([sa, sb]) AS scale,
  unnest([w1, w2]) AS weight, b AS intercept FROM scaled, weights), best)""")
