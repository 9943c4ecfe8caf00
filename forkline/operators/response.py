"""Confidence signals of one model from its stored option scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.functions.exprs import array_sum, let, letter
from forkline.functions.scores import confidence, option_scores, ranking, unpack, valid_trace
from forkline.functions.text import strip
from forkline.schemas import PSI, STEP_TOP_K
from forkline.sources.broken import Parted, part

Extractor = Callable[..., DataFrame]


def mcq_letter(results: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Confidence metrics of rows whose trace scores option letters."""
    trace = F.col("model_response.trace")
    scored = results.withColumn("_entries", option_scores(trace))
    found = confidence(F.col("_entries"), trace["predicted_letter"], temperature)
    made = scored.withColumns({"_packed": found["packed"], "_raw": found["predicted_logprob"]})
    metrics = unpack(F.col("_packed"), F.col("_raw"))
    return made.withColumns(
        {
            **metrics,
            "trace_valid": valid_trace(F.col("_entries"), trace),
            "prediction": F.struct(
                trace["predicted_letter"].alias("parsed_answer"), metrics["msp"].alias("confidence")
            ),
        }
    ).drop("_entries", "_packed", "_raw")


# Protocol names and older spellings.
EXTRACTORS: dict[str, Extractor] = {"mcq_letter": mcq_letter}
PROTOCOL_ALIASES = {"mcq_letter_v1": "mcq_letter"}


def register_protocol(name: str, extractor: Extractor) -> None:
    EXTRACTORS[name] = extractor


def unregister_protocol(name: str) -> None:
    EXTRACTORS.pop(name, None)


def known_protocols() -> tuple[str, ...]:
    return tuple(EXTRACTORS) + tuple(PROTOCOL_ALIASES)


def named_protocols(results: DataFrame) -> DataFrame:
    """Adds ``_protocol``: today's name of the row's protocol."""
    protocol = F.col("model_response.protocol_version")
    today = F.coalesce(*[F.when(protocol == old, F.lit(new)) for old, new in PROTOCOL_ALIASES.items()], protocol)
    return results.withColumn("_protocol", today)


def _extracted(results: DataFrame, temperature: float) -> DataFrame:
    """Metrics of every row by its protocol, with ``_reason`` for rows that have none to go by."""
    named = named_protocols(results)
    known = F.coalesce(F.col("_protocol").isin(*EXTRACTORS), F.lit(False))
    columns = ("query_id", "role", *PSI, "prediction", "trace_valid")
    out = None
    for i, (name, extract) in enumerate(EXTRACTORS.items()):
        # Rows of no known protocol go with the first, so that one protocol needs one pass without a filter.
        mine = F.col("_protocol") == name if i else ~known | (F.col("_protocol") == name)
        rows = named if len(EXTRACTORS) == 1 else named.filter(mine)
        made = extract(rows, temperature).select(
            *columns, F.when(~known, "unknown protocol").when(~F.coalesce("trace_valid", F.lit(False)), "broken trace").alias("_reason"))
        out = made if out is None else out.unionByName(made)
    return out


def psi(results: DataFrame, temperature: float = 1.0, strict: bool = True) -> DataFrame:
    """``query_id, role``, the ten metrics and the prediction for every result row.

    ``strict`` turns unknown protocols and broken traces into an error, found in one aggregation; otherwise
    ``trace_valid`` tells. See ``psi_parted`` for both in one pass.
    """
    out = _extracted(results, temperature)
    if strict:
        first = out.agg(F.min(F.when(F.col("_reason").isNotNull(), F.struct("query_id", "_reason"))).alias("b")).first()["b"]
        if first:
            raise ValueError(f"{first['_reason']} in {first['query_id']!r}")
    return out.drop("_reason")


def psi_parted(results: DataFrame, temperature: float = 1.0) -> Parted:
    """The signals of the rows that can be read, and the broken rows with their reasons, from one pass."""
    out = _extracted(results, temperature).withColumnRenamed("_reason", "_why")
    scored = F.coalesce(F.col("option_count") > 0, F.lit(False))
    made = part(out, {
        "unknown protocol": F.col("_why") == "unknown protocol",
        "no scores": (F.col("_why") == "broken trace") & ~scored,
        "broken trace": F.col("_why") == "broken trace",
    }, "psi-parted")
    return Parted(made.good.drop("_why"), made.errors.drop("_why"))


def with_raw_view(signals: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds ``raw``: question text and letter of the right answer; NULL where the query is unknown."""
    raw = queries.select(
        "query_id",
        F.struct(strip(F.col("text")).alias("query"), letter(F.col("answer_index")).alias("answer")).alias("raw"),
    )
    return signals.join(raw, "query_id", "left")


def candidates_from_logprobs(n_choices: Column, logprobs: Column) -> Column:
    """First-token scoring: the ``candidates`` struct from a token → log-probability map."""
    from forkline.functions.scores import variant_scores

    return let(
        variant_scores(n_choices, logprobs),
        lambda e: F.struct(
            F.transform(e, lambda x: x["label"]).alias("labels"),
            F.transform(e, lambda x: x["score"]).alias("scores"),
            ranking(e).alias("ranking"),
            F.size(e).alias("option_count"),
        ),
    )


# Scoring back ends by name. "teacher_forced" needs a model run and has no stored form.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"first_token_letter": candidates_from_logprobs}


def score_candidates(method: str, n_choices: Column, logprobs: Column) -> Column:
    if method == "teacher_forced":
        raise NotImplementedError("teacher_forced scoring needs a model")
    return SCORERS[method](n_choices, logprobs)


def packed_steps(logits: Column, token_ids: Column, top_k: int = STEP_TOP_K) -> Column:
    """Per generated step the log-probability of the chosen token and the ``top_k`` best tokens.

    ``logits`` is one array per step; the result is one struct per step.
    """

    def step(row: Column, i: Column) -> Column:
        chosen = F.get(token_ids, i)

        def with_norm(log_z: Column) -> Column:
            ranked = F.array_sort(
                F.transform(row, lambda x, j: F.struct((log_z - x).alias("neg"), j.alias("token_id")))
            )
            best = F.transform(
                F.slice(ranked, 1, top_k),
                lambda e: F.struct(e["token_id"].alias("token_id"), (-e["neg"]).alias("logprob")),
            )
            return F.struct((F.get(row, chosen) - log_z).alias("logprob"), best.alias("top"))

        def norm(peak: Column) -> Column:
            return peak + F.log(array_sum(F.transform(row, lambda x: F.exp(x - peak))))

        return let(let(F.array_max(row), norm), with_norm)

    return F.transform(logits, step)
