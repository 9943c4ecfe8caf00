"""Expressions over one model's option scores (arrays of at most a few dozen entries)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forkline.functions.exprs import array_sum, let, letters

# Fixed value: ratio reported when the second probability vanishes.
RATIO_CAP, RATIO_FLOOR = 1e6, 1e-12
ENTRY = "array<struct<label:string,score:double>>"


def variant_scores(n_choices: Column, logprobs: Column) -> Column:
    """Best log-probability over the four spellings of each option letter; -inf if none is present."""

    def best(label: Column) -> Column:
        low = F.lower(label)
        spellings = F.array(F.concat(F.lit(" "), label), label, F.concat(F.lit(" "), low), low)
        found = F.transform(spellings, lambda s: F.try_element_at(logprobs, s))
        return F.coalesce(F.array_max(found), F.lit(float("-inf")))

    return F.transform(
        letters(n_choices), lambda x: F.struct(x.alias("label"), best(x).cast("double").alias("score"))
    )


def option_scores(trace: Column) -> Column:
    """Scores per option, sorted by label, from whichever form the trace holds.

    Order of preference: candidate list, per-option log-probabilities, then
    first-token log-probabilities by letter spelling.
    """
    cand = trace["candidates"]
    listed = F.zip_with(
        cand["labels"], cand["scores"], lambda a, b: F.struct(a.alias("label"), b.cast("double").alias("score"))
    )
    usable = cand["labels"].isNotNull() & (F.size(cand["labels"]) == F.size(cand["scores"]))
    by_option = F.transform(
        F.map_entries(trace["choice_logprobs"]),
        lambda e: F.struct(e["key"].alias("label"), e["value"].alias("score")),
    )
    by_spelling = F.when(
        F.size(trace["candidate_token_logprobs"]) > 0,
        variant_scores(trace["n_choices"], trace["candidate_token_logprobs"]),
    )
    return F.array_sort(
        F.coalesce(F.when(usable, listed).cast(ENTRY), by_option.cast(ENTRY), by_spelling.cast(ENTRY))
    )


def ranking(entries: Column) -> Column:
    """Labels by score, best first; ties keep their order."""
    keyed = F.transform(
        entries, lambda e, i: F.struct((-e["score"]).alias("s"), i.alias("i"), e["label"].alias("label"))
    )
    return F.transform(F.array_sort(keyed), lambda e: e["label"])


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    def of(s: Column) -> Column:
        peak = F.array_max(s)
        exps = F.transform(s, lambda x: F.exp(x - peak))
        return let(exps, lambda e: let(array_sum(e), lambda total: F.transform(e, lambda x: x / total)))

    scaled = scores if temperature == 1.0 else F.transform(scores, lambda x: x * F.lit(1.0 / temperature))
    return let(scaled, of)


def entropy(probs: Column) -> Column:
    return -array_sum(F.transform(probs, lambda p: F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))))


def valid_trace(entries: Column, trace: Column) -> Column:
    """As many scores as options, and the predicted letter is one of them."""
    return F.coalesce(
        (F.size(entries) == trace["n_choices"])
        & F.array_contains(F.transform(entries, lambda e: e["label"]), trace["predicted_letter"]),
        F.lit(False),
    )


def has_trace(trace: Column, protocol: Column, known: tuple[str, ...]) -> Column:
    generation = trace["generation"]
    present = (
        (F.size(trace["candidates"]["scores"]) > 0)
        | (F.size(trace["candidate_token_logprobs"]) > 0)
        | (F.size(trace["choice_logprobs"]) > 0)
        | ((F.size(generation["generated_token_ids"]) > 0) & (F.size(generation["generated_token_logprobs"]) > 0))
    )
    return F.coalesce(protocol.isin(*known), F.lit(False)) & F.coalesce(present, F.lit(False))


def confidence(entries: Column, predicted: Column, temperature: float = 1.0) -> dict[str, Column]:
    """The ten confidence metrics; all NULL when no option could be scored."""
    scores = F.transform(entries, lambda e: e["score"])
    peak = F.array_max(scores)
    usable = peak.isNotNull() & ~F.isnan(peak) & (F.abs(peak) != float("inf"))
    packed = F.when(
        usable,
        let(
            softmax(scores, temperature),
            lambda p: let(
                F.sort_array(p, asc=False),
                lambda d: F.struct(
                    entropy(p).alias("h"),
                    F.get(d, F.lit(0)).alias("p1"),
                    F.coalesce(F.get(d, F.lit(1)), F.lit(0.0)).alias("p2"),
                    F.size(p).alias("n"),
                ),
            ),
        ),
    )
    hit = F.filter(entries, lambda e: e["label"] == predicted)
    raw = F.when(usable, F.get(hit, F.lit(0))["score"])
    return {"packed": packed, "predicted_logprob": raw}


def unpack(packed: Column, raw: Column) -> dict[str, Column]:
    h, p1, p2, n = packed["h"], packed["p1"], packed["p2"], packed["n"].cast("double")
    gap = p1 - p2
    return {
        "effective_support": F.exp(h),
        "entropy": h,
        "margin": gap,
        "mean_logprob": raw,
        "msp": p1,
        "normalized_entropy": F.when(n > 1, h / F.log(n)).when(n == 1, F.lit(0.0)),
        "option_count": n,
        "predicted_logprob": raw,
        "top2_gap": gap,
        "top_probability_ratio": F.when(p2 > RATIO_FLOOR, p1 / p2).when(p1.isNotNull(), F.lit(RATIO_CAP)),
    }
