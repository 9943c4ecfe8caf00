"""Expressions over stored model output: answer letter, grade, finish reason."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from forkline.functions.exprs import let
from forkline.functions.text import strip

# Line ends, and the first ASCII letter that stands alone.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\x{2028}\x{2029}]"
LONE_LETTER = r"(?:^|[^\p{L}\p{N}_])([A-Za-z])(?:[^\p{L}\p{N}_]|$)"


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; '' when there is none.

    After trimming the whole text its first line cannot be blank.
    """
    return strip(F.get(F.split(strip(text), LINE_END, 2), F.lit(0)))


def parsed_answer(text: Column, n_choices: Column) -> Column:
    """Option index named by the first stand-alone letter; NULL if none or out of range."""

    def of(found: Column) -> Column:
        index = F.ascii(F.upper(found)) - 65
        return F.when((found != "") & (index < n_choices), index)

    return let(F.regexp_extract(first_line(text), LONE_LETTER, 1), of)


def is_correct(parsed: Column, answer_index: Column) -> Column:
    return F.coalesce((parsed == answer_index).cast("int"), F.lit(0))


def finish_reason(token_ids: Column, eos_ids: Iterable[int], max_new_tokens: int) -> Column:
    last = F.try_element_at(token_ids, F.lit(-1))
    return (
        F.when(F.coalesce(F.size(token_ids), F.lit(0)) <= 0, "unknown")
        .when(last.isin(*eos_ids), "eos")
        .when(F.size(token_ids) >= max_new_tokens, "length")
        .otherwise("unknown")
    )


def prompt_digest(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def routing_need(y_lo: Column, y_hi: Column) -> Column:
    """1 where only the strong model is right."""
    return ((y_lo == 0) & (y_hi == 1)).cast("int")


def bucket(y_lo: Column, y_hi: Column) -> Column:
    return (
        F.when((y_lo != 0) & (y_hi != 0), "easy")
        .when((y_lo == 0) & (y_hi != 0), "opportunity")
        .when((y_lo != 0) & (y_hi == 0), "lo_only")
        .otherwise("too_hard")
    )
