"""Text expressions: trimming, word tokens, overlap, lexical density, prompts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from forkline.functions.exprs import array_mean, let, letter

# The characters that count as white space when trimming.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# What a word is (letters, digits, underscore; apostrophes only inside).
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
MATTR_TOKENS = 1 << 18  # tokens taken at once, or those of one text
# The prompt.
SYSTEM_PROMPT = """\
You answer multiple-choice questions.

Rules:
- Read the question and all options carefully.
- Reply with exactly one line containing only the letter label of the correct option (A, B, C, …).
- Do not include explanation, punctuation, or any other text.
"""
USER_TEMPLATE = "{question}\n\n{choices}\n\nAnswer:\n"


def strip(text: Column) -> Column:
    """Trim all Unicode white space at both ends, in linear time."""
    return F.trim(text, F.lit(WHITE_SPACE))


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def word_count(text: Column) -> Column:
    """Default token counter; a caller may pass any ``Column → Column`` instead."""
    return F.regexp_count(text, F.lit(WORD))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two duplicate-free arrays; two empty ones are equal."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        common / (F.size(a) + F.size(b) - common)
    )


def mattr(tokens: Column, window: int) -> Column:
    """Moving-average type–token ratio of a column of token arrays, without a shuffle.

    Each token counts in exactly those windows that contain it but not its
    previous occurrence. Array operations over the tokens of many texts find that
    occurrence, so the work is n log n and stays in the batch; a Python column, it
    cannot stand in a lambda. Empty input gives NULL; a text shorter than the
    window gives its plain ratio.
    """
    most, w = MATTR_TOKENS, window

    @F.arrow_udf("double")
    def ratio(batch: pa.Array) -> pa.Array:
        n = pc.list_value_length(batch).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(n))
        share = np.cumsum(n) // most
        for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(share)) + 1):
            size = n[part]
            if not size.any():
                continue
            code = batch.slice(part[0], len(part)).flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(part)), size)
            place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            key = row * (code.max() + 1) + code
            order = np.argsort(key, kind="stable")
            again = np.flatnonzero(np.diff(key[order]) == 0)
            before = np.full(len(key), -1)
            before[order[again + 1]] = place[order[again]]
            first = np.maximum(np.maximum(place - w + 1, before + 1), 0)
            held_by = np.maximum(np.minimum(place, size[row] - w) - first + 1, 0)
            total = np.bincount(row, held_by, len(part))
            different = np.bincount(row, before < 0, len(part))
            out[part] = np.where(size < w, different / np.maximum(size, 1), total / w / np.maximum(size - w + 1, 1))
        return pa.array(out, pa.float64(), mask=n == 0)

    return ratio(tokens)


def compression_ratio(text: Column, level: int) -> Column:
    """Deflated size over plain size; NULL for empty text.

    There is no deflate expression in Spark, so batches go through Arrow. Texts
    are deflated where they lie in the batch; none becomes a Python string.
    """

    @F.arrow_udf("double")
    def ratio(batch: pa.Array) -> pa.Array:
        def one(raw):
            return len(zlib.compress(raw, level)) / len(raw) if raw is not None and len(raw) else None

        return pa.array((one(s.as_buffer()) for s in batch), pa.float64())

    return F.when(F.octet_length(text) > 0, ratio(text))


def question_text(text: Column, subject: Column) -> Column:
    body = strip(text)
    return F.when(subject.isNotNull() & (subject != ""), F.concat(F.lit("Subject: "), subject, F.lit("\n\n"), body)).otherwise(body)


def choice_lines(choices: Column) -> Column:
    return F.array_join(F.transform(choices, lambda c, i: F.concat(letter(i), F.lit(". "), strip(c))), "\n")


def user_message(question: Column, choices: Column, template: str = USER_TEMPLATE) -> Column:
    """Fill the ``{question}`` and ``{choices}`` slots of a prompt template."""
    parts: list[Column] = []
    for piece in template.replace("{question}", "\0q\0").replace("{choices}", "\0c\0").split("\0"):
        if piece:
            parts.append({"q": question, "c": choices}.get(piece, F.lit(piece)))
    return F.concat(*parts)


def prompt_words(subject: Column, text_words: Column, choice_words: Column, template: str = USER_TEMPLATE) -> Column:
    """Words of the prompt from those of its text and options, which it puts apart by signs that are in no word."""
    head = F.when(subject.isNotNull() & (subject != ""), words(F.concat(F.lit("Subject: "), subject))).otherwise(no_words())
    line = lambda c, i: F.coalesce(F.concat(words(letter(i)), c), no_words())  # a missing option has no line
    slots = {"q": F.concat(head, text_words), "c": F.flatten(F.transform(choice_words, line))}
    pieces = template.replace("{question}", "\0q\0").replace("{choices}", "\0c\0").split("\0")
    return F.concat(*[slots.get(piece, words(F.lit(piece))) for piece in pieces if piece])


def no_words() -> Column:
    return F.array().cast("array<string>")


def chat_messages(user: Column, system_prompt: str = SYSTEM_PROMPT) -> Column:
    def one(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(one("system", F.lit(system_prompt)), one("user", user))


def chat_token_count(messages: Column, counter=word_count) -> Column:
    return F.aggregate(messages, F.lit(0), lambda acc, m: acc + counter(m["content"]))


def pair_means(sets: Column) -> Column:
    """Mean Jaccard over all unordered pairs of a short list of word sets; 0 if there is no pair."""

    def of(s: Column) -> Column:
        n = F.size(s)
        pairs = F.flatten(
            F.transform(
                F.sequence(F.lit(0), n - 2),
                lambda i: F.transform(
                    F.sequence(i + 1, n - 1), lambda j: set_jaccard(F.get(s, i), F.get(s, j))
                ),
            )
        )
        return F.when(n < 2, F.lit(0.0)).otherwise(array_mean(pairs))

    return let(sets, of)
