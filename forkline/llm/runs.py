"""Runs of repeated word sequences (maximal periodicities) by an enhanced suffix array.

The words of a batch of texts are numbered and sorted as suffixes by prefix doubling; a word's number counts together
with its text, so suffixes of different texts share nothing. The LCP array gives the intervals of suffixes that share
exactly ``depth`` words, as pairs of next smaller values, without a tree. Two suffixes of different children of an
interval that stand ``depth`` apart are a branching tandem repeat, a square that its last word's successor ends; for
each interval only the suffixes of its smaller children look for a partner, by the inverse suffix array at ``i + depth``
and ``i - depth``. Each run holds exactly one such square of its period: the square is rotated to the left as far as
the words agree, and squares of multiples of a period, which give the same stretch, are merged into it.

Everything is numpy over the batch; a text is never split over tasks, and a task holds one batch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from forkline.llm.arrow import add_columns
from forkline.llm.shingles import mix

SHORTEST = 12  # words of a run
BATCH_WORDS = 200_000  # words sorted together; one longer text is a batch of its own

RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]), False)


def repeats_a_window(words: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Whether each text has two equal windows of ``width`` words. ``words`` and ``text`` are numbers per word; the
    texts are 0, 1, ... in order. Without such windows a text has no run of ``2 * width`` words."""
    n = len(words) - width + 1
    out = np.zeros(int(text[-1]) + 1 if len(text) else 0, bool)
    if n < 2:
        return out
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total = mix(total + words[k : n + k].astype(np.uint64))
    inside = np.flatnonzero(text[:n] == text[width - 1 :])
    by = inside[np.lexsort((total[inside], text[inside]))]
    same = (total[by][1:] == total[by][:-1]) & (text[by][1:] == text[by][:-1])
    out[text[by][1:][same]] = True
    return out


def _suffixes(words: np.ndarray, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for k = 0, 1, ... the rank of each by its first 2^k words."""
    n = len(words)
    key = text * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    slots = np.arange(n)

    def ranked(rank: np.ndarray, at: np.ndarray, suffixes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Gives suffixes of slots ``at``, sorted by ``keys``, the first slot of their group; returns slots not settled."""
        new = np.r_[True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1)]
        first = np.flatnonzero(new)
        rank[suffixes] = np.repeat(at[first], np.diff(np.r_[first, len(at)]))
        alone = new & np.r_[new[1:], True]
        return at[~alone]

    rank = np.empty(n, np.int64)
    open_slots = ranked(rank, slots, order, key[order])
    ranks, width = [rank.copy()], 1
    while len(open_slots):
        suffixes = order[open_slots]
        ahead = suffixes + width
        second = np.where(ahead < end[suffixes], rank[np.minimum(ahead, n - 1)] + 1, 0)
        keys = rank[suffixes] * (n + 1) + second
        by = np.argsort(keys, kind="stable")
        order[open_slots] = suffixes[by]
        open_slots = ranked(rank, open_slots, suffixes[by], keys[by])
        ranks.append(rank.copy())
        width *= 2
    return order, ranks


def _shared(ranks: list[np.ndarray], x: np.ndarray, y: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes at x and y of one text have in common."""
    got, to_x, to_y = np.zeros(len(x), np.int64), end[x], end[y]
    for k in range(len(ranks) - 1, -1, -1):
        a, b = x + got, y + got
        fits = (a < to_x) & (b < to_y)
        got += np.where(fits & (ranks[k][np.where(fits, a, 0)] == ranks[k][np.where(fits, b, 0)]), 1 << k, 0)
    return got


def _smaller(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Nearest place before (step -1) or after (1) each place ``at`` whose value is smaller; the ends of lcp are -1."""
    to = np.arange(len(lcp)) + step
    open_places = at
    while len(open_places):
        open_places = open_places[lcp[to[open_places]] >= lcp[open_places]]
        to[open_places] = to[to[open_places]]
    return to[at]


def branching_squares(order: np.ndarray, lcp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of each square whose period cannot be read on after it."""
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    at = np.flatnonzero(lcp[:n] > 0)
    low, high = _smaller(lcp, at, -1), _smaller(lcp, at, 1) - 1  # slots of the interval that the place belongs to
    by = np.lexsort((at, high, low))
    at, low, high = at[by], low[by], high[by]
    depth = lcp[at]
    new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])] if len(at) else np.zeros(0, bool)
    last = np.r_[new[1:], True] if len(at) else new
    # Children: one from the interval's start to the first place, one from each place to the next or the end.
    child_from = np.r_[low[new], at]
    child_to = np.r_[at[new] - 1, np.where(last, high, np.r_[at[1:], 0] - 1)]
    interval = np.r_[np.flatnonzero(new), np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    size = child_to - child_from + 1
    by = np.lexsort((size, interval))
    largest = np.r_[interval[by][1:] != interval[by][:-1], True] if len(by) else np.zeros(0, bool)
    small = by[~largest]
    length = size[small]
    which = np.repeat(small, length)
    slot = np.repeat(child_from[small] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
    suffix, d = order[slot], depth[interval[which]]
    lo, hi, own_lo, own_hi = low[interval[which]], high[interval[which]], child_from[which], child_to[which]
    starts, periods = [], []
    for partner, start, fits in (
        (suffix + d, suffix, suffix + d < end[suffix]), (suffix - d, suffix - d, suffix - d >= begin[suffix])
    ):
        r = inverse[np.where(fits, partner, 0)]
        hit = fits & (r >= lo) & (r <= hi) & ((r < own_lo) | (r > own_hi))
        starts.append(start[hit])
        periods.append(d[hit])
    found = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)], axis=1), axis=0)
    return found[:, 0], found[:, 1]


def _all_runs(words: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, in words of the batch, by start and period."""
    order, ranks = _suffixes(words, text, end)
    n = len(words)
    lcp = np.zeros(n + 1, np.int64)
    lcp[[0, n]] = -1
    near = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    lcp[near] = _shared(ranks, order[near - 1], order[near], end)
    start, period = branching_squares(order, lcp, begin, end)
    stop, left, first = start + 2 * period, np.zeros(len(start), np.int64), begin[start]
    for k in range(len(ranks) - 1, -1, -1):  # rotations, by blocks of 2^k words
        a = start - left - (1 << k)
        fits = a >= first
        a = np.where(fits, a, start)
        left += np.where(fits & (ranks[k][a] == ranks[k][a + period]), 1 << k, 0)
    rows = np.stack([start - left, stop, period], axis=1)
    rows = rows[np.lexsort(rows.T[::-1])]
    once = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)] if len(rows) else np.zeros(0, bool)
    rows = rows[once]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """For each list of words its runs of ``shortest`` words or more as rows (start, length, period)."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    number = defaultdict(count().__next__)
    held = [i for i, words in enumerate(texts) if len(words) >= shortest]
    if not held:
        return out
    words = np.concatenate([np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i])) for i in held])
    sizes = np.array([len(texts[i]) for i in held])
    # A run of n words and period q <= n / 2 holds two equal windows of n - q >= n / 2 words.
    open_texts = repeats_a_window(words, np.repeat(np.arange(len(held)), sizes), -(-shortest // 2))
    if not open_texts.any():
        return out
    words = words[np.repeat(open_texts, sizes)]
    held, sizes = [i for i, x in zip(held, open_texts, strict=True) if x], sizes[open_texts]
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(held)), sizes)
    rows = _all_runs(words, text, (ends - sizes)[text], ends[text])
    rows = rows[rows[:, 1] - rows[:, 0] >= shortest]
    cuts = np.searchsorted(rows[:, 0], ends)
    a = 0
    for i, b, base in zip(held, cuts.tolist(), (ends - sizes).tolist(), strict=True):
        got = rows[a:b]
        out[i] = np.stack([got[:, 0] - base, got[:, 1] - got[:, 0], got[:, 2]], axis=1)
        a = b
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside runs and those of each run's first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _batches(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        # Bytes are split at the six ASCII space signs only.
        words = text.encode().split() if text else []
        if held and size + len(words) > BATCH_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _columns(shortest: int):
    def compute(texts: pa.Array) -> list[pa.Array]:
        found, kept, n_words = [], [], []
        for words in _batches(texts.to_pylist()):
            runs = runs_of(words, shortest)
            found += runs
            kept += [collapsed(w, r).decode() for w, r in zip(words, runs, strict=True)]
            n_words += map(len, words)
        rows = np.concatenate([*found, np.zeros((0, 3), np.int64)])
        ends = np.cumsum([0, *map(len, found)])
        cells = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["start", "length", "period"])
        return [pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells), pa.array(kept, pa.string())]

    return compute


def tandem_runs(docs: DataFrame, *, text_column: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed``; columns of these names are replaced.

    Words stand between spaces and ``\\t`` to ``\\r``. ``runs`` holds start, length and smallest period of every run of
    at least ``shortest`` words and twice its period, by start, then period; starts count from 0. ``collapsed`` is the
    text with only the first period of each run, words joined by one space. A null or empty text has no words, no runs
    and an empty collapsed text. Rows are independent: null ids, repeated rows and other columns are left as they are;
    an empty table gives an empty result.
    """
    return add_columns(docs, text_column, _columns(shortest), [
        T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])
