"""Quality rules: a decision list learned from labelled text statistics, applied as one Spark expression.

The list is learned by sequential covering. A rule is grown on two thirds of the labelled rows, one threshold at a
time, by the information it gains on bad rows; it is pruned on the other third; the rows it covers are taken out and
the next rule is grown. Rules are kept only while they cover enough held-out rows and are precise on these, and on all
rows, so clean texts stay. The list becomes ``CASE WHEN rule 1 THEN .. WHEN rule 2 ..`` over the statistics.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline.llm.arrow import add_columns

# Fixed values of the contract.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# What rules may test, over the statistics of a text with words.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "dup_line_share": "n_dup_lines / n_words",
    "repeat_share": "n_repeat_words / n_words",
}


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and words in repeated 3-word windows of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8")
    words = raw.split()  # bytes split at exactly the six separators
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    lines = raw.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        lines = [x for x in lines if x.strip(SPACE)]
        dup = len(lines) - len(set(lines))
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the statistics as long columns, of the whole text; columns of those names are replaced.

    A null or empty text has zeros.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        rows = [text_statistics(t) for t in texts.to_pylist()]
        return [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]

    return add_columns(docs, text_column, compute, [T.StructField(c, T.LongType()) for c in STATISTICS])


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``feature >= cut`` (above) or ``feature < cut`` tests, with its precision and rows among those held out."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def column(self) -> Column:
        tests = [F.expr(FEATURES[f]) >= F.lit(cut) if above else F.expr(FEATURES[f]) < F.lit(cut) for f, above, cut in self.tests]
        return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def rule_number(self) -> Column:
        """Number of the first rule that holds, from 1; null where none does."""
        if not self.rules:
            return F.lit(None).cast("int")
        cases = F.when(self.rules[0].column(), F.lit(1))
        for i, rule in enumerate(self.rules[1:], 2):
            cases = cases.when(rule.column(), F.lit(i))
        return cases


def _holds(x: np.ndarray, tests: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in tests:
        out &= (x[:, f] >= cut) if above else (x[:, f] < cut)
    return out


def _cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    """Midpoints between neighbouring values, at most ``most`` of them, by rank."""
    u = np.unique(values)
    mids = (u[1:] + u[:-1]) / 2
    return mids[np.unique(np.linspace(0, len(mids) - 1, most).astype(int))] if len(mids) > most else mids


def _grow(x: np.ndarray, bad: np.ndarray, most_tests: int) -> list[tuple[int, bool, float]]:
    tests: list[tuple[int, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(tests) < most_tests:
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for f in range(x.shape[1]):
            for cut in _cuts(x[inside, f]):
                for above in (True, False):
                    got = inside & ((x[:, f] >= cut) if above else (x[:, f] < cut))
                    q = int((bad & got).sum())
                    if q:
                        gain = q * (np.log2(q / int(got.sum())) - before)
                        if gain > best[0]:
                            best = (gain, (f, above, float(cut)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= _holds(x, [best[1]])
    return tests


def _worth(x: np.ndarray, bad: np.ndarray, tests: list) -> float:
    got = _holds(x, tests)
    p, n = int((bad & got).sum()), int((~bad & got).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(
    x: np.ndarray, bad: np.ndarray, names: list[str], *, min_precision: float = 0.95, min_covered: int = 3,
    most_rules: int = 12, most_tests: int = 3,
) -> DecisionList:
    """Decision list from a matrix of features and a flag per row; rows are held out by position (every third).

    A rule needs ``min_covered`` held-out rows, ``min_precision`` of them bad; the rows it was grown on do not vouch for it.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    held = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (bad & left).any():
        tests = _grow(x[left & ~held], bad[left & ~held], most_tests)
        if not tests:
            break
        ways = [tests[:k] for k in range(1, len(tests) + 1)]
        tests = max(ways, key=lambda w: (_worth(x[left & held], bad[left & held], w), -len(w)))
        got = left & _holds(x, tests)
        covered, right = int((got & held).sum()), int((bad & got & held).sum())
        if covered < min_covered or right < min_precision * covered or (bad & got).sum() < min_precision * got.sum():
            break
        rules.append(Rule(tuple((names[f], above, cut) for f, above, cut in tests), right / covered, covered))
        left &= ~got
    return DecisionList(tuple(rules))


def fit(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    good_column: str = "quality", sample_rows: int = 20_000, min_precision: float = 0.95,
) -> DecisionList:
    """Learn the list from at most ``sample_rows`` labelled rows (1 good, 0 bad), the first by hash of their id.

    Rows with a null id or label are left out; an id labelled twice, or with several rows, counts as often, in
    ``sample_rows`` rows altogether. Texts that fail the base rules
    teach nothing. Without labelled rows the list is empty and rejects nothing.
    """
    sample = (
        labels.select(F.col(id_column).cast("bigint").alias("__id"), F.col(good_column).cast("int").alias("__good"))
        .dropna().orderBy(F.xxhash64("__id"), "__id", "__good").limit(sample_rows)
    )
    texts = docs.select(F.col(id_column).cast("bigint").alias("__id"), F.col(text_column).alias("__body"))
    labelled = texts.join(F.broadcast(sample), "__id")  # at most sample_rows narrow rows
    known = with_statistics(labelled, "__body").where(~base_failed())
    known = known.select("__id", "__good", *[F.expr(e).alias(f"f_{n}") for n, e in FEATURES.items()])
    # Again at most sample_rows, as an id may have several rows.
    rows = known.orderBy(F.xxhash64("__id"), *known.columns).limit(sample_rows).collect()
    rows.sort(key=lambda r: (hash((r["__id"] * 2654435761) % 2**32), tuple(r)))
    names = list(FEATURES)
    x = np.array([[r[f"f_{n}"] or 0.0 for n in names] for r in rows], float).reshape(len(rows), len(names))
    return learn(x, np.array([r["__good"] == 0 for r in rows], bool), names, min_precision=min_precision)


def judged(docs: DataFrame, rules: DecisionList, text_column: str = "text") -> DataFrame:
    """``docs`` with statistics, ``base_failed``, ``rule`` (number of the rejecting rule or null) and ``kept``.

    Null and empty texts fail the base rules. Columns of these names are replaced, all others stay.
    """
    known = with_statistics(docs, text_column).withColumn("base_failed", base_failed())
    known = known.withColumn("rule", F.when(F.col("base_failed"), F.lit(None)).otherwise(rules.rule_number()).cast("int"))
    return known.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
