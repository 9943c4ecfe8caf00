"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are windows of 13 benchmark words with single spaces between and around them. Texts are brought to the same
form. A table of shifts says for each block of bytes how far the search may move when that block ends at the current
position; where the shift is zero, the bucket of that block names the windows to compare directly. Windows of similar
length share a table, so a one-word item does not shorten the moves of the others.

The benchmark is the stated query set: it is taken in blocks of bounded size, each one pass over all texts with its
tables broadcast; between passes the rows are stored, so that a worker holds the tables of one block. Texts are never
shuffled.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline.llm.arrow import add_columns
from forkline.llm.shingles import LOWER, buffers
from forkline.session import stage

WINDOW = 13  # words; fixed by the contract
BLOCK = 10  # bytes of a block
PASS_BYTES = 16_000_000  # benchmark text of one pass over the documents; its tables take about ten times that
CLASSES = (24, 48)  # windows below these many bytes have tables of their own

# Letters, digits and every byte of a multi-byte character: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def normalised(column: pa.Array) -> Iterator[tuple[bytes, int]]:
    """Each text as lower-cased words with one space before, between and after them, and its number of words."""
    data, offsets = buffers(column)
    inside = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = ~inside[:-1]
    before |= edge[:-1]
    starts = np.flatnonzero(inside & before)
    letters = LOWER[data[inside]]
    first = np.cumsum(inside)[starts] - 1 if len(starts) else starts
    lengths = np.diff(np.append(first, len(letters)))
    of_row = np.searchsorted(starts, offsets)
    counts = np.diff(of_row)
    row = np.repeat(np.arange(len(counts)), counts)
    out = np.full(len(letters) + len(starts) + len(counts), 0x20, np.uint8)
    out[np.arange(len(letters)) + np.repeat(np.arange(1, len(starts) + 1) + row, lengths)] = letters
    sizes = np.add.reduceat(np.append(lengths, 0), of_row[:-1]) * (counts > 0) + counts + 1 if len(counts) else counts
    ends = np.cumsum(sizes)
    whole = out.tobytes()
    for end, size, n in zip(ends.tolist(), sizes.tolist(), counts.tolist(), strict=True):
        yield whole[end - size : end], n


class WuManber:
    """Search for patterns of similar length.

    The patterns are stretches of one text, kept as places: a table of shifts in one byte per slot of the block's hash
    (blocks that share a slot take the least of their shifts, which is safe), and the hashes of the patterns' last
    blocks in order, with the places of the patterns. About ten bytes per byte of text, whatever Python's objects take.
    """

    def __init__(self, text: bytes, starts: np.ndarray, ends: np.ndarray, block: int = BLOCK):
        self.text, lengths = text, ends - starts
        self.least = int(lengths.min())
        self.block = min(block, self.least)
        self.far = min(255, self.least - self.block + 1)
        # Hash of the block that ends at each place of the text.
        ending = np.zeros(len(text) + 1, np.uint32)
        for end in range(self.block, len(text) + 1):
            ending[end] = crc32(text[end - self.block : end])
        # Half of the slots or more stay empty: there are no more different blocks than places in the text.
        self.bits = max(10, (2 * min(len(starts) * (self.least - self.block + 1), len(text))).bit_length())
        self.mask = (1 << self.bits) - 1
        shift = np.full(1 << self.bits, self.far, np.uint8)
        for end in range(self.block, self.least + 1):
            np.minimum.at(shift, ending[starts + end] & np.uint32(self.mask), np.uint8(min(255, self.least - end)))
        self.shift = shift.tobytes()
        last = ending[starts + self.least]
        by = np.lexsort((starts, last))
        self.last = array("I", last[by].tobytes())
        self.number = array("q", by.astype(np.int64).tobytes())
        self.starts, self.ends = array("q", starts.astype(np.int64).tobytes()), array("q", ends.astype(np.int64).tobytes())

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """Start and number of every occurrence of a pattern."""
        end, block, least, shift, mask = self.least, self.block, self.least, self.shift, self.mask
        n = len(text)
        while end <= n:
            at = crc32(text[end - block : end])
            step = shift[at & mask]
            if step:
                end += step
                continue
            i = bisect_left(self.last, at)
            while i < len(self.last) and self.last[i] == at:
                number = self.number[i]
                if text.startswith(self.text[self.starts[number] : self.ends[number]], end - least):
                    yield end - least, number
                i += 1
            end += 1


class Windows:
    """Tables for the windows of some items: places in the items' normalised texts, and whose they are."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.items = [item for item, _ in items]
        texts = pa.array([t for _, t in items], pa.large_string())
        raws, starts, ends, words, owner, size = [], [], [], [], [], 0
        for k, (raw, n) in enumerate(normalised(texts)):
            if n:
                spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20)  # n + 1: before, between and after the words
                width = min(WINDOW, n)
                starts.append(spaces[: len(spaces) - width] + size)
                ends.append(spaces[width:] + 1 + size)
                words.append(np.full(len(ends[-1]), width, np.int64))
                owner.append(np.full(len(ends[-1]), k, np.int64))
            raws.append(raw)
            size += len(raw)
        text = b"".join(raws)
        self.tables = []
        if starts:
            starts, ends, words, owner = map(np.concatenate, (starts, ends, words, owner))
            kind = np.searchsorted(CLASSES, ends - starts, side="right")
            for c in np.unique(kind):
                mine = kind == c
                self.tables.append((WuManber(text, starts[mine], ends[mine]), words[mine], owner[mine]))

    def hits(self, text: bytes) -> tuple[list[tuple[int, int]], list[str]]:
        """Ranges of hit words (first, last) without overlaps, and the items with an occurring window."""
        found = [(at, int(words[k]), self.items[owner[k]]) for table, words, owner in self.tables for at, k in table.find(text)]
        if not found:
            return [], []
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
        ranges: list[list[int]] = []
        items: set[str] = set()
        for first, n, owner in sorted(((int(np.searchsorted(spaces, at)), n, owner) for at, n, owner in found), key=lambda x: x[:2]):
            if owner is not None:
                items.add(owner)
            if ranges and first <= ranges[-1][1] + 1:
                ranges[-1][1] = max(ranges[-1][1], first + n - 1)
            else:
                ranges.append([first, first + n - 1])
        return [tuple(r) for r in ranges], sorted(items)


RANGES = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
ARROW_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _blocks(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of about PASS_BYTES each; one block at a time is on the driver."""
    rows = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // PASS_BYTES))
    for i in range(n):
        yield [tuple(r) for r in rows.where(F.expr(f"pmod(xxhash64(item, text), {n}) = {i}")).collect()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_column: str = "text", item_column: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_ranges`` (first and last word), ``items``, ``n_hit``, ``n_items``,
    ``items_sha256`` and ``contaminated``; columns of these names are replaced.

    An item of fewer than 13 words, but not none, is one window. Null or empty texts have no words and are not hit;
    null or empty items have no windows. Items with a null id hit words, but are not listed. With an empty benchmark
    nothing is hit. Repeated rows are each judged.
    """
    spark = docs.sparkSession
    out, columns = docs, []
    for i, block in enumerate(_blocks(benchmark, item_column, item_text)):
        if i:
            out = stage(out, "searched")
        tables = spark.sparkContext.broadcast(Windows(block))

        def compute(texts: pa.Array, tables=tables) -> list[pa.Array]:
            n, ranges, items = [], [], []
            for raw, count in normalised(texts):
                r, x = tables.value.hits(raw)
                n.append(count)
                ranges.append([{"first": a, "last": b} for a, b in r])
                items.append(x)
            return [pa.array(n, pa.int64()), pa.array(ranges, ARROW_RANGES), pa.array(items, pa.list_(pa.string()))]

        columns.append((f"__ranges_{i}", f"__items_{i}"))
        out = add_columns(out, text_column, compute, [
            T.StructField("n_words", T.LongType()), T.StructField(columns[-1][0], RANGES),
            T.StructField(columns[-1][1], T.ArrayType(T.StringType()))])
    hit_words = "aggregate({}, 0L, (s, r) -> s + r.last - r.first + 1)"
    if len(columns) == 1:
        ranges, items = F.col(columns[0][0]), F.col(columns[0][1])
    else:  # ranges of several blocks may overlap: merge them in order
        ranges = F.expr(
            "aggregate(array_sort(concat(" + ", ".join(r for r, _ in columns) + ")), "
            "cast(array() as array<struct<first: bigint, last: bigint>>), (done, r) -> case "
            "when size(done) = 0 or r.first > element_at(done, -1).last + 1 then concat(done, array(r)) "
            "else concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, "
            "'last', greatest(element_at(done, -1).last, r.last)))) end)")
        items = F.array_sort(F.array_distinct(F.concat(*[F.col(x) for _, x in columns])))
    return (
        out.withColumn("hit_ranges", ranges).withColumn("items", items)
        .drop(*[c for pair in columns for c in pair])
        .withColumn("n_hit", F.expr(hit_words.format("hit_ranges")))
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    )
