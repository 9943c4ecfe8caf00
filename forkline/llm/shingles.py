"""Words and word shingles of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

Words are maximal runs of bytes other than the separators space and ``\\t`` to ``\\r``, with A-Z lower-cased; bytes
of multi-byte characters are never separators, so this equals the pattern ``[^\\x20\\x09-\\x0D]+`` on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5  # words of a shingle
SLICE_BYTES = 2_000_000  # texts worked on at a time; one longer text is a slice of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PLACE = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them. A null text has no bytes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows, in order, and the n + 1 offsets of the rows into the words."""
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = True
        np.logical_not(inside[:-1], out=before[1:])
        before |= edge[:-1]
    starts = np.flatnonzero(inside & before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letters = LOWER[data[inside]]
    first = np.cumsum(inside)[starts] - 1  # of each word, among the letters
    lengths = np.diff(np.append(first, len(letters)))
    at = np.arange(len(letters), dtype=np.int64) - np.repeat(first, lengths)
    weight = mix(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64)) | np.uint64(1)
    hashes = mix(np.add.reduceat(BYTE[letters] * weight[at], first) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each row its distinct shingles as ascending 64-bit hashes.

    A text of fewer than ``width`` words, but not none, has its whole sequence as its only shingle; a null text, or
    one without words, has none.
    """
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        part = offsets[i : j + 1]
        hashes, rows = words(data[part[0] : part[-1]], part - part[0])
        if len(hashes) >= width:
            total = np.zeros(len(hashes) - width + 1, np.uint64)
            for k in range(width):
                total += hashes[k : len(hashes) - width + 1 + k] * PLACE[k]
            total = mix(total)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(total[a : b - width + 1])
            elif b > a:
                yield mix(np.array([(hashes[a:b] * PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
