"""SimHash near-duplicates: exact links of 64-bit fingerprints by tiled exclusive-or and bit counts.

Fingerprints are made distinct first. A tile holds the fingerprints with the same population counts in each of a few
equal blocks of bits. One flipped bit changes one count by one, so two fingerprints within the radius lie in tiles
whose counts differ by no more than the radius in sum: all other pairs of tiles are skipped, unseen. Each fingerprint
visits the later ones of these tiles, where numpy compares the tile's own members with each other and with the visitors.

The number of blocks grows with the number of fingerprints (``BLOCKS``): more blocks, smaller tiles, more visits. It
changes the work, never the links. A tile whose members or visitors are too many for one task becomes a grid of cells
that are compared in tasks of their own. A cell gives a spanning set of edges, at most one per row, not its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline.llm.arrow import add_columns
from forkline.llm.components import components
from forkline.session import stage

WIDTH = 3  # words of a shingle
SEED = 42
BLOCKS = ((1 << 23, 4), (1 << 30, 8))  # blocks below so many fingerprints; 16 beyond
CELL = 20_000  # members, or visitors, that one task holds
PAIRS = 1 << 16  # pairs compared at a time
GATHERED = 1 << 17  # hashes whose bits are added up at a time


def _bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return np.stack([np.add.reduceat((hashes >> np.uint64(k)) & one, starts) for k in range(64)], axis=1).astype(np.int64)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Fingerprint of each text; 0 for a null text or one without words."""
    digest = xxhash.xxh64_intdigest
    sums, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, rows, starts = [], [], []

    def add_up() -> None:
        if held:
            np.add.at(sums, rows, _bit_sums(np.array(held, np.uint64), np.array(starts)))
        held.clear(), rows.clear(), starts.clear()

    for row, text in enumerate(texts):
        words = text.encode().lower().split() if text else []
        if not words:
            continue
        shingles = zip(*(words[k:] for k in range(WIDTH)), strict=False) if len(words) >= WIDTH else iter([words])
        while some := [digest(b" ".join(s), SEED) for s in itertools.islice(shingles, GATHERED)]:
            rows.append(row)
            starts.append(len(held))
            totals[row] += len(some)
            held += some
            if len(held) >= GATHERED:
                add_up()
    add_up()
    return np.packbits(2 * sums > totals[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def offsets(blocks: int, radius: int) -> np.ndarray:
    """Changes of the counts, by at most ``radius`` in sum, that lead to this tile or a later one."""
    out = {(0,) * blocks}
    for _ in range(radius):
        out |= {(*d[:i], d[i] + s, *d[i + 1 :]) for d in out for i in range(blocks) for s in (1, -1)}
    # Counts are compared from the last block, as in the packed number.
    return np.array(sorted(d for d in out if d[::-1] >= (0,) * blocks), np.int64)


def counts(prints: np.ndarray, blocks: int) -> np.ndarray:
    """Population counts of each fingerprint's blocks, a column for each block."""
    width = 64 // blocks
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count((prints >> np.uint64(width * k)) & mask) for k in range(blocks)], axis=1).astype(np.int64)


def _tile_of(count: np.ndarray, blocks: int) -> np.ndarray:
    bits = (64 // blocks).bit_length()
    return (count << (bits * np.arange(blocks, dtype=np.int64))).sum(axis=1)


def _visits(blocks: int, radius: int):
    """Rows (tile, role, print, node): role 0 in the own tile, 1 in each later tile within the radius."""
    steps, names = offsets(blocks, radius), ["tile", "role", "print", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            nodes, count = batch.column(1).to_numpy(zero_copy_only=False), counts(prints, blocks)
            for step in steps:
                moved = count + step
                fits = ((moved >= 0) & (moved <= 64 // blocks)).all(axis=1)
                n = int(fits.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array(_tile_of(moved[fits], blocks)), pa.array(np.full(n, int(step.any()), np.int32)),
                    pa.array(prints[fits].view(np.int64)), pa.array(nodes[fits])], names=names)

    return run


def _visited(blocks: int, radius: int):
    """Members and visitors of tiles, from the members of each."""
    steps, width = offsets(blocks, radius), 64 // blocks
    bits = width.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            count = (tiles[:, None] >> (bits * np.arange(blocks, dtype=np.int64))) & ((1 << bits) - 1)
            for step in steps:
                moved = count + step
                fits = ((moved >= 0) & (moved <= width)).all(axis=1)
                none = np.zeros(int(fits.sum()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_tile_of(moved[fits], blocks)), *map(pa.array, (none, n[fits]) if step.any() else (n[fits], none))],
                    names=["tile", "members", "visitors"])

    return run


def spanning_links(prints: np.ndarray, members: int, inner: bool, radius: int) -> list[tuple[int, int]]:
    """Edges between rows that join what the links join: links of the first ``members`` rows with all later rows, or,
    unless ``inner``, with the rows after the members only."""
    n, out = len(prints), []
    label = np.arange(n)
    step = max(1, PAIRS // max(n, 1))
    for a in range(0, members, step):
        b = min(a + step, members)
        first = a + 1 if inner else members
        near = np.flatnonzero(np.bitwise_count(prints[a:b, None] ^ prints[None, first:]) <= radius)
        if not len(near):
            continue
        i, j = np.divmod(near, n - first)
        i, j = i + a, j + first
        x, y = label[i], label[j]
        apart = (x != y) & (i < j)
        if not apart.any():
            continue
        top: dict[int, int] = {}

        def root(v: int) -> int:
            while v in top:
                v = top[v]
            return v

        for v, w in np.unique(np.stack([x[apart], y[apart]], axis=1), axis=0).tolist():
            v, w = root(v), root(w)
            if v != w:
                top[max(v, w)] = min(v, w)
                out.append((v, w))
        to = np.arange(n)
        for v in top:
            to[v] = root(v)
        label = to[label]
    return out


def _cell_links(radius: int):
    """Links of the cells, whose rows come one after the other, members first."""

    def links(side, prints, nodes, inner) -> tuple[np.ndarray, np.ndarray]:
        edges = spanning_links(prints, int((side == 0).sum()), inner, radius)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        return nodes[ends[:, 0]], nodes[ends[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if held is None or not len(held[0]):
                continue
            tile, cell, side, inner, prints, nodes = held
            new = np.flatnonzero((tile[1:] != tile[:-1]) | (cell[1:] != cell[:-1])) + 1
            cuts = [0, *new.tolist()] + ([len(tile)] if batch is None else [])
            found = [
                links(side[s:e], prints[s:e].view(np.uint64), nodes[s:e], bool(inner[s]))
                for s, e in itertools.pairwise(cuts) if e - s > 1 and side[s] == 0]
            held = [x[cuts[-1] :] for x in held]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def links(nodes: DataFrame, radius: int = 2, cell: int = CELL, blocks: int | None = None) -> DataFrame:
    """Edges ``a, b`` between ``node`` values of ``nodes`` (``print`` distinct 64-bit number, ``node`` integer) that
    connect exactly the nodes that links within ``radius`` bits connect."""
    if blocks is None:
        total = nodes.count()
        blocks = next((b for below, b in BLOCKS if total < below), 16)
    width = 64 // blocks
    bits = width.bit_length()
    tile = F.expr(" + ".join(
        f"shiftleft(cast(bit_count(shiftrightunsigned(print, {width * k}) & {(1 << width) - 1}L) as bigint), {bits * k})" for k in range(blocks)))
    sizes = nodes.groupBy(tile.alias("tile")).agg(F.count("*").alias("n"))
    sizes = sizes.mapInArrow(_visited(blocks, radius), "tile bigint, members bigint, visitors bigint")
    large = sizes.groupBy("tile").agg(F.sum("members").alias("members"), F.sum("visitors").alias("visitors"))
    large = large.where(f"members > 0 and (members > {cell} or visitors > {cell})")
    large = stage(large.selectExpr("tile", f"cast(ceil(members / {cell}) as int) as mp", f"cast(ceil(visitors / {cell}) as int) as vp"), "tiles")
    visits = nodes.select("print", "node").mapInArrow(_visits(blocks, radius), "tile bigint, role int, print bigint, node bigint")
    visits = visits.join(large, "tile", "left").withColumn(
        "part", F.expr("cast(pmod(xxhash64(print), if(role = 0, mp, greatest(vp, 1))) as int)"))
    # Kind of cell: 0 a whole tile, 1 members with members, 2 members with visitors.
    cells = visits.select("tile", "role", "print", "node", "part", F.explode(F.expr(
        "case when mp is null then array(named_struct('kind', 0, 'x', 0, 'y', 0)) "
        "when role = 0 then concat("
        "transform(sequence(0, mp - 1), j -> named_struct('kind', 1, 'x', least(part, j), 'y', greatest(part, j))), "
        "transform(if(vp > 0, sequence(0, vp - 1), array()), j -> named_struct('kind', 2, 'x', part, 'y', j))) "
        "else transform(sequence(0, mp - 1), i -> named_struct('kind', 2, 'x', i, 'y', part)) end")).alias("c"))
    cells = cells.selectExpr(
        "tile", "shiftleft(cast(c.kind as bigint), 60) + shiftleft(cast(c.x as bigint), 30) + c.y as cell",
        "if(c.kind = 1, if(part = c.x, 0, 1), role) as side", "c.kind = 0 or (c.kind = 1 and c.x = c.y) as inner", "print", "node")
    return cells.repartition("tile", "cell").sortWithinPartitions("tile", "cell", "side").mapInArrow(
        _cell_links(radius), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", radius: int = 2, cell: int = CELL,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable by links) per row.

    Words are what stands between spaces and ``\\t`` to ``\\r``, A-Z lower-cased; shingles are three words, repeats
    included; a shorter text is one shingle. A bit is set if it is set in over half of the shingles' hashes. A null
    text, or one without words, has fingerprint zero and links like any other. Rows with a null id keep their
    fingerprint, take no part in links and have a null component. Rows that repeat an id are each returned; the id
    joins the components of its texts. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    prints = add_columns(
        docs, "text", lambda texts: [pa.array(fingerprints(texts.to_pylist()).view(np.int64))], [T.StructField("print", T.LongType())])
    prints = stage(prints.select("doc_id", "print"), "prints")
    named = prints.where("doc_id is not null")
    nodes = stage(named.groupBy("print").agg(F.min("doc_id").alias("node")), "nodes")
    edges = links(nodes, radius, cell)
    # An id with several texts joins their fingerprints.
    several = named.groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo <> hi").select("doc_id")
    joined = named.join(several, "doc_id", "left_semi").join(nodes, "print").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    edges = edges.union(joined)
    labels = components(edges)
    held = nodes.join(labels, "node", "left").select("print", F.coalesce("label", "node").alias("component_id"))
    out = prints.join(held, "print", "left")
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.expr("if(doc_id is null, null, component_id)").alias("component_id"))
