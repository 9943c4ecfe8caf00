"""Exact Jaccard self-join of texts on word shingles by rare-first prefix filtering.

One pass over the texts counts shingles in a sketch of fixed size and takes a digest of every shingle set. The order
of shingles is (sketched count, hash), so frequent passages come last. A second pass emits only each set's prefix,
the ``n - ceil(t n) + 1`` rarest shingles: sets with similarity ``t`` or more share one of these. Sets that meet on a
prefix shingle are candidates if the length filter and the positional filter (the sets' remaining shingles could
still overlap enough) allow it; the suffix filter and the exact overlap are computed on the texts, once per pair.

Groups of near copies are not expanded into all pairs. First every member is compared with one anchor of its prefix
group, which joins most groups; then the tops of groups that still meet; last the pairs between groups that are
still apart, unless the triangle inequality of the Jaccard distance rules them out. So no link between different
components is missed, and pairs inside a known component are left out. The smaller set of such a pair must meet the
other on its shorter index prefix, and the sizes lie in neighbouring bands, so a template that many texts hold without
being similar makes no pairs at all.

Equal sets share their digest and are one member, however many rows have them. Blocks of prefix shingles are split
by hash, very frequent ones also by member, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.llm.arrow import packed, parts, unpacked
from forkline.llm.components import components
from forkline.llm.shingles import mix, shingle_sets
from forkline.session import stage

SKETCH_BITS = 21  # counters of the sketch: 2 MB as broadcast, whatever the input
CHUNK_BITS = 11  # counters are added up in 2^11 chunks
HOT = 200_000  # sketched count from which a shingle's members are dealt to several blocks
BLOCK_ENTRIES = 500_000  # prefix shingles of a block, on average
MIN_BLOCKS = 64
FILTER_BITS = 21  # of the bitmap of ids whose texts are compared: at most 2^18 broadcast rows
ANCHOR_SHARE = 1_000  # members compared with one copy of an anchor's text

U = np.uint64


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U(64 - SKETCH_BITS)).astype(np.int64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        a, b = mix(shingles + U(1)).sum(), mix(shingles ^ U(0x5851F42D4C957F2D)).sum()
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with size and digest for each text, and the partition's counters as chunks."""
    counters, used = np.zeros(1 << SKETCH_BITS, np.int64), False
    names = ["doc_id", "n", "k1", "k2", "chunk", "counts"]
    for batch in batches:
        n, k1, k2, gathered, held = [], [], [], [], 0
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            a, b = _digest(s)
            k1.append(a)
            k2.append(b)
            gathered.append(s)
            held += len(s)
            if held > 1_000_000:
                counters += np.bincount(_slot(np.concatenate(gathered)), minlength=len(counters))
                gathered, held, used = [], 0, True
        if held:
            counters += np.bincount(_slot(np.concatenate(gathered)), minlength=len(counters))
            used = True
        none = pa.nulls(len(n))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
             none.cast(pa.int32()), none.cast(pa.binary())], names=names)
    if used:
        chunks = np.minimum(counters, 2**31 - 1).astype(np.int32).reshape(1 << CHUNK_BITS, -1)
        filled = np.flatnonzero(chunks.any(axis=1))
        none = pa.nulls(len(filled), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array(filled, pa.int32()), pa.array([chunks[i].tobytes() for i in filled], pa.binary())],
            names=names)


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = np.frombuffer(cell.as_buffer(), np.int32).astype(np.int64)
            total[c] = total[c] + got if c in total else got
    # An eighth of a power of two is a class; 0 to 255 hold every 31-bit count and more.
    cells = [np.minimum(255, np.round(8 * np.log2(np.maximum(v, 1)))).astype(np.uint8).tobytes() for v in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(cells, pa.binary())], names=["chunk", "classes"])


def _classes(survey: DataFrame) -> np.ndarray:
    """Count class of each of the 2^21 counters: a table of fixed size."""
    chunks = survey.where("chunk is not null").select("chunk", "counts")
    rows = chunks.repartition("chunk").mapInArrow(_add_chunks, "chunk int, classes binary").collect()
    classes = np.zeros((1 << CHUNK_BITS, 1 << (SKETCH_BITS - CHUNK_BITS)), np.uint8)
    for r in rows:
        classes[r["chunk"]] = np.frombuffer(r["classes"], np.uint8)
    return classes.reshape(-1)


def _prefixes(classes, blocks: int, hot: int):
    """Prefix shingles of each different set of the partition, dealt to blocks by hash; a shingle of class ``hot``
    or above goes to several blocks."""
    share = float(np.exp2(hot / 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for batch in (part for whole in batches for part in parts(whole, 1)):
            order, key, first, size, place, seen = [], [], [], [], [], {}
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                if not len(s) or doc is None:
                    continue
                a, _ = _digest(s)
                n = len(s)
                if seen.setdefault((a, n), doc) <= doc and seen[a, n] != doc:
                    continue  # a copy with a smaller id was met
                seen[a, n] = doc
                ranked = (table[_slot(s)].astype(U) << U(56)) | (s >> U(8))
                p = n - (3 * n + 3) // 4 + 1
                ranked = np.sort(np.partition(ranked, p - 1)[:p])
                order.append(ranked)
                key.append(np.full(p, a, np.int64))
                first.append(np.full(p, doc, np.int64))
                size.append(np.full(p, n, np.int32))
                place.append(np.arange(p, dtype=np.int32))
            if not order:
                continue
            order, key, first, size, place = map(np.concatenate, (order, key, first, size, place))
            spread = np.zeros(len(order), U)
            often = (order >> U(56)).astype(np.uint8) >= hot
            if often.any():
                estimate = np.exp2((order[often] >> U(56)).astype(np.float64) / 8)
                spread[often] = mix(key[often].astype(U)) % np.ceil(estimate / share).astype(U)
            block = ((mix(order + spread * U(0x9E3779B97F4A7C15)) >> U(33)) % U(blocks)).astype(np.int32)
            by = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[by])) + 1
            ids, cells = [], []
            for part in np.split(by, cuts):
                ids.append(int(block[part[0]]))
                cells.append(packed(order[part], key[part], first[part], size[part], place[part]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(cells, pa.binary())], names=["block", "cell"])

    return run


def _candidates(cells: list[memoryview], hot: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of anchor and member, and the groups of three or more, of one block; all of a shingle of class ``hot``."""
    got = [unpacked(c, U, np.int64, np.int64, np.int32, np.int32) for c in cells]
    order, key, first, size, place = (np.concatenate(x) for x in zip(*got, strict=True))
    by = np.lexsort((first, key, order))
    order, key, first, size, place = order[by], key[by], first[by], size[by], place[by]
    new = np.empty(len(order), bool)
    new[:1] = True
    new[1:] = (order[1:] != order[:-1]) | (key[1:] != key[:-1]) | (size[1:] != size[:-1])
    order, first, size, place = order[new], first[new], size[new], place[new]  # the smallest id of each set
    often = (order >> U(56)).astype(np.uint8) >= hot
    if often.any():  # its members are in several blocks: the shingle names the group
        yield first[often], first[often], order[often].astype(np.int64), size[often], place[often]
    starts = np.flatnonzero(np.r_[True, order[1:] != order[:-1]])
    counts = np.diff(np.append(starts, len(order)))
    keep = np.repeat(counts > 1, counts)
    if not keep.any():
        return
    often = often[starts][counts > 1]
    first, size, place = first[keep], size[keep], place[keep]
    counts = counts[counts > 1]
    starts = np.cumsum(counts) - counts
    group = np.repeat(np.arange(len(counts)), counts)
    by = np.lexsort((first, group))
    first, size, place = first[by], size[by], place[by]
    a = np.repeat(starts, counts)
    small, large = np.minimum(size[a], size), np.maximum(size[a], size)
    need = -(-3 * (small.astype(np.int64) + large) // 7)
    rest = 1 + np.minimum(size[a] - place[a] - 1, size - place - 1)
    ok = (4 * small.astype(np.int64) >= 3 * large) & (rest >= need) & (first[a] != first)
    pairs = np.unique(np.stack([first[a][ok], first[ok]], axis=1), axis=0)
    none = np.zeros(len(pairs), np.int32)
    yield pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64), none, none
    # Shingles with the same members are one group, with each member's smallest place.
    with np.errstate(over="ignore"):
        name = np.add.reduceat(mix(first.astype(U)), starts) ^ counts.astype(U)
    _, once, same = np.unique(name, return_index=True, return_inverse=True)
    least = place.copy()
    np.minimum.at(least, np.repeat(starts[once[same]], counts) + np.arange(len(place)) - np.repeat(starts, counts), place)
    wanted = np.zeros(len(counts), bool)
    wanted[once] = True
    wanted = np.repeat(wanted & (counts > 2) & ~often, counts)
    if wanted.any():
        yield first[a][wanted], first[wanted], np.repeat(name.astype(np.int64), counts)[wanted], size[wanted], least[wanted]


def _meet(hot: int):
    """Candidates of the blocks, which come one after the other."""
    names = ["a", "b", "grp", "n", "place"]

    def out(cells):
        held = [[] for _ in names]
        for got in _candidates(cells, hot):
            for column, x in zip(held, got, strict=True):
                column.append(x)
            if sum(map(len, held[0])) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in held], names=names)
                held = [[] for _ in names]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in held], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells = None, []
        for batch in batches:
            for block, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now and cells:
                    yield from out(cells)
                    cells = []
                now = block
                cells.append(cell.as_buffer())
        if cells:
            yield from out(cells)

    return run


def _apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> bool:
    """Suffix filter: whether the halves around a pivot already differ in more than ``most`` shingles."""
    if abs(len(x) - len(y)) > most:
        return True
    if depth == 0 or not len(x) or not len(y):
        return False
    pivot = y[len(y) // 2]
    i, j = np.searchsorted(x, pivot), len(y) // 2
    left, right = abs(i - j), abs((len(x) - i) - (len(y) - j))
    if left + right > most:
        return True
    return _apart(x[:i], y[:j], most - right, depth - 1) or _apart(x[i:], y[j:], most - left, depth - 1)


def _verify(suffix_filter: bool):
    """Exact overlap of an anchor with each member of its block; the anchor comes first in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchor = None, None
        for batch in batches:
            a, b, inter, union = [], [], [], []
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), shingle_sets(batch.column(4)), strict=True)
            for x, share, role, doc, s in rows:
                if role == 0:
                    now, anchor = (x, share), s
                    continue
                if now != (x, share):
                    continue
                most = (len(anchor) + len(s)) // 7  # shingles outside the overlap of a pair at 0.75
                out = suffix_filter and _apart(anchor, s, most)
                both = 0 if out else len(np.intersect1d(anchor, s, assume_unique=True))
                a.append(x)
                b.append(doc)
                inter.append(both)
                union.append(len(anchor) + len(s) - both)
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()) for v in (a, b, inter, union)], names=["a", "b", "both", "either"])

    return run


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose id is not among ``ids``, so that their texts are not shuffled.

    A bitmap of hashed ids is broadcast as a table of octets: at most 2^(FILTER_BITS - 3) rows, whatever the input.
    Once very many ids fill it, it lets most rows pass.
    """
    at, bit = f"shiftright(pmod(xxhash64(doc_id), {1 << FILTER_BITS}), 3)", "cast(pmod(xxhash64(doc_id), 8) as int)"
    octets = ids.groupBy(F.expr(at).alias("__at")).agg(F.expr(f"bit_or(shiftleft(1, {bit}))").alias("__bits"))
    marked = docs.withColumn("__at", F.expr(at)).join(F.broadcast(octets), "__at")
    return marked.where(f"(shiftright(__bits, {bit}) & 1) = 1").select(*docs.columns)


def _compared(pairs: DataFrame, docs: DataFrame, suffix_filter: bool = True) -> DataFrame:
    """``a, b, both, either`` for each different pair; 0 in ``both`` where the suffix filter rules the pair out."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    dealt = pairs.join(degree, "a").select(
        "a", "b", F.expr(f"pmod(xxhash64(b), cast(ceil(degree / {ANCHOR_SHARE}) as bigint))").alias("share"))
    members = dealt.select("a", "share", F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    anchors = dealt.select("a", "share", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct()
    wanted = members.union(anchors)
    texts = wanted.join(_only(docs, wanted.select("doc_id")), "doc_id").select("a", "share", "role", "doc_id", "text")
    dealt = texts.repartition("a", "share").sortWithinPartitions("a", "share", "role")
    return dealt.mapInArrow(_verify(suffix_filter), "a bigint, b bigint, both bigint, either bigint")


LINKED = "100 * both >= 75 * either"


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``.

    Two texts link when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more; ``component_id`` is
    the smallest id reachable by links. A text with fewer words has its sequence as its only shingle. Null texts and
    texts without words have no shingles and link with nothing. Rows with a null id keep their count, take no part in
    links and have a null component. Ids should name one text; rows that repeat an id and its text are each returned.
    An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    survey = stage(
        docs.mapInArrow(_survey, "doc_id bigint, n bigint, k1 bigint, k2 bigint, chunk int, counts binary"), "survey")
    sets = survey.where("chunk is null").select("doc_id", "n", "k1", "k2")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = min(255, round(8 * float(np.log2(HOT))))
    blocks = max(MIN_BLOCKS, -(-total // (4 * BLOCK_ENTRIES)))
    classes = spark.sparkContext.broadcast(_classes(survey))
    met = stage(
        docs.mapInArrow(_prefixes(classes, blocks, hot), "block int, cell binary")
        .repartition(blocks, "block")
        .sortWithinPartitions("block")
        .mapInArrow(_meet(hot), "a bigint, b bigint, grp bigint, n int, place int"), "met")

    stars = stage(met.where("grp = 0").select("a", "b").distinct(), "stars")
    done = stage(_compared(stars, docs), "compared")
    labels = stage(components(done.where(LINKED)), "labels")

    # How far each member is from the smallest id of its component.
    far = (1 - F.col("both") / F.col("either")).alias("far")
    known = done.where("both > 0").select(F.col("a").alias("label"), F.col("b").alias("node"), far)
    apart = stage(labels.where("label <> node").join(known, ["label", "node"], "left_anti"), "apart")
    apart = _compared(apart.select(F.col("label").alias("a"), F.col("node").alias("b")), docs, suffix_filter=False)
    known = stage(known.union(apart.select(F.col("a").alias("label"), F.col("b").alias("node"), far)), "known")

    # Groups whose members are still in different components.
    members = met.where("grp <> 0").groupBy("grp", F.col("b").alias("node")).agg(F.min("n").alias("n"), F.min("place").alias("place"))
    members = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = members.join(known, ["label", "node"], "left").withColumn(
        "far", F.when(F.expr("label = node"), 0.0).otherwise(F.coalesce("far", F.lit(1.0))))
    # The overlap of a pair is at least 6/7 of its smaller set, so the pair meets on one of the first n - ceil(6 n / 7) + 1
    # shingles of that set: a member whose place is beyond them is never the smaller one, and a group without others is done.
    members = stage(members.withColumn("first", F.expr("place <= n - (6 * n + 6) div 7")), "members")
    open_groups = members.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("first").alias("first"))
    # Stored apart, so that the join deals its sides itself and may split a group of very many members.
    open_groups = stage(open_groups.where("lo < hi and first").select("grp"), "open-groups")
    members = stage(members.join(open_groups, "grp"), "open")

    # First the tops of two components, if any of their members in a group could pass the filters. The sizes of a pair
    # differ by a third at most, so the larger set is in the band of the smaller one or the next.
    sides = members.withColumn("band", F.expr("cast(floor(ln(n) / ln(1.5)) as int)")).groupBy("grp", "label", "band").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.expr("n - place")).alias("reach"),
        F.min(F.expr("if(first, n, null)")).alias("least_first"), F.max(F.expr("if(first, n, null)")).alias("most_first"),
        F.max(F.expr("if(first, n - place, null)")).alias("reach_first"))
    smaller = sides.where("least_first is not null").withColumn("band", F.explode(F.expr("array(band, band + 1)")))
    could = ("x.grp = y.grp and x.band = y.band and x.label <> y.label and y.most >= x.least_first and 4 * x.most_first >= 3 * y.least "
             "and least(x.reach_first, y.reach) >= ceil(3 * (x.least_first + greatest(x.least_first, y.least)) / 7)")
    tops = stage(
        smaller.alias("x").join(sides.alias("y"), F.expr(could))
        .select(F.expr("least(x.label, y.label) as a"), F.expr("greatest(x.label, y.label) as b")).distinct(),
        "tops")
    tops = stage(_compared(tops, docs, suffix_filter=False), "compared_tops")

    # Then their members, unless the components are too far apart by the triangle inequality.
    radius = members.groupBy("label").agg(F.max("far").alias("radius"), F.count_distinct("node").alias("size"))
    near = (
        tops.where(f"not ({LINKED})").select("a", "b", (1 - F.col("both") / F.col("either")).alias("d"))
        .join(radius.select(F.col("label").alias("a"), F.col("radius").alias("ra"), F.col("size").alias("sa")), "a")
        .join(radius.select(F.col("label").alias("b"), F.col("radius").alias("rb"), F.col("size").alias("sb")), "b")
        # Only two sole members that are the tops themselves are settled; a sole member need not be the top.
        .where("(sa > 1 or sb > 1 or ra > 0 or rb > 0) and d - ra - rb <= 0.25 + 1e-9")
        # From the smaller component to the larger, whose radius is at hand.
        .selectExpr("if(sa <= sb, a, b) as label", "if(sa <= sb, b, a) as other", "if(sa <= sb, rb, ra) as radius", "d")
    )
    near = stage(near, "near")
    here = (
        near.join(members, "label").where("d - far - radius <= 0.25 + 1e-9")
        .select("grp", "other", "label", "d", "node", "n", "place", "far", "first")
    )
    passes = ("x.grp = y.grp and x.other = y.label and if(x.n < y.n, x.first, if(x.n > y.n, y.first, x.first and y.first)) "
              "and 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n) "
              "and least(x.n - x.place, y.n - y.place) >= ceil(3 * (x.n + y.n) / 7) "
              "and d - x.far - y.far <= 0.25 + 1e-9 and not (x.node = x.label and y.node = y.label)")
    rest = here.alias("x").join(members.alias("y"), F.expr(passes)).select(F.expr("x.node as a"), F.expr("y.node as b")).distinct()
    rest = stage(_compared(stage(rest, "rest"), docs), "compared_rest")
    more = tops.union(rest).where(LINKED).select("a", "b")
    final = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))

    # Copies share the label of the smallest id that has their set.
    with_words = sets.where("n > 0 and doc_id is not null")
    tops_of_sets = with_words.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"))
    labelled = tops_of_sets.join(final, "node", "left").select("k1", "k2", "n", F.coalesce("label", "node").alias("component_id"))
    linked = with_words.join(labelled, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)
