"""A seeded, reproducible order of rows that never needs one global sort.

The order of a row is ``md5(seed:id)``, then the id. md5 is uniform, so its
first three hex digits cut any set into 4,096 near-equal slices. Counting the
slices tells where a position of the order falls; only the slice that contains
the position has to be ranked. All other rows are decided by comparing their
slice, without a shuffle.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forkline.session import stage

SLICE_DIGITS = 3  # 4,096 slices: the bound on everything collected or broadcast here, per group


def order_hash(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def with_order(df: DataFrame, seed: int, id_col: str = "query_id") -> DataFrame:
    return df.withColumn("_h", order_hash(F.col(id_col), seed)).withColumn(
        "_slice", F.substring("_h", 1, SLICE_DIGITS)
    )


def slice_counts(ordered: DataFrame) -> list[tuple[str, int, int]]:
    """(slice, rows before it, rows up to its end), in order; at most 4,096 entries."""
    rows = sorted((r["_slice"], r["n"]) for r in ordered.groupBy("_slice").agg(F.count("*").alias("n")).collect())
    ends = list(accumulate(n for _, n in rows))
    return [(s, end - n, end) for (s, n), end in zip(rows, ends)]


def cut_slice(counts: list[tuple[str, int, int]], position: int) -> tuple[str, int]:
    """The slice holding the ``position``-th row (1-based), and how many rows come before that slice."""
    for s, start, end in counts:
        if start < position <= end:
            return s, start
    return ("", 0) if position <= 0 else ("g", counts[-1][2] if counts else 0)  # "g" sorts after every hex digit


def label_ranges(ordered: DataFrame, counts: list[tuple[str, int, int]], ranges: list[tuple[str, int]],
                 id_col: str = "query_id", out: str = "split") -> DataFrame:
    """Give the first ``n1`` rows of the order the first label, the next ``n2`` the second, and so on.

    ``ranges`` is ``[(label, size), …]``; the last label takes all remaining
    rows whatever its size. Result: ``(id_col, out)``.
    """
    stops, total = [], 0
    for name, size in ranges[:-1]:
        total += size
        stops.append((name, total))
    cuts = [(name, stop, *cut_slice(counts, stop)) for name, stop in stops]
    starts = {s: start for _, _, s, start in cuts}
    border = sorted(s for s in starts if s)
    last = ranges[-1][0]

    def decide(value: Column, bounds) -> Column:
        expr = None
        for name, bound in bounds:
            cond = value <= F.lit(bound)
            expr = F.when(cond, name) if expr is None else expr.when(cond, name)
        return F.lit(last) if expr is None else expr.otherwise(last)

    # A row of a slice that holds no stop is decided by its slice alone.
    inner = ordered.filter(~F.col("_slice").isin(border)) if border else ordered
    inner = inner.select(id_col, decide(F.col("_slice"), [(n, s) for n, _, s, _ in cuts]).alias(out))
    if not border:
        return inner
    before = F.create_map(*[x for s in border for x in (F.lit(s), F.lit(starts[s]))])
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_h", id_col)) + before[F.col("_slice")]
    edge = ordered.filter(F.col("_slice").isin(border)).select(
        id_col, decide(rank, [(n, stop) for n, stop, _, _ in cuts]).alias(out)
    )
    return inner.unionByName(edge)


def first_in_order(df: DataFrame, n: int, seed: int, id_col: str = "query_id") -> DataFrame:
    """Ids of the first ``n`` rows of the seeded order."""
    ordered = with_order(df.select(id_col), seed, id_col)
    labelled = label_ranges(ordered, slice_counts(ordered), [("in", n), ("out", 0)], id_col, "_part")
    return labelled.filter(F.col("_part") == "in").select(id_col)


def group_rank(df: DataFrame, group: str, seed: int, id_col: str = "query_id", out: str = "rank") -> DataFrame:
    """1-based position of each row inside its group's seeded order.

    A group may hold any share of the rows: the window runs per (group, slice)
    and the rows before a slice come from the slice counts. ``group`` must have
    few values (a label, a stratum).
    """
    ordered = with_order(df, seed, id_col)
    counts = ordered.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        F.col(group).alias("_g"),
        F.col("_slice").alias("_s"),
        (F.sum("_n").over(Window.partitionBy(group).orderBy("_slice")) - F.col("_n")).alias("_before"),
    )
    local = F.row_number().over(Window.partitionBy(group, "_slice").orderBy("_h", id_col))
    # Stored, its size is known, and Spark broadcasts it only if it is small.
    offsets = stage(offsets, "slice-offsets")
    return (
        ordered.withColumn("_local", local)
        .join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_g", "_s", "_before", "_local", "_h", "_slice")
    )


def first_per_group(df: DataFrame, group: str, quotas: DataFrame, seed: int, id_col: str = "query_id") -> DataFrame:
    """Ids of the first ``quota`` rows of every group's seeded order.

    ``quotas`` is ``(group, quota)``. One row per group says in which slice its
    quota ends; rows of other slices are kept or dropped without ranking.
    """
    ordered = with_order(df.select(id_col, group), seed, id_col)
    counts = ordered.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_slice"))
    # The last slice that begins before the quota is filled: earlier slices are
    # kept whole, later ones dropped, this one ranked.
    cuts = (
        counts.withColumn("_start", upto - F.col("_n"))
        .join(quotas, group)
        .filter(F.col("_start") < F.col("quota"))
        .groupBy(group)
        .agg(F.max(F.struct("_slice", "_start", "quota")).alias("_cut"))
        .select(group, F.col("_cut._slice").alias("_cs"), (F.col("_cut.quota") - F.col("_cut._start")).alias("_left"))
    )
    # One row per group. Stored, its size is known: when it is small the corpus
    # side is not shuffled, so a group with a third of the rows is no hot key.
    near = ordered.join(stage(cuts, "group-cuts"), group).filter(F.col("_slice") <= F.col("_cs"))
    whole = near.filter(F.col("_slice") < F.col("_cs")).select(id_col, group)
    edge = (
        near.filter(F.col("_slice") == F.col("_cs"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_h", id_col)))
        .filter(F.col("_rank") <= F.col("_left"))
        .select(id_col, group)
    )
    return whole.unionByName(edge)
