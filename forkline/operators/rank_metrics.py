"""Exact ranking metrics for many features and binary targets at once.

All metrics come from one table of distinct values: per (feature, value) how many rows and how many positives each
target has. Equal values are merged in the map task, before anything is ordered, so a value that holds a third of the
rows is a row per batch. One range exchange by (feature, value) deals the merged values out; sorted partitions are packed
into blocks with their totals, and running totals over the blocks carry what lies before across their borders. A second
pass over the stored blocks gives every value its place. No feature is ordered in one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forkline.operators.table import number
from forkline.schemas import FAMILY_BLOCKS, dotted
from forkline.session import stage

TARGETS = ("r", "y_lo", "y_hi")
BLOCK_VALUES = 100_000


def _counts(targets: tuple[str, ...]) -> list[str]:
    return [f"{c}_{t}" for t in targets for c in ("n", "p")]


def _merged(wide: DataFrame, features: list[str], names: list[str], targets: tuple[str, ...], by: str | None) -> DataFrame:
    """``key, value`` and counts, one row per different value of a batch; the key is the feature's name, or column ``by``."""
    columns, width, n_targets = ["key", "value", *_counts(targets)], len(features), len(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A target is 1, 0 or missing.
            known = [batch.column(width + j).to_numpy(zero_copy_only=False).astype(np.float64) for j in range(n_targets)]
            keys = batch.column(width + n_targets).dictionary_encode() if by else None
            for i, name in enumerate(names):
                v = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
                used = ~np.isnan(v)
                if not used.any():
                    continue
                if keys is None:
                    values, which = np.unique(v[used] + 0.0, return_inverse=True)  # + 0.0: the two zeros are one value
                    key = pa.array([name] * len(values))
                else:
                    code = keys.indices.to_numpy(zero_copy_only=False)[used]
                    pairs = np.empty(len(code), [("k", np.int64), ("v", np.float64)])
                    pairs["k"], pairs["v"] = code, v[used] + 0.0
                    different, which = np.unique(pairs, return_inverse=True)
                    values, key = different["v"], keys.dictionary.take(pa.array(different["k"]))
                made = []
                for t in known:
                    t = t[used]
                    made.append(np.bincount(which, ~np.isnan(t), len(values)))
                    made.append(np.bincount(which, np.nan_to_num(t), len(values)))
                yield pa.RecordBatch.from_arrays(
                    [key.cast(pa.string()), pa.array(values), *(pa.array(x.astype(np.int64)) for x in made)], names=columns)

    source = wide.select(
        *[number(f, wide).cast("double").alias(f"v{i}") for i, f in enumerate(features)],
        *[F.col(t).cast("double").alias(f"t{j}") for j, t in enumerate(targets)], *([F.col(by).cast("string").alias("by")] if by else []))
    return source.mapInArrow(run, ", ".join(["key string", "value double", *(f"{c} bigint" for c in _counts(targets))]))


def _packer(counts: list[str], most: int) -> Callable:
    """Sorted rows to blocks: key, first value, size, totals, and the values with their counts as one binary cell."""
    names = ["key", "low", "high", "size", *counts, "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (keys, values, counts) of different values; the last of them may go on in the next batch

        def blocks(part: list[tuple]) -> Iterator[pa.RecordBatch]:
            keys, values, sums = (np.concatenate(x) for x in zip(*part, strict=True))
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for a, b in itertools.pairwise([0, *edges.tolist(), len(keys)]):
                for c in range(a, b, most):
                    d = min(b, c + most)
                    cell = b"".join([values[c:d].tobytes(), *(np.ascontiguousarray(sums[c:d, k]).tobytes() for k in range(len(counts)))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[c]], pa.string()), pa.array([values[c]]), pa.array([values[d - 1]]), pa.array([d - c], pa.int64()),
                         *(pa.array([int(x)], pa.int64()) for x in sums[c:d].sum(0)), pa.array([cell], pa.binary())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist(), object)
            values = batch.column(1).to_numpy(zero_copy_only=False)
            sums = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(counts))], axis=1)
            if held:
                before = held[-1]
                keys, values, sums = (np.concatenate([x[-1:], y]) for x, y in zip(before, (keys, values, sums), strict=True))
                held[-1] = tuple(x[:-1] for x in before)
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])])
            held.append((keys[new], values[new], np.add.reduceat(sums, new, axis=0)))
            if sum(len(x[0]) for x in held) > 2 * most:
                last = tuple(x[-1:] for x in held[-1])
                held[-1] = tuple(x[:-1] for x in held[-1])
                yield from blocks(held)
                held = [last]
        if held:
            yield from blocks(held)

    return run


def _places(targets: tuple[str, ...], counts: list[str]) -> Callable:
    """What each block adds to the metrics, once the totals before it and of all blocks are known."""
    out = [f"{c}_{t}" for t in targets for c in ("rank", "ap", "ties", "vp", "vn")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[float]] = []
            whole = batch.to_pydict()
            for i, cell in enumerate(whole["cell"]):
                size = whole["size"][i]
                values = np.frombuffer(cell, np.float64, size)
                sums = np.frombuffer(cell, np.int64, size * len(counts), 8 * size).reshape(len(counts), size).astype(np.float64)
                row: list[float] = []
                for j, t in enumerate(targets):
                    n, p = sums[2 * j], sums[2 * j + 1]
                    upto_n, upto_p = whole[f"before_n_{t}"][i] + np.cumsum(n), whole[f"before_p_{t}"][i] + np.cumsum(p)
                    rank = upto_n - n + (n + 1) / 2
                    hits, seen = whole[f"all_p_{t}"][i] - upto_p + p, whole[f"all_n_{t}"][i] - upto_n + n
                    some = p > 0
                    row += [float(x) for x in (
                        (p * rank).sum(), (p[some] * hits[some] / seen[some]).sum(), (n * n * n - n).sum(), (values * p).sum(), (values * (n - p)).sum())]
                rows.append(row)
            made = np.array(rows).reshape(-1, len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[:, k]) for k in range(len(out)))], names=["key", *out])

    return run


def metrics_by_key(wide: DataFrame, features: list[str], targets: tuple[str, ...], *, key: str = "feature", by: str | None = None,
                   min_n: int = 5, block_values: int = BLOCK_VALUES) -> DataFrame:
    """One row per (key, target). Keys are the features, or the values of ``by`` for a single feature; there are few."""
    counts = _counts(targets)
    merged = _merged(wide, features, [dotted(f) for f in features], targets, by)
    dealt = merged.repartitionByRange("key", "value").sortWithinPartitions("key", "value")
    sums = ", ".join(f"{c} bigint" for c in counts)
    blocks = stage(dealt.mapInArrow(
        _packer(counts, block_values), f"key string, low double, high double, size bigint, {sums}, cell binary"), "value-blocks")
    before, whole = Window.partitionBy("key").orderBy("low"), Window.partitionBy("key")  # over the blocks' totals only
    totals = blocks.select("key", "low", *counts).select(
        F.col("key").alias("_k"), F.col("low").alias("_l"),
        *[(F.sum(c).over(before) - F.col(c)).alias(f"before_{c}") for c in counts], *[F.sum(c).over(whole).alias(f"all_{c}") for c in counts])
    # A row of counts per block: stored, its size is known, and where it is small the blocks' cells are not shuffled again.
    totals = stage(totals, "block-offsets")
    placed = blocks.select("key", "low", "size", "cell").join(totals, (F.col("key") == F.col("_k")) & (F.col("low") == F.col("_l")))
    names = [f"{c}_{t}" for t in targets for c in ("rank", "ap", "ties", "vp", "vn")]
    added = placed.drop("_k", "_l", "low").mapInArrow(_places(targets, counts), ", ".join(["key string", *(f"{c} double" for c in names)]))
    per_key = added.groupBy("key").agg(*[F.sum(c).alias(c) for c in names]).join(
        blocks.groupBy("key").agg(F.min("low").alias("lowest"), F.max("high").alias("highest"), *[F.sum(c).alias(c) for c in counts]), "key")
    items = [
        F.struct(F.lit(t).alias("target"), *[F.col(f"{c}_{t}").alias(c) for c in ("n", "p", "rank", "ap", "ties", "vp", "vn")])
        for t in targets
    ]
    flat = per_key.select(F.col("key").alias(key), "lowest", "highest", F.inline(F.array(*items))).filter(F.col("n") >= min_n)
    return _finish(flat, key)


def _finish(flat: DataFrame, key: str) -> DataFrame:
    n, p = F.col("n").cast("double"), F.col("p").cast("double")
    neg = n - p
    two_classes = (p > 0) & (neg > 0)
    constant = F.col("lowest") == F.col("highest")
    spread = (n * n * n - n - F.col("ties")) / 12
    rho = (F.col("rank") - p * (n + 1) / 2) / F.sqrt(spread * p * neg / n)
    spearman = F.when(two_classes & ~constant, rho)
    mean_pos = F.when(p > 0, F.when(constant, F.col("lowest")).otherwise(F.col("vp") / p))
    mean_neg = F.when(neg > 0, F.when(constant, F.col("lowest")).otherwise(F.col("vn") / neg))
    out = flat.select(
        key,
        "target",
        F.col("n").cast("long").alias("n"),
        F.col("p").cast("long").alias("n_pos"),
        (F.col("n") - F.col("p")).cast("long").alias("n_neg"),
        mean_pos.alias("mean_positive"),
        mean_neg.alias("mean_negative"),
        F.when(two_classes, (F.col("rank") - p * (p + 1) / 2) / (p * neg)).alias("auroc"),
        F.when(two_classes, F.col("ap") / p).alias("auprc"),
        spearman.alias("spearman"),
    )
    direction = (
        F.when(F.col("auroc").isNull(), F.lit(None).cast("string"))
        .when(F.col("mean_positive") > F.col("mean_negative"), "positive")
        .when(F.col("mean_positive") < F.col("mean_negative"), "negative")
        .when(F.col("spearman") > 0, "positive")
        .when(F.col("spearman") < 0, "negative")
    )
    return out.withColumn("direction", direction)


def univariates(table: DataFrame, features: list[str] | tuple[str, ...], targets: tuple[str, ...] = TARGETS,
                block_values: int = BLOCK_VALUES, min_n: int = 5) -> DataFrame:
    """AUROC, average precision, Spearman and direction of every feature against every target.

    ``table`` is read twice: once to sample the ranges, once to deal the values out. Pass a stored table.
    """
    found = metrics_by_key(table, list(features), targets, min_n=min_n, block_values=block_values)
    return found.withColumn("family", F.substring_index("feature", ".", 1))


def blocks_table(spark, blocks=FAMILY_BLOCKS) -> DataFrame:
    """``(family, block, feature)``: which features make up which block."""
    return spark.createDataFrame(
        [(fam, block, dotted(c)) for fam, block, cols in blocks for c in cols],
        "family string, block string, feature string",
    )


def family_summary(scores: DataFrame, blocks=FAMILY_BLOCKS) -> DataFrame:
    """Distribution of the AUROCs inside each block, per target. At most a few hundred input rows."""
    a = F.col("auroc")
    members = F.broadcast(blocks_table(scores.sparkSession, blocks))
    grouped = (
        scores.drop("family").filter(a.isNotNull()).join(members, "feature")
        .groupBy("target", "family", "block")
        .agg(
            F.count("*").alias("n_features"),
            F.avg(a).alias("mean_auroc"),
            F.stddev_pop(a).alias("std_auroc"),
            F.min(a).alias("min_auroc"),
            F.max(a).alias("max_auroc"),
            F.percentile(a, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        )
    )
    q = F.col("_q")
    return grouped.withColumns(
        {"q25_auroc": q[0], "median_auroc": q[1], "q75_auroc": q[2], "iqr_auroc": q[2] - q[0]}
    ).drop("_q")


def feature_variance(table: DataFrame, features: list[str] | tuple[str, ...]) -> DataFrame:
    """n, population variance and deviation, extremes per feature; features with fewer than two values are left out.

    One aggregate with one set of columns per feature: nothing but a single row is shuffled per task.
    """
    names = ("n", "variance", "std", "min", "max")
    fns = (F.count, F.var_pop, F.stddev_pop, F.min, F.max)
    wide = table.select(*[number(f, table).alias(f) for f in features])
    row = wide.agg(*[F.struct(*[fn(f).alias(k) for k, fn in zip(names, fns)]).alias(f) for f in features])
    items = [
        F.struct(F.lit(dotted(f)).alias("feature"), *[F.col(f"`{f}`.{k}").alias(k) for k in names]) for f in features
    ]
    return (
        row.select(F.inline(F.array(*items)))
        .filter(F.col("n") >= 2)
        .withColumn("family", F.substring_index("feature", ".", 1))
    )
