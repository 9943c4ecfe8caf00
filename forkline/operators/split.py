"""Selection holdout, test and calibration parts, and the checks around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.operators.hash_order import first_in_order, group_rank, label_ranges, slice_counts, with_order
from forkline.schemas import CALIB, CV_FOLDS, HOLDOUT, SEED, TEST
from forkline.session import stage


# Method names.
SPLIT_METHOD = "split_dataset"
METHOD_ALIASES = {"random_split": SPLIT_METHOD}


@dataclass(frozen=True)
class SplitRule:
    """Sizes of the parts. ``test_n`` overrides the fraction rule."""

    holdout_n: int = 150
    test_fraction: float = 0.20
    test_min: int = 150
    test_max: int = 1000
    test_n: int | None = None
    seed: int = SEED
    method: str = SPLIT_METHOD

    @classmethod
    def from_config(cls, cfg: dict) -> SplitRule:
        """Read a plain mapping, including the older ``pilot`` and ``eval``/``test`` sections."""
        pilot = cfg.get("pilot") or {}
        holdout = cfg.get("selection_holdout_n", pilot.get("selection_holdout_n", pilot.get("selection_n")))
        if holdout is None:
            if "pilot" not in cfg:
                raise KeyError("selection_holdout_n required")
            holdout = 150
        nested = next((cfg[k] for k in ("eval", "test") if isinstance(cfg.get(k), dict)), {})
        test_n = cfg.get("test_n")
        if test_n is None and "test_fraction" not in cfg:
            if "test_n" not in nested:
                raise KeyError("test_fraction or test_n required")
            test_n = nested["test_n"]
        return cls(
            holdout_n=int(holdout),
            test_fraction=float(cfg.get("test_fraction", 0.20)),
            test_min=int(cfg.get("test_min", 150)),
            test_max=int(cfg.get("test_max", 1000)),
            test_n=None if test_n is None else int(test_n),
            seed=int(cfg.get("seed", SEED)),
            method=cfg.get("method", SPLIT_METHOD),
        )

    def holdout_size(self, corpus_n: int) -> int:
        if self.holdout_n >= corpus_n:
            raise ValueError(f"{corpus_n} queries are too few for a holdout of {self.holdout_n}")
        return self.holdout_n

    def test_size(self, pool_n: int) -> int:
        if self.test_n is not None:
            return self.test_n
        size = min(max(round(self.test_fraction * pool_n), self.test_min), self.test_max)
        if size >= pool_n:
            raise ValueError(f"{pool_n} queries are too few for a test part of {size}")
        return size


def assign(queries: DataFrame, rule: SplitRule = SplitRule()) -> DataFrame:
    """``(query_id, split)``: the holdout, then the test part, then calibration, in seeded order."""
    if METHOD_ALIASES.get(rule.method, rule.method) != SPLIT_METHOD:
        raise ValueError(f"unknown split method {rule.method!r}")
    ordered = with_order(queries.select("query_id"), rule.seed)
    counts = slice_counts(ordered)
    n = counts[-1][2] if counts else 0
    holdout = rule.holdout_size(n)
    test = rule.test_size(n - holdout)
    return label_ranges(ordered, counts, [(HOLDOUT, holdout), (TEST, test), (CALIB, 0)])


def holdout_only(queries: DataFrame, rule: SplitRule = SplitRule()) -> DataFrame:
    ordered = with_order(queries.select("query_id"), rule.seed)
    counts = slice_counts(ordered)
    n = rule.holdout_size(counts[-1][2] if counts else 0)
    parts = label_ranges(ordered, counts, [(HOLDOUT, n), ("rest", 0)])
    return parts.filter(F.col("split") == HOLDOUT)


def violations(queries: DataFrame, splits: DataFrame) -> DataFrame:
    """One row of counts, all zero for a sound partition.

    Repeated ids, ids outside the corpus, queries in no part, and parts that are empty.
    """
    sides = queries.select("query_id", F.lit(1).alias("_q"), F.lit(None).cast("string").alias("split")).unionByName(
        splits.select("query_id", F.lit(0).alias("_q"), "split")
    )
    per_id = sides.groupBy("query_id").agg(
        F.max("_q").alias("_in_corpus"), F.count("split").alias("_parts")
    )
    found = per_id.agg(
        F.count_if(F.col("_parts") > 1).alias("n_in_two_parts"),
        F.count_if(F.col("_in_corpus") == 0).alias("n_unknown"),
        F.count_if(F.col("_parts") == 0).alias("n_uncovered"),
    )
    empty = splits.agg(
        *[
            (F.count_if(F.col("split") == s) == 0).cast("int").alias(f"_{i}")
            for i, s in enumerate((HOLDOUT, CALIB, TEST))
        ]
    ).select((F.col("_0") + F.col("_1") + F.col("_2")).alias("n_empty_parts"))
    return found.withColumn("n_empty_parts", empty.scalar())


def require_sound(queries: DataFrame, splits: DataFrame) -> None:
    row = violations(queries, splits).first().asDict()
    if any(row.values()):
        raise ValueError(f"unsound partition: {row}")


def holdout_faults(queries: DataFrame, holdout: DataFrame) -> DataFrame:
    """``query_id, reason`` of holdout ids that are there twice or more, or not in the corpus; one aggregation."""
    sides = holdout.select("query_id", F.lit(1).alias("_h"), F.lit(0).alias("_q")).unionByName(
        queries.select("query_id", F.lit(0).alias("_h"), F.lit(1).alias("_q")))
    held = sides.groupBy("query_id").agg(F.sum("_h").alias("_h"), F.max("_q").alias("_q")).filter("_h > 0")
    reason = F.when(F.col("_q") == 0, "outside the corpus").when(F.col("_h") > 1, "twice")
    return held.select("query_id", reason.alias("reason")).filter("reason is not null")


def require_holdout(queries: DataFrame, holdout: DataFrame) -> None:
    """No id twice, every id in the corpus."""
    bad = holdout_faults(queries, holdout).orderBy("query_id").limit(1).collect()
    if bad:
        raise ValueError(f"holdout: {bad[0]['query_id']!r} is {bad[0]['reason']}")


def eval_ids(splits: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Ids of calibration and test. Asking for a holdout or unknown id is an error."""
    open_ids = splits.filter(F.col("split").isin(CALIB, TEST))
    if wanted is None:
        return open_ids
    leaked = leaks(splits, wanted).limit(1).collect()
    if leaked:
        raise ValueError(f"{leaked[0]['query_id']!r}: {leaked[0]['reason']}")
    return open_ids.join(wanted.select("query_id"), "query_id", "left_semi")


def eval_rows(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of a sound partition outside the holdout.

    The holdout has a fixed small size, so leaving it out is a broadcast; joining
    the two large parts instead would shuffle the texts. Stored, its size is known:
    a filter on the parts is taken for as large as all of them.
    """
    held = stage(splits.filter(F.col("split") == HOLDOUT).select("query_id"), "holdout-ids")
    return rows.join(held, "query_id", "left_anti")


def leaks(splits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ids that must not be used for fitting or evaluation, with the reason."""
    return (
        wanted.select("query_id")
        .join(splits, "query_id", "left")
        .filter(F.col("split").isNull() | (F.col("split") == HOLDOUT))
        .select("query_id", F.when(F.col("split").isNull(), "unknown").otherwise("holdout").alias("reason"))
    )


def select_split(queries: DataFrame, splits: DataFrame, split: str, limit: int | None = None,
                 seed: int = SEED) -> DataFrame:
    """Rows of one part; an id without a row is an error; ``limit`` takes the first in seeded order."""
    ids = splits.filter(F.col("split") == split).select("query_id")
    if ids.join(queries, "query_id", "left_anti").limit(1).collect():
        raise ValueError(f"part {split!r} names an id outside the corpus")
    if limit is not None:
        ids = first_in_order(ids, limit, seed)
    return queries.join(ids, "query_id", "left_semi")


def folds(labels: DataFrame, k: int = CV_FOLDS, seed: int = SEED, label: str = "r") -> DataFrame:
    """Stratified folds: rows of each class are dealt out in seeded order. Adds ``fold``."""
    ranked = group_rank(labels, label, seed, out="_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def frozen_or_new(spark: SparkSession, path: str, queries: DataFrame, rule: SplitRule = SplitRule(),
                  force: bool = False) -> DataFrame:
    """Reuse the parts stored at ``path`` after checking them again; otherwise make and store them."""
    from forkline.sources.tables import path_exists, read_splits, write_splits

    if not force and path_exists(spark, path):
        splits = read_splits(spark, path)
        require_sound(queries, splits)
        return splits
    write_splits(assign(queries, rule), path, queries)
    return read_splits(spark, path)


def manifest(splits: DataFrame) -> DataFrame:
    """``split, n, digest``: what is stored of each part, without regard to files or order."""
    return splits.groupBy("split").agg(
        F.count("*").alias("n"), F.expr("cast(sum(cast(xxhash64(query_id) as decimal(38, 0))) as string)").alias("digest"))


def extend_parts(spark: SparkSession, path: str, queries: DataFrame, rule: SplitRule = SplitRule()) -> DataFrame:
    """Parts at ``path`` with the queries that are new since they were frozen; no id that has a part moves.

    The first call freezes the parts of ``assign``. Later ones check what is stored against its manifest, then give each
    new id to the test part if its seeded place in [0, 1) is below the rule's test fraction, else to calibration; the
    holdout stays as it was. Only new ids are written: as files beside the old ones in the folders of their parts.
    The manifest is written last; a call that was cut short leaves rows that the next call finds unlisted and refuses.
    """
    from forkline.sources.tables import path_exists, read_splits

    listed = f"{path}/_manifest"
    if not path_exists(spark, listed):
        assign(queries, rule).write.mode("overwrite").partitionBy("split").parquet(f"{path}/parts")
    else:
        frozen = read_splits(spark, f"{path}/parts")
        stored = spark.read.parquet(listed)
        if not manifest(frozen).exceptAll(stored.select("split", "n", "digest")).isEmpty():
            raise ValueError("the frozen parts are not those of their manifest")
        gone = frozen.join(queries, "query_id", "left_anti").limit(1).collect()
        if gone:
            raise ValueError(f"{gone[0]['query_id']!r} has a part but is not in the corpus")
        place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{rule.seed}:"), "query_id")), 1, 12), 16, 10).cast("double") / float(16**12)
        new = queries.select("query_id").join(frozen, "query_id", "left_anti").select(
            "query_id", F.when(place < rule.test_fraction, TEST).otherwise(CALIB).alias("split"))
        new.write.mode("append").partitionBy("split").parquet(f"{path}/parts")
    now = read_splits(spark, f"{path}/parts")
    manifest(now).coalesce(1).write.mode("overwrite").parquet(listed)
    return now
