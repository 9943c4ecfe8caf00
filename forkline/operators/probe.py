"""Cross-validated linear probes: how much a block of signals says jointly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.operators.hash_order import group_rank
from forkline.operators.newton import Task, fit_many, left_out_probabilities
from forkline.operators.rank_metrics import BLOCK_VALUES, metrics_by_key
from forkline.operators.table import number
from forkline.schemas import CV_FOLDS, FAMILY_BLOCKS, SEED
from forkline.session import stage


def probe_rows(table: DataFrame, blocks, k: int, seed: int) -> tuple[DataFrame, list[str]]:
    """``x, y, folds`` of all blocks at once, and the order of the columns in ``x``.

    The rows of each class where a block is complete are dealt out in seeded order, for all blocks in one ranking of
    narrow rows (id, block and class); -1 where the block is not complete.
    """
    columns = list(dict.fromkeys(c for _, _, cols in blocks for c in cols))
    wide = table.select("query_id", F.col("r").cast("int").alias("y"), *[number(c, table).alias(c) for c in columns])
    complete = F.array(*[F.when(F.coalesce(*[F.when(F.col(c).isNull(), 1) for c in cols], F.lit(0)) == 0, b)
                         for b, (_, _, cols) in enumerate(blocks)])
    dealt = wide.filter(F.col("y").isNotNull()).select("query_id", "y", F.explode(F.array_compact(complete)).alias("block"))
    dealt = dealt.withColumn("deck", F.concat_ws(":", "block", "y"))
    ranked = group_rank(dealt, "deck", seed, out="place").select(
        "query_id", "block", F.pmod(F.col("place") - 1, F.lit(k)).cast("int").alias("fold"))
    folds = ranked.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("block", "fold"))).alias("fold_of"))
    at = F.array(*[F.coalesce(F.try_element_at("fold_of", F.lit(b)), F.lit(-1)) for b in range(len(blocks))])
    x = F.array(*[F.coalesce(F.col(c), F.lit(float("nan"))) for c in columns])
    return stage(wide.join(folds, "query_id").select(x.alias("x"), "y", at.alias("folds")), "probe-rows"), columns


def linear_probes(table: DataFrame, blocks=FAMILY_BLOCKS, k: int = CV_FOLDS, seed: int = SEED,
                  block_values: int = BLOCK_VALUES) -> DataFrame:
    """Mean and deviation over folds of AUROC and average precision, per block.

    Works on the rows where the whole block is present. A block with fewer than two rows per fold is left out, and a
    fold whose training rows hold one class only. All fits of all blocks are made together, by rounds over one stored
    table. ``table`` should be a stored table; its ids should be unique.
    """
    spark = table.sparkSession
    schema = (
        "family string, block string, n_features int, cv_folds int, cv_auroc_mean double, cv_auroc_std double, "
        "cv_auprc_mean double, cv_auprc_std double"
    )
    classes = table.agg(F.count_if(F.col("r") == 1).alias("p"), F.count_if(F.col("r") == 0).alias("n")).first()
    k = min(k, classes["p"], classes["n"])
    if k < 2:
        return spark.createDataFrame([], schema)
    rows, columns = probe_rows(table, blocks, k, seed)
    sizes = rows.agg(*[F.count_if(F.get("folds", F.lit(b)) >= 0) for b in range(len(blocks))]).first()
    tasks, names = [], []
    for b, (family, block, cols) in enumerate(blocks):
        if sizes[b] >= 2 * k:
            tasks += [Task(b, tuple(columns.index(c) for c in cols), fold) for fold in range(k)]
            names += [f"{family}|{block}|{len(cols)}|{fold}" for fold in range(k)]
    fits = fit_many(rows, tasks)
    if not any(fits):
        return spark.createDataFrame([], schema)
    every = stage(left_out_probabilities(rows, tasks, fits, names), "probe-scores")
    scores = metrics_by_key(every, ["prob"], ("y",), key="key", by="key", min_n=1, block_values=block_values).filter(F.col("auroc").isNotNull())
    part = F.split("key", r"\|")
    return (
        scores.select(
            part[0].alias("family"), part[1].alias("block"), part[2].cast("int").alias("n_features"), "auroc", "auprc"
        )
        .groupBy("family", "block", "n_features")
        .agg(
            F.avg("auroc").alias("cv_auroc_mean"), F.stddev_pop("auroc").alias("cv_auroc_std"),
            F.avg("auprc").alias("cv_auprc_mean"), F.stddev_pop("auprc").alias("cv_auprc_std"),
        )
        .withColumn("cv_folds", F.lit(int(k)))
        .select("family", "block", "n_features", "cv_folds", "cv_auroc_mean", "cv_auroc_std", "cv_auprc_mean", "cv_auprc_std")
    )
