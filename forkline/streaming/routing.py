"""Routing of arriving queries, monitoring of the routed stream, results as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forkline.operators.grade import newest
from forkline.operators.policy import RoutingPolicy, decide
from forkline.session import list_folders, remove_folders, stage


def decide_stream(arrivals: DataFrame, features: DataFrame, policy: RoutingPolicy) -> DataFrame:
    """Look up the features of each arriving ``query_id`` and decide.

    The same expressions as the batch job. The feature table is static; Spark
    broadcasts it when it is small and shuffles both sides when it is not.
    """
    joined = arrivals.join(features.select("query_id", *policy.columns()), "query_id", "left")
    return decide(joined, policy)


def hi_rate_windows(routed: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "10 minutes",
                    kappa: float = 1.0) -> DataFrame:
    """Share and cost of strong-model calls per time window.

    A row that comes when its window is already behind the watermark is dropped by the stream. As an endless stream
    use append mode, which emits closed windows; for a finite input see ``run_windows``.
    """
    cost = F.when(F.col("use_strong"), F.lit(kappa)).otherwise(0.0)
    ok = routed.filter(F.col("skip_reason").isNull()).withColumn(time, F.col(time).cast("timestamp"))
    return (
        ok.withWatermark(time, late)
        .groupBy(F.window(time, size).alias("_w"))
        .agg(F.count("*").alias("n"), F.count_if("use_strong").alias("n_hi"), F.sum(cost).alias("cost"))
        .select(
            F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n", "n_hi",
            (F.col("n_hi") / F.col("n")).alias("hi_rate"), "cost",
        )
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything that has arrived, write it exactly once to ``path``, and read it."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_windows(windows: DataFrame, path: str, checkpoint: str, key: str = "window_start") -> DataFrame:
    """Process everything that has arrived and return every window, those still open included.

    Each micro-batch stores the windows that it changed in its own folder; a repeated batch overwrites it. The latest
    state of a window is the valid one.
    """
    _run_windows(windows, path, checkpoint)
    log = windows.sparkSession.read.schema(f"{ddl(windows)}, batch long").parquet(path)
    return newest(log, (key,), "batch").select(*windows.columns)


def _run_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = windows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()
    query.awaitTermination()
    return query


ARRIVED = "arrived"
PROGRESS_KEPT = "spark.sql.streaming.numRecentProgressUpdates"


def counted_windows(routed: DataFrame, path: str, checkpoint: str, time: str = "ts", **options) -> tuple[DataFrame, dict[str, int]]:
    """Windows of everything that has arrived, as ``run_windows`` gives them, and what this run has read and left out.

    The rows are counted in the pass itself, by metrics observed before the windows: ``arrived``, ``skipped`` (no
    decision), ``untimed`` (no time) and ``counted`` (those offered to a window). What the watermark drops is
    ``counted`` over all runs less the rows in the windows.
    """
    spark = routed.sparkSession
    ok = F.col("skip_reason").isNull()
    seen = routed.withColumn(time, F.col(time).cast("timestamp")).observe(
        ARRIVED, F.count(F.lit(1)).alias("arrived"), F.count_if(~ok).alias("skipped"), F.count_if(ok & F.col(time).isNull()).alias("untimed"))
    windows = hi_rate_windows(seen, time, **options)
    before = spark.conf.get(PROGRESS_KEPT)
    spark.conf.set(PROGRESS_KEPT, str(2**30))  # the metrics of every batch of the run
    try:
        query = _run_windows(windows, path, checkpoint)
    finally:
        spark.conf.set(PROGRESS_KEPT, before)
    counts = dict.fromkeys(("arrived", "skipped", "untimed"), 0)
    for progress in query.recentProgress:
        if ARRIVED in progress["observedMetrics"]:
            row = progress["observedMetrics"][ARRIVED]
            for name in counts:
                counts[name] += row[name] or 0
    counts["counted"] = counts["arrived"] - counts["skipped"] - counts["untimed"]
    log = spark.read.schema(f"{ddl(windows)}, batch long").parquet(path)
    return newest(log, ("window_start",), "batch").select(*windows.columns), counts


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


KEYS = ("query_id", "role")


BUCKETS = 64  # of keys in a result store


def store_results(stream: DataFrame, path: str, checkpoint: str, version: str = "version", buckets: int = BUCKETS) -> None:
    """Keep the newest row per (query, role) of all that has arrived, in buckets of keys.

    A micro-batch reads and rewrites only the buckets it touches. Its rows go to a folder of its own; only when they are
    written do the touched buckets of earlier folders go. A batch that is repeated, or one that was cut short, leaves
    rows that the reader's rule (newest version, ties by the whole row) settles, and that the next touch removes: the
    store holds a row per key, not per batch. Ties of a version are settled by the values of all columns, the largest
    first, so the order in which rows arrive does not matter.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        arrived = stage(newest(batch, KEYS, version).withColumn("bucket", _bucket(buckets)), "arrived")
        touched = sorted(r["bucket"] for r in arrived.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return
        held = [f for f in _bucket_folders(spark, path, touched) if f"/batch={number}/" not in f]
        if held:
            old = spark.read.schema(batch.schema).parquet(*held).withColumn("bucket", _bucket(buckets))
            arrived = newest(arrived.unionByName(old), KEYS, version)
        arrived.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
        remove_folders(spark, held)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")


def _bucket_folders(spark: SparkSession, path: str, touched: list[int]) -> list[str]:
    found = list_folders(spark, f"{path}/batch=*/bucket=*")
    wanted = {f"bucket={b}" for b in touched}
    return [f for f in found if f.rsplit("/", 1)[1] in wanted]


def current_results(spark: SparkSession, path: str, schema: str, version: str = "version") -> DataFrame:
    """The newest row per (query, role) of a store."""
    empty = spark.createDataFrame([], schema)
    stored = list_folders(spark, f"{path}/batch=*")
    rows = spark.read.schema(schema).parquet(path).select(*empty.columns) if stored else empty
    return newest(rows, KEYS, version)
