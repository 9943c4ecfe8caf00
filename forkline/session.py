"""Session helpers: a local session for tests, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "forkline", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where neither that
    setting nor a checkpoint folder exists and the master is local (tests) is a
    temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="forkline-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


_made: list[str] = []  # paths given out in this process and not removed yet


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/forkline/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the intermediate tables that were stored inside.

    Results that read them must be written or collected before; scopes may be nested, one at a time in a process.
    """
    before = len(_made)
    try:
        yield
    finally:
        remove_folders(spark, _made[before:])
        del _made[before:]


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    """Spark has no call of its own that removes a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in map(hadoop.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def list_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern of folder names matches."""
    return [path for path, _ in list_files(spark, pattern)]


def list_files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Paths that a pattern of file names matches, each with its bytes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((f.getPath().toString(), f.getLen()) for f in found or [])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    Cuts the lineage durably: a lost executor costs a re-read, not a recompute,
    and every later branch sees the same rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Even out an input that has fewer partitions than the cluster has cores.

    A scan of many files is left as it is; only a few large files are shuffled,
    because heavy per-row work after them would run on a few cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def side_by_side(spark: SparkSession, jobs: list[Callable], parallel: int = 8) -> list:
    """Results of independent driver-side calls, each of which may start Spark jobs.

    The scheduler interleaves the jobs, so short ones do not wait for each other.
    """
    with ThreadPoolExecutor(parallel) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]
