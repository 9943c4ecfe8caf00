from pyspark.sql import functions as F

from forkline.operators import policy
from forkline.plans import workload as W
from forkline.streaming import routing


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:00:00", f"q{i % 7}") for i in range(60)]
    spark.createDataFrame(rows, "event_id int, ts string, query_id string").repartition(3).write.parquet(f"{tmp_path}/in")
    feats = spark.createDataFrame(
        [(f"q{i}", i / 6, i / 7, i / 8, float(i)) for i in range(6)],
        "query_id string, psi__entropy double, psi__margin double, psi__msp double, psi__top_probability_ratio double",
    )
    stream = spark.readStream.schema("event_id int, ts string, query_id string").parquet(f"{tmp_path}/in")
    live = routing.decide_stream(stream, feats, W.FIXED_POLICY).select("event_id", "score", "model", "skip_reason")
    got = routing.run_to_table(live, f"{tmp_path}/out", f"{tmp_path}/state").collect()
    batch = spark.read.parquet(f"{tmp_path}/in").join(feats, "query_id", "left")
    want = policy.decide(batch, W.FIXED_POLICY).select("event_id", "score", "model", "skip_reason").collect()
    assert sorted(got) == sorted(want) and len(got) == 60
    again = routing.run_to_table(live, f"{tmp_path}/out", f"{tmp_path}/state")
    assert again.count() == 60


def test_windows_close_at_the_watermark(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", True), ("2024-01-01 00:50:00", False), ("2024-01-01 01:10:00", True), ("2024-01-01 02:05:00", True)]
    df = spark.createDataFrame(rows, "ts string, use_strong boolean").withColumn("skip_reason", F.lit(None).cast("string"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in").withColumn("ts", F.to_timestamp("ts"))
    out = routing.hi_rate_windows(stream, kappa=3.0)
    got = routing.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/state").collect()
    # 01:00-02:00 ends at 02:00, after the watermark of 01:55: it is still open.
    assert [(r["n"], r["n_hi"], r["hi_rate"], r["cost"]) for r in got] == [(2, 1, 0.5, 3.0)]


def test_all_windows_of_a_finite_run(spark, tmp_path):
    """Several micro-batches give what one batch job gives; rows come in order of time."""
    hours = [f"2024-01-01 {i // 4:02d}:{15 * (i % 4):02d}:00" for i in range(40)]
    rows = [(ts, i % 3 == 0, None) for i, ts in enumerate(hours)]
    ddl = "ts string, use_strong boolean, skip_reason string"
    for i in range(0, 40, 10):
        spark.createDataFrame(rows[i : i + 10], ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = routing.hi_rate_windows(files.withColumn("ts", F.to_timestamp("ts")), kappa=3.0)
    got = routing.run_windows(out, f"{tmp_path}/out", f"{tmp_path}/state")
    once = spark.createDataFrame(rows, ddl).withColumn("ts", F.to_timestamp("ts"))
    assert sorted(got.collect()) == sorted(routing.hi_rate_windows(once, kappa=3.0).collect())
    assert got.count() == 10 and spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() > 1


def test_late_rows_and_windows_add_up(spark, tmp_path):
    """Every row read is in a window, without a decision, without a time, or too late; counted in the pass itself."""
    ddl = "ts string, use_strong boolean, skip_reason string"
    src, windows, state = (f"{tmp_path}/{x}" for x in ("in", "windows", "state"))
    first = [(f"2024-01-01 {h:02d}:{m:02d}:00", m % 2 == 0, None) for h in range(6) for m in range(0, 60, 7)] + [(None, True, None)]
    again = [("2024-01-01 00:30:00", True, None)] * 4 + [("2024-01-01 05:59:00", False, None), ("2024-01-01 00:10:00", None, "missing x")]
    total, made = {}, None
    for rows in (first, again, again):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        made, counts = routing.counted_windows(spark.readStream.schema(ddl).parquet(src), windows, state)
        total = {k: total.get(k, 0) + v for k, v in counts.items()}
    inside = made.groupBy().sum("n").first()[0]
    assert total == {"arrived": len(first) + 12, "skipped": 2, "untimed": 1, "counted": len(first) - 1 + 10}
    assert inside == len(first) - 1 + 2 and total["counted"] - inside == 8  # all rows of the first hour are too late


def test_result_store_keeps_one_row_per_key(spark, tmp_path):
    """Many micro-batches, versions out of order and tied; the store stays as large as its keys, and equals one batch job."""
    ddl = "query_id string, role string, version int, v int"
    src, store, state = (f"{tmp_path}/{x}" for x in ("in", "store", "state"))
    rows = [(f"q{i % 17}", ("M_lo", "M_hi")[i % 2], i * 7 % 50, i) for i in range(200)]
    for i in range(0, 200, 40):
        spark.createDataFrame(rows[i : i + 40], ddl).coalesce(1).write.mode("append").parquet(src)
        if i in (80, 160):
            files = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
            routing.store_results(files, store, state, buckets=8)
    best = {}
    for q, r, version, v in rows:
        best[q, r] = max(best.get((q, r), (-1, -1)), (version, v))
    assert {(r["query_id"], r["role"]): (r["version"], r["v"]) for r in routing.current_results(spark, store, ddl).collect()} == best
    assert spark.read.schema(ddl).parquet(store).count() == len(best)
    again = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    routing.store_results(again, store, f"{state}-2", buckets=8)  # all batches once more change nothing
    assert {(r["query_id"], r["role"]): (r["version"], r["v"]) for r in routing.current_results(spark, store, ddl).collect()} == best
    assert spark.read.schema(ddl).parquet(store).count() == len(best)
