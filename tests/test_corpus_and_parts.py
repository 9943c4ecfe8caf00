import hashlib
from collections import Counter

import pytest

from forkline.operators import corpus, hash_order, split
from forkline.operators.split import SplitRule
from forkline.schemas import CALIB, HOLDOUT, QUERY_DDL, TEST


def ordered_ids(ids, seed=42):
    return [i for _, i in sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i) for i in ids)]


def ids_frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "query_id string")


def make_queries(spark, rows):
    return spark.createDataFrame(rows, QUERY_DDL)


def test_subsample_holds_both_strata(spark):
    rows = [(f"q{i}", "d", "t", ["a", "b"], 0, {"subject": "math" if i % 2 else "law"}) for i in range(100)]
    kept, meta = corpus.prepare(
        make_queries(spark, rows), subsample_when_above=50, target_size=30, stratify_by="subject", seed=0
    )
    got = Counter(r["metadata"]["subject"] for r in kept.collect())
    assert got == {"math": 15, "law": 15}
    assert meta == {"n_loaded": 100, "n_dropped_invalid": 0, "n_after_clean": 100, "n_final": 30, "subsampled": 1}


def test_no_subsample_below_threshold(spark):
    rows = [(f"q{i}", "d", "t", ["a", "b"], 0, None) for i in range(10)]
    kept, meta = corpus.prepare(make_queries(spark, rows), subsample_when_above=50, target_size=3)
    assert kept.count() == 10 and meta["subsampled"] == 0


def test_invalid_rows_dropped(spark):
    rows = [
        ("bad", "d", "  ", ["a", "b"], 0, None), ("few", "d", "q", ["a"], 0, None),
        ("out", "d", "q", ["a", "b"], 2, None), ("none", "d", "q", ["a", "b"], None, None),
        ("ok", "d", "\tq ", [" a", "b "], 1, None),
    ]
    q = make_queries(spark, rows)
    got = corpus.clean(q).collect()
    assert [(r["query_id"], r["text"], r["choices"]) for r in got] == [("ok", "q", ["a", "b"])]
    assert corpus.counters(q).first().asDict() == {
        "n_loaded": 5, "n_dropped_invalid": 4, "n_after_clean": 1, "n_duplicate_ids": 0,
    }


@pytest.mark.parametrize("target", [1, 7, 50, 99, 1000])
def test_largest_remainder_with_a_hot_stratum(spark, target):
    sizes = {"a": 40, "b": 3, "c": 3, "d": 1, "unknown": 66}
    ids = [(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)]
    rows = [(i, "d", "t", ["a", "b"], 0, None if k == "unknown" else {"subject": k}) for i, k in ids]
    got = corpus.stratified_ids(make_queries(spark, rows), target, "subject").collect()
    n = sum(sizes.values())
    want = {k: target * s // n for k, s in sizes.items()}
    for k in sorted(sizes, key=lambda k: (-(target * sizes[k] % n), k))[: target - sum(want.values())]:
        want[k] += 1
    if target >= n:
        want = sizes
    assert Counter(r["stratum"] for r in got) == {k: v for k, v in want.items() if v}
    for k, quota in want.items():
        assert {r["query_id"] for r in got if r["stratum"] == k} == set(ordered_ids([i for i, s in ids if s == k])[:quota])


@pytest.mark.parametrize("n", [1471, 817, 1172, 10042])
def test_holdout_size(n):
    assert SplitRule.from_config({"selection_holdout_n": 150, "test_fraction": 0.2}).holdout_size(n) == 150


@pytest.mark.parametrize("pool, want", [(1321, 264), (667, 150), (9892, 1000)])
def test_test_size(pool, want):
    assert SplitRule().test_size(pool) == want


def test_sizes_from_config():
    assert SplitRule.from_config({"selection_holdout_n": 1, "test_fraction": 0.2, "test_n": 150}).test_size(9892) == 150
    assert SplitRule.from_config({"pilot": {"selection_n": 70}, "eval": {"test_n": 9}}).holdout_size(100) == 70
    with pytest.raises(KeyError):
        SplitRule.from_config({"test_fraction": 0.2})
    with pytest.raises(ValueError):
        SplitRule(holdout_n=10).holdout_size(10)
    with pytest.raises(ValueError):
        SplitRule().test_size(150)


def test_parts_are_ranges_of_one_order(spark):
    ids = [f"q{i}" for i in range(500)]
    q = ids_frame(spark, ids)
    parts = {r["query_id"]: r["split"] for r in split.assign(q).collect()}
    order = ordered_ids(ids)
    assert [parts[i] for i in order] == [HOLDOUT] * 150 + [TEST] * 150 + [CALIB] * 200
    early = {r["query_id"] for r in split.holdout_only(q).collect()}
    assert early == set(order[:150])


@pytest.mark.parametrize("n, wanted", [(1, 1), (5, 0), (5, 9), (3000, 1234), (6000, 5999)])
def test_first_in_order(spark, n, wanted):
    ids = [f"x{i}" for i in range(n)]
    got = {r["query_id"] for r in hash_order.first_in_order(ids_frame(spark, ids), wanted, 7).collect()}
    assert got == set(ordered_ids(ids, 7)[:wanted])


def test_violations_and_checks(spark):
    q = ids_frame(spark, ["a", "b", "c", "d"])
    s = spark.createDataFrame([("a", TEST), ("a", CALIB), ("z", CALIB)], "query_id string, split string")
    assert split.violations(q, s).first().asDict() == {
        "n_in_two_parts": 1, "n_unknown": 1, "n_uncovered": 3, "n_empty_parts": 1,
    }
    with pytest.raises(ValueError):
        split.require_sound(q, s)
    with pytest.raises(ValueError):
        split.require_holdout(q, ids_frame(spark, ["a", "a"]))
    with pytest.raises(ValueError):
        split.require_holdout(q, ids_frame(spark, ["nope"]))
    split.require_holdout(q, ids_frame(spark, ["a", "b"]))


def test_leakage_guard(spark):
    s = spark.createDataFrame([("a", HOLDOUT), ("b", CALIB), ("c", TEST)], "query_id string, split string")
    assert {r["query_id"] for r in split.eval_ids(s).collect()} == {"b", "c"}
    assert [r["query_id"] for r in split.eval_ids(s, ids_frame(spark, ["c"])).collect()] == ["c"]
    for bad in ("a", "nope"):
        with pytest.raises(ValueError):
            split.eval_ids(s, ids_frame(spark, ["b", bad]))


def test_select_split(spark):
    q = ids_frame(spark, ["a", "b", "c"])
    s = spark.createDataFrame([("a", CALIB), ("b", CALIB), ("z", TEST)], "query_id string, split string")
    assert split.select_split(q, s, CALIB, 1).count() == 1
    with pytest.raises(ValueError):
        split.select_split(q, s, TEST)


def test_unknown_split_method(spark):
    with pytest.raises(ValueError):
        split.assign(ids_frame(spark, ["a"]), SplitRule(method="by_time"))


def test_folds_are_stratified(spark):
    rows = [(f"q{i}", int(i % 7 == 0)) for i in range(400)]
    got = split.folds(spark.createDataFrame(rows, "query_id string, r int"), 5).collect()
    for label in (0, 1):
        members = [i for i, r in rows if r == label]
        want = {i: n % 5 for n, i in enumerate(ordered_ids(members))}
        assert {r["query_id"]: r["fold"] for r in got if r["r"] == label} == want


def test_frozen_parts_are_reused(spark, tmp_path):
    q = ids_frame(spark, [f"q{i}" for i in range(60)])
    rule = SplitRule(holdout_n=20, test_n=10)
    path = f"{tmp_path}/splits"
    first = split.frozen_or_new(spark, path, q, rule).collect()
    again = split.frozen_or_new(spark, path, q, SplitRule(holdout_n=5, test_n=5)).collect()
    assert sorted(first) == sorted(again)
    with pytest.raises(ValueError):
        split.frozen_or_new(spark, path, ids_frame(spark, ["other"]), rule)


def test_group_rank_with_null_group(spark):
    rows = [(f"q{i}", None if i < 40 else i % 2) for i in range(100)]
    got = hash_order.group_rank(spark.createDataFrame(rows, "query_id string, g int"), "g", 42).collect()
    for g in (None, 0, 1):
        want = {i: n + 1 for n, i in enumerate(ordered_ids([i for i, x in rows if x == g]))}
        assert {r["query_id"]: r["rank"] for r in got if r["g"] == g} == want


def test_leaving_the_holdout_out_shuffles_no_text(spark, tmp_path):
    """The stored parts used to be taken for larger than a broadcast may be, and every text was shuffled: 16 MB here."""
    n = 20_000
    parts = spark.range(n).selectExpr("concat('documents:', id) query_id", f"if(id < 40, '{HOLDOUT}', if(id % 5 = 0, '{TEST}', '{CALIB}')) split")
    parts.write.partitionBy("split").parquet(f"{tmp_path}/parts")
    parts = spark.read.schema("query_id string, split string").parquet(f"{tmp_path}/parts")
    rows = spark.range(n).selectExpr("concat('documents:', id) query_id", "concat_ws(' ', transform(sequence(1, 20), i -> sha1(concat(id, '-', i)))) text")
    executors = spark.sparkContext._jsc.sc().statusStore()

    def shuffled_mb():
        some = executors.executorList(False)
        return sum(some.apply(i).totalShuffleWrite() for i in range(some.size())) / 1e6

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        before = shuffled_mb()
        left = split.eval_rows(rows, parts).selectExpr("count(*) n", "sum(length(text)) chars", "min(cast(substr(query_id, 11) as int)) least").first()
        assert (left["n"], left["chars"], left["least"]) == (n - 40, (n - 40) * 819, 40)
        assert shuffled_mb() - before < 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
