import pytest
from pyspark.sql import functions as F

from forkline.operators import grade, scorecard
from forkline.schemas import HI, LO, QUERY_DDL, RESULT_DDL


def pairs(spark, rows):
    return spark.createDataFrame(rows, "query_id string, y_lo int, y_hi int")


def test_buckets_and_gate(spark):
    card = scorecard.scorecard(pairs(spark, [("q1", 1, 1), ("q2", 0, 1)])).first()
    assert card["n_opportunity"] == 1 and card["n_easy"] == 1 and card["gate_c_pass"]


def test_small_gap_fails(spark):
    rows = [(f"q{i}", int(i < 52), int(i < 53)) for i in range(100)]
    card = scorecard.scorecard(pairs(spark, rows)).first()
    assert card["acc_gap"] == 0.01 and not card["gate_c_pass"]
    lines = scorecard.gate_messages(scorecard.scorecard(pairs(spark, rows))).first()
    assert "gate_c: acc_gap=0.010 < 0.030 (acc_lo=0.520, acc_hi=0.530)" in lines["failed"]
    assert lines["passed"][:2] == [
        "gate_a: objective_mcq grading", "gate_b: frozen protocol layers (Phase A defaults)",
    ]


def test_opportunity_gate(spark):
    kinds = [(1, 1)] * 15 + [(0, 1)] * 70 + [(1, 0)] * 10 + [(0, 0)] * 5
    card = scorecard.scorecard(pairs(spark, [(f"q{i}", a, b) for i, (a, b) in enumerate(kinds)])).first()
    assert card["opportunity_rate"] == 0.70 and card["too_hard_rate"] == 0.05 and card["gate_d_pass"]


def test_both_gate_d_lines(spark):
    cards = scorecard.scorecard(pairs(spark, [(f"q{i}", 0, 0) for i in range(10)]))
    failed = scorecard.gate_messages(cards, grading="free").first()["failed"]
    assert failed == [
        "gate_a: grading is not mcq", "gate_c: acc_gap=0.000 < 0.030 (acc_lo=0.000, acc_hi=0.000)",
        "gate_d: opportunity_rate=0.000 < 0.05", "gate_d: too_hard_rate=1.000 >= 0.7",
    ]


CARD = "dataset string, run_id string, timestamp string, acc_gap double, opportunity_rate double, gate_c_pass boolean, gate_d_pass boolean"


def test_winner(spark):
    cards = spark.createDataFrame(
        [("A", "1", "", 0.1, 0.2, True, True), ("B", "2", "", 0.05, 0.3, True, True), ("C", "3", "", 0.9, 0.9, True, False)],
        CARD,
    )
    assert scorecard.winner(cards).first()["dataset"] == "A"
    assert scorecard.winner(cards, order=("opportunity_rate",)).first()["dataset"] == "B"
    assert scorecard.winner(cards.filter("dataset = 'C'")).count() == 0
    even = cards.withColumn("acc_gap", F.lit(0.1)).withColumn("opportunity_rate", F.lit(0.1))
    assert scorecard.winner(even, prefer=("B", "A")).first()["dataset"] == "B"


def test_latest_keeps_first_run_on_ties(spark):
    cards = spark.createDataFrame(
        [("A", "1", "2024-01", 0.1, 0.2, True, True), ("A", "2", "2024-02", 0.1, 0.2, True, True),
         ("A", "3", "2024-02", 0.1, 0.2, True, True), (None, "4", "2025", 0.1, 0.2, True, True)], CARD,
    )
    assert [r["run_id"] for r in scorecard.latest_per_dataset(cards).collect()] == ["2"]


def outputs(spark, rows):
    return spark.createDataFrame(rows, "query_id string, role string, model string, raw_output string")


def test_grade_and_pair(spark):
    q = spark.createDataFrame([("a", "d", "t", ["w", "x", "y", "z"], 1, None)], QUERY_DDL)
    out = outputs(spark, [("a", LO, "m", "B"), ("a", HI, "m", "(C) because"), ("zz", HI, "m", "A")])
    graded = grade.grade(out, q)
    assert {(r["role"], r["parsed_answer"], r["correct"]) for r in graded.collect()} == {(LO, 1, 1), (HI, 2, 0)}
    assert grade.pair(graded).first().asDict() == {
        "query_id": "a", "y_lo": 1, "y_hi": 0, "parsed_lo": 1, "parsed_hi": 2,
    }


def test_answer_keys_do_for_grading(spark):
    keys = spark.createDataFrame([("a", 4, 1)], "query_id string, n_choices int, answer_index int")
    graded = grade.grade(outputs(spark, [("a", LO, "m", "B"), ("a", HI, "m", "none")]), keys)
    assert {(r["role"], r["parsed_answer"], r["correct"]) for r in graded.collect()} == {(LO, 1, 1), (HI, None, 0)}


def test_newest_of_equal_versions(spark):
    ddl = "query_id string, version int, v int, extra map<string,string>"
    rows = [("a", 2, 5, {"x": "1"}), ("a", 2, 7, {"x": "2"}), ("a", 1, 9, None), ("b", None, 1, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, ddl).repartition(3)
        got = {r["query_id"]: (r["version"], r["v"]) for r in grade.newest(df, ("query_id",), "version").collect()}
        assert got == {"a": (2, 7), "b": (None, 1)}


def results(spark, rows):
    """rows: (query_id, role, protocol, candidate scores or None)"""
    made = [
        (i, role, "m", "A", 0, 1, None, None, None if p is None else
         (p, (2, "A", (["A", "B"], s, ["A", "B"], 2) if s is not None else None, None, None, None)))
        for i, role, p, s in rows
    ]
    return spark.createDataFrame(made, RESULT_DDL)


def test_pending(spark):
    q = spark.createDataFrame([(x,) for x in "abcd"], "query_id string")
    r = results(spark, [
        ("a", LO, "mcq_letter", [0.0, 1.0]), ("b", LO, "mcq_letter", []), ("c", LO, "mcq_letter_v1", [1.0, 2.0]),
        ("d", LO, "other", [1.0, 2.0]), ("a", HI, None, None),
    ])
    got = {(x["query_id"], x["role"]) for x in grade.pending(q, r).collect()}
    assert got == {("b", LO), ("d", LO)} | {(x, HI) for x in "abcd"}
    assert grade.pending(q, r, force=True).count() == 8


def test_upsert_and_order(spark):
    old = spark.createDataFrame([("a", LO, 1), ("b", LO, 1)], "query_id string, role string, v int")
    new = spark.createDataFrame([("b", LO, 2), ("c", LO, 2)], "query_id string, role string, v int")
    merged = grade.upsert(old, new)
    assert sorted((r["query_id"], r["v"]) for r in merged.collect()) == [("a", 1), ("b", 2), ("c", 2)]
    wanted = spark.createDataFrame([("c", 0), ("a", 1)], "query_id string, position int")
    assert [r["query_id"] for r in grade.in_requested_order(merged, wanted).collect()] == ["c", "a", "b"]


def test_bundles_are_strict(spark, tmp_path):
    r = spark.createDataFrame(
        [("a", LO, 1, 0), ("a", HI, 1, 0), ("b", LO, 1, 0)], "query_id string, role string, correct int, parsed_answer int"
    )
    s = spark.createDataFrame([("a", "calib"), ("b", "test")], "query_id string, split string")
    with pytest.raises(ValueError):
        grade.write_bundles(r, s, f"{tmp_path}/b")
    grade.write_bundles(r, s.filter("query_id = 'a'"), f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b/split=calib").count() == 2
