import json

import pytest
from pyspark.sql import functions as F

from forkline import schemas as S
from forkline.operators.policy import RoutingPolicy
from forkline.sources import registry, tables


def write_lines(path, rows):
    path.write_text("".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_jsonl_keeps_odd_line_ends_and_skips_blank_lines(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", [{"query_id": "a", "text": "x\u0085y z"}, "\n", "   \n", {"query_id": "b", "text": "ü"}])
    got = tables.read_jsonl(spark, path, "query_id STRING, text STRING").collect()
    assert [tuple(r) for r in got] == [("a", "x\u0085y z"), ("b", "ü")]
    assert tables.read_jsonl(spark, str(tmp_path / "missing"), "query_id STRING").count() == 0


def test_old_query_names(spark, tmp_path):
    path = write_lines(tmp_path / "q.jsonl", [
        {"example_id": "a", "benchmark": "d", "question": "t", "choices": ["x", "y"], "answer_index": 1},
        {"query_id": "b", "dataset": "d", "text": "u", "choices": ["x", "y"], "answer_index": 0, "metadata": {"subject": "s"}},
    ])
    got = tables.read_queries(spark, path, "json").orderBy("query_id").collect()
    assert [(r["query_id"], r["dataset"], r["text"]) for r in got] == [("a", "d", "t"), ("b", "d", "u")]
    assert got[1]["metadata"] == {"subject": "s"}


def test_corpus_round_trip(spark, tmp_path):
    q = spark.createDataFrame([(x, "d", "t", ["a", "b"], 0, {}) for x in "abc"], S.QUERY_DDL)
    s = spark.createDataFrame([("a", S.HOLDOUT), ("b", S.CALIB), ("c", S.TEST)], S.SPLIT_DDL)
    tables.save_corpus(q, s, str(tmp_path))
    q2, s2 = tables.load_corpus_tables(spark, str(tmp_path))
    assert sorted(q2.collect()) == sorted(q.collect()) and sorted(s2.collect()) == sorted(s.collect())
    with pytest.raises(ValueError):
        tables.save_corpus(q, s.filter("query_id <> 'c'"), str(tmp_path / "x"))


def record(spark, tmp_path, row):
    return tables.read_signals(spark, write_lines(tmp_path / "s.jsonl", [row])).first()


def test_signal_record(spark, tmp_path):
    got = record(spark, tmp_path, {
        "query_id": "q", "signal_type": "model_response", "metrics": {"entropy": 1.2, "margin": 0.8, "msp": 0.6},
        "extra": {"entropy_lo": 1.0, "entropy_hi": 2.0}, "extractor_version": 3, "raw": {"query": "t", "answer": "B"},
    })
    assert got["metrics"] == {"entropy": 1.2, "margin": 0.8, "msp": 0.6}
    assert got["extra"] == {"entropy_lo": "1.0", "entropy_hi": "2.0"}
    assert got["extractor_version"] == 3 and got["raw"]["answer"] == "B" and got["prediction"] is None


def test_flat_signal_row(spark, tmp_path):
    got = record(spark, tmp_path, {"query_id": "q", "entropy": 0.5, "msp": 0.9, "disagreement": 1, "correct": 1, "parsed_answer": 2})
    assert got["signal_type"] == "model_response" and got["metrics"] == {"entropy": 0.5, "msp": 0.9}
    assert got["extra"] == {"disagreement": "1"}


@pytest.mark.parametrize("value, want", [(True, True), (1.0, True), (0, False), (False, False)])
def test_disagreement_becomes_boolean(spark, tmp_path, value, want):
    for key in ("prediction_disagreement", "answer_disagreement"):
        got = record(spark, tmp_path, {"query_id": "q", "signal_type": "cross_model_comparative", "metrics": {key: value}})
        assert got["prediction_disagreement"] is want and got["metrics"] == {}


def test_old_prediction_and_types(spark, tmp_path):
    got = record(spark, tmp_path, {"query_id": "q", "signal_type": "query_derived", "prediction": {"letter": "B", "probability": 0.9}})
    assert got["signal_type"] == "model_independent" and tuple(got["prediction"]) == ("B", 0.9)
    with pytest.raises(ValueError):
        record(spark, tmp_path, {"query_id": "q", "signal_type": "guess"})


def test_old_phi_blocks(spark, tmp_path):
    path = write_lines(tmp_path / "p.jsonl", [
        {"query_id": "a", "split": "calib", "load": {"mattr": 0.5}, "novelty": {"retrieval_density": 0.7, "pc1": 1.0}},
        {"query_id": "b", "split": "test", "structural": {"mattr": 0.6}, "ambiguity": {"choice_length_range": 2},
         "geometry": {"mean_knn_similarity": 0.1}},
    ])
    a, b = tables.read_phi(spark, path).orderBy("query_id").collect()
    assert (a["phi__structural__mattr"], a["phi__embedding_geometry__mean_knn_similarity"], a["phi__embedding_geometry__pc1"]) == (0.5, 0.7, 1.0)
    assert (b["phi__structural__mattr"], b["phi__ambiguity__choice_length_range"], b["phi__embedding_geometry__pc1"]) == (0.6, 2.0, None)


def test_phi_record_round_trip(spark, tmp_path):
    phi = spark.createDataFrame([("a", 0.5, 2.0)], "query_id string, phi__structural__mattr double, phi__ambiguity__choice_length_range double")
    s = spark.createDataFrame([("a", "calib")], S.SPLIT_DDL)
    tables.write_jsonl(tables.phi_records(phi, s), str(tmp_path / "p"))
    back = tables.read_phi(spark, str(tmp_path / "p")).first()
    assert back["phi__structural__mattr"] == 0.5 and back["phi__ambiguity__choice_length_range"] == 2.0
    names = {r["name"]: r["value"] for r in tables.block_keys(phi).collect()}
    assert names == {"structural.mattr": 0.5, "ambiguity.choice_length_range": 2.0}


POLICY = RoutingPolicy(("psi.msp", "psi.margin"), (0.5, 0.1), (0.2, 0.0), (1.5, -2.0), 0.3, 0.42, training={"n_calib": "12"})


def test_policy_round_trip_and_lookup(spark, tmp_path):
    root = str(tmp_path)
    tables.save_policy(spark, POLICY, f"{root}/routing/policy.json")
    assert tables.find_policy(spark, root) == f"{root}/routing/policy.json"
    assert tables.load_policy(spark, tables.find_policy(spark, root)) == POLICY
    tables.save_policy(spark, POLICY, f"{root}/router_package/policy.json")
    assert tables.find_policy(spark, root) == f"{root}/router_package/policy.json"
    assert tables.find_policy(spark, root, "x.json") == "x.json"


def test_policy_defaults(spark, tmp_path):
    path = write_lines(tmp_path / "p.json", ['{\n "feature_columns": ["psi.msp"],\n "signal_layers": ["model_response", "query"]\n}'])
    got = tables.load_policy(spark, path)
    assert (got.scaler_mean, got.scaler_scale, got.weights, got.intercept, got.threshold) == ((0.0,), (1.0,), (0.0,), 0.0, 0.5)
    assert got.signal_layers == ("model_dependent", "model_independent")


def test_newest_scorecards_from_globs(spark, tmp_path):
    for run, ts in (("r1", "2024-01"), ("r2", "2024-03"), ("r3", "2024-02")):
        (tmp_path / run).mkdir()
        write_lines(tmp_path / run / "scorecard.json", [{"run_id": run, "dataset": "A", "timestamp": ts, "n": 3}])
    got = tables.read_scorecards(spark, f"{tmp_path}/*/scorecard.json").collect()
    assert [(r["run_id"], r["n"]) for r in got] == [("r2", 3)]


def test_meta_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, None), (2, None, None), (3, None, 0.1)], "query_id int, msp double, entropy double")
    made = tables.write_with_meta(rows, str(tmp_path / "signals"), ["msp", "entropy"], metrics_version="v4")
    tables.write_report(made, str(tmp_path / "meta"))
    assert json.loads(spark.read.text(str(tmp_path / "meta")).first()["value"]) == {
        "n_queries": 3, "n_without_metrics": 1, "metric_keys": ["entropy", "msp"], "metrics_version": "v4",
    }
    assert spark.read.parquet(str(tmp_path / "signals")).count() == 3


def test_csv_drops_unusable_fields(spark, tmp_path):
    df = spark.createDataFrame([("a", "calib", 1, "easy", 1, 1, "0.5"), ("b", "calib", 0, "easy", 1, 1, "n/a")],
                               "query_id string, split string, r int, bucket string, y_lo int, y_hi int, psi__msp string")
    tables.write_table_csv(df, str(tmp_path / "t"))
    header = spark.read.text(str(tmp_path / "t")).first()["value"]
    assert header.startswith("query_id,split,r,bucket,y_lo,y_hi,phi.structural.prompt_token_len")
    back = {r["query_id"]: r["psi__msp"] for r in tables.read_table_csv(spark, str(tmp_path / "t")).collect()}
    assert back == {"a": 0.5, "b": None}


def test_registry(spark, tmp_path):
    assert registry.get_source("MMLU-Pro").name == "MMLU_PRO"
    with pytest.raises(KeyError):
        registry.get_source("nope")
    spec = registry.get_source("ARC-Challenge")
    rows = [("x2", "Q2 ", (["p", "q"], ["A", "B"]), "b"), ("x1", " Q1", (["p", "q"], ["1", "2"]), "2")]
    for part in ("validation", "test"):
        spark.createDataFrame(rows, spec.schema).write.json(f"{tmp_path}/{part}")
    got = registry.load_corpus(spark, spec, str(tmp_path), "json").orderBy("query_id").collect()
    assert [(r["query_id"], r["text"], r["answer_index"], r["metadata"]["native_id"]) for r in got] == [
        (f"ARC-Challenge:{p}:{i}", f"Q{i + 1}", 1, f"x{i + 1}") for p in ("test", "validation") for i in (0, 1)
    ]
    spark.createDataFrame([("x3", "Q", (["p", "q"], ["A", "B"]), "7")], spec.schema).write.mode("append").json(f"{tmp_path}/test")
    with pytest.raises(ValueError):
        registry.load_corpus(spark, spec, str(tmp_path), "json")


def test_row_numbers_are_contiguous(spark):
    df = spark.range(0, 5000, 1, 16).select((F.col("id") * 7 % 5000).alias("k"))
    got = registry.row_numbers(df, "k").orderBy("k").collect()
    assert [r["row_index"] for r in got] == list(range(5000))


def test_duplicate_ids(spark):
    with pytest.raises(ValueError):
        registry.require_unique(spark.createDataFrame([("a",), ("a",)], "query_id string"))


def test_malformed_json_line_is_an_error(spark, tmp_path):
    path = tmp_path / "lines.jsonl"
    path.write_text('{"a": 1, "b": {"c": 2}}\n\n')
    assert [r["row"] for r in tables.json_lines(spark, str(path)).collect()] == [{"a": "1", "b": '{"c":2}'}]
    path.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="MALFORMED"):
        tables.json_lines(spark, str(path)).collect()
