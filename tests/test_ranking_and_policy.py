import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forkline.operators import evaluate, policy, probe, rank_metrics, table
from forkline.operators.compare import by_role, chi
from forkline.operators.policy import RoutingPolicy
from forkline.schemas import CALIB, PSI, TEST


def auroc(x, y):
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(x, y) if p for b, n in zip(x, y) if not n]
    return sum(pairs) / len(pairs)


def average_precision(x, y):
    out = 0.0
    for v in sorted(set(x), reverse=True):
        hits = sum(p for a, p in zip(x, y) if a >= v)
        out += sum(p for a, p in zip(x, y) if a == v) / sum(y) * hits / sum(a >= v for a in x)
    return out


def ranks(x):
    return [sum(b < a for b in x) + (sum(b == a for b in x) + 1) / 2 for a in x]


def metrics(spark, columns, targets, **options):
    names = list(columns)
    rows = list(zip(*columns.values(), *targets.values()))
    ddl = ", ".join([f"{c} double" for c in names] + [f"{t} int" for t in targets])
    df = spark.createDataFrame(rows, ddl)
    out = rank_metrics.univariates(df, names, tuple(targets), **options)
    return {(r["feature"], r["target"]): r for r in out.collect()}


@pytest.mark.parametrize("block_values", [10**6, 40, 7])
def test_metrics_equal_definitions(spark, block_values):
    rng = random.Random(9)
    n = 300
    cols = {
        "smooth": [rng.gauss(0, 1) for _ in range(n)],
        "tied": [float(rng.randint(0, 4)) for _ in range(n)],
        "hot": [0.0 if rng.random() < 0.4 else -0.0 if rng.random() < 0.5 else rng.random() for _ in range(n)],
        "gaps": [None if rng.random() < 0.2 else float("nan") if rng.random() < 0.2 else rng.random() for _ in range(n)],
    }
    targets = {"r": [rng.randint(0, 1) for _ in range(n)], "y_lo": [int(rng.random() < 0.05) for _ in range(n)]}
    got = metrics(spark, cols, targets, block_values=block_values)
    for c, x in cols.items():
        for t, y in targets.items():
            keep = [(a, b) for a, b in zip(x, y) if a is not None and not math.isnan(a)]
            a, b = [k[0] for k in keep], [k[1] for k in keep]
            r = got[(c, t)]
            assert (r["n"], r["n_pos"]) == (len(a), sum(b))
            assert r["auroc"] == pytest.approx(auroc(a, b)) and r["auprc"] == pytest.approx(average_precision(a, b))
            assert r["spearman"] == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
            assert r["mean_positive"] == pytest.approx(np.mean([v for v, k in keep if k]))


def test_small_case(spark):
    got = metrics(spark, {"x": [1.0, 2.0, 2.0, 3.0, None]}, {"r": [0, 0, 1, 1, 1]}, min_n=1)[("x", "r")]
    assert got["auroc"] == 0.875 and got["auprc"] == pytest.approx(5 / 6) and got["direction"] == "positive"


def test_edges(spark):
    got = metrics(spark, {"same": [0.1] * 6, "few": [1.0, 2.0, None, None, None, None]}, {"r": [0, 1, 0, 1, 1, 0], "y_lo": [1] * 6})
    assert got[("same", "r")]["auroc"] == 0.5 and got[("same", "r")]["spearman"] is None
    assert got[("same", "r")]["direction"] is None
    one = got[("same", "y_lo")]
    assert (one["auroc"], one["auprc"], one["spearman"], one["direction"]) == (None,) * 4
    assert ("few", "r") not in got


def test_sign_and_scale(spark):
    rng = random.Random(2)
    x = [rng.gauss(0, 1) for _ in range(80)]
    got = metrics(spark, {"x": x, "minus": [-v for v in x], "z": [3 * v + 7 for v in x]}, {"r": [rng.randint(0, 1) for _ in x]})
    assert got[("minus", "r")]["auroc"] == pytest.approx(1 - got[("x", "r")]["auroc"])
    assert got[("z", "r")]["auroc"] == pytest.approx(got[("x", "r")]["auroc"])


def test_family_summary(spark):
    blocks = (("f", "one", ("a__x", "a__y", "a__z", "a__w")), ("f", "solo", ("a__x",)), ("g", "none", ("b__q",)))
    rows = [("a.x", 1.0), ("a.y", 2.0), ("a.z", 4.0), ("a.w", 9.0), ("b.q", None)]
    df = spark.createDataFrame([(f, "r", "a", v) for f, v in rows], "feature string, target string, family string, auroc double")
    got = {r["block"]: r for r in rank_metrics.family_summary(df, blocks).collect()}
    assert set(got) == {"one", "solo"}
    one = got["one"]
    assert (one["q25_auroc"], one["median_auroc"], one["q75_auroc"], one["iqr_auroc"]) == (1.75, 3.0, 5.25, 3.5)
    assert got["solo"]["q25_auroc"] == got["solo"]["q75_auroc"] == 1.0 and got["solo"]["std_auroc"] == 0.0


def test_feature_variance(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 2.0)], "psi__a double, psi__b double")
    got = rank_metrics.feature_variance(df, ("psi__a", "psi__b")).collect()
    assert [(r["feature"], r["n"], r["variance"], r["std"], r["min"], r["max"]) for r in got] == [("psi.a", 2, 1.0, 1.0, 1.0, 3.0)]


def newton(x, y):
    """Balanced logistic regression with an L2 penalty of 1/2 and a free intercept."""
    n, d = x.shape
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    a = np.hstack([x, np.ones((n, 1))])
    penalty = np.diag([1.0] * d + [0.0])
    b = np.zeros(d + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        b -= np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + penalty, a.T @ (w * (p - y)) + penalty @ b)
    return b


def sample(n=250, d=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(2, 3, size=(n, d))
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 3, n) > 2).astype(int)
    return x, y


def test_logistic_fit_matches_newton(spark):
    x, y = sample()
    df = spark.createDataFrame([(*map(float, v), int(t)) for v, t in zip(x, y)], "a double, b double, c double, r int")
    fit = policy.fit_logistic(df, ("a", "b", "c"))
    z = (x - x.mean(0)) / x.std(0)
    want = newton(z, y)
    assert np.allclose(fit.weights, want[:3], atol=1e-5) and fit.intercept == pytest.approx(want[3], abs=1e-5)
    assert np.allclose(fit.mean, x.mean(0)) and np.allclose(fit.scale, x.std(0))


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, r int")


def test_threshold_takes_the_lowest_best(spark):
    best = policy.best_threshold(policy.threshold_sweep(scored(spark, [(0.2, 0), (0.6, 1)]))).first()
    assert (best["tau"], best["accuracy"]) == (0.2, 1.0)


def test_sweep_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([rng.random(), rng.randint(0, 100) / 100.0]), rng.randint(0, 1)) for _ in range(400)]
    for r in policy.threshold_sweep(scored(spark, rows)).collect():
        tau = r["step"] / 100.0
        assert r["tau"] == tau
        assert r["accuracy"] == pytest.approx(sum((p > tau) == bool(y) for p, y in rows) / len(rows))


ONE = RoutingPolicy(("psi.msp",), (0.0,), (0.0,), (0.0,), 0.0, 0.5)


def test_a_tie_goes_to_the_cheap_model(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", float("inf"))], "query_id string, psi__msp double")
    got = {r["query_id"]: r for r in policy.decide(df, ONE).collect()}
    assert got["a"]["score"] == 0.5 and got["a"]["use_strong"] is False and got["a"]["model"] == "M_lo"
    for x in "bc":
        assert got[x]["skip_reason"] == "missing psi.msp" and got[x]["model"] is None
    with pytest.raises(KeyError):
        policy.decide(df.drop("psi__msp"), ONE)


def test_raw_score_method(spark):
    p = RoutingPolicy(("psi.msp",), (1.0,), (2.0,), (3.0,), 0.5, 0.0, scoring_method="logit")
    df = spark.createDataFrame([("a", 2.0)], "query_id string, psi__msp double")
    assert policy.decide(df, p).first()["score"] == 0.5 + 3.0 * 0.5


def test_runtime_columns():
    assert policy.runtime_columns() == tuple(f"psi__{m}" for m in PSI)
    assert len(policy.runtime_columns(include_query=True)) == 27
    assert policy.runtime_columns(None, {"runtime_columns": ["psi.msp"]}) == ("psi__msp",)
    with pytest.raises(ValueError):
        policy.runtime_columns(["psi.msp", "chi.delta_msp"])


def test_fit_policy(spark):
    x, y = sample(120, 2)
    rows = [(f"q{i}", CALIB if i % 4 else TEST, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    ddl = "query_id string, split string, psi__msp double, psi__margin double, r int"
    df = spark.createDataFrame(rows, ddl)
    p = policy.fit_policy(df, ("psi.msp", "psi.margin"))
    moved = df.withColumn("psi__msp", F.when(F.col("split") == TEST, 99.0).otherwise(F.col("psi__msp")))
    assert p == policy.fit_policy(moved, ("psi.msp", "psi.margin"))
    assert p.training["n_calib"] == "90" and p.signal_layers == ("model_dependent",)
    calib = policy.agreement(df.filter(F.col("split") == CALIB), p).first()
    assert calib["n"] == 90 and calib["accuracy"] == pytest.approx(float(p.training["calib_accuracy_at_tau"]))
    with pytest.raises(ValueError):
        policy.fit_policy(df.limit(5), ("psi.msp",))
    with pytest.raises(ValueError):
        policy.fit_policy(df.withColumn("r", F.lit(1)), ("psi.msp",))


def test_probe_matches_numpy(spark):
    x, y = sample(150, 3, 8)
    rows = [(f"q{i}", *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "query_id string, f__a double, f__b double, f__c double, r int")
    blocks = (("f", "all", ("f__a", "f__b", "f__c")), ("f", "gone", ("f__d",)))
    df = df.withColumn("f__d", F.lit(None).cast("double"))
    got = probe.linear_probes(df, blocks, k=4).collect()
    assert [(r["block"], r["cv_folds"], r["n_features"]) for r in got] == [("all", 4, 3)]
    from forkline.operators.split import folds

    fold = {r["query_id"]: r["fold"] for r in folds(df.select("query_id", "r"), 4).collect()}
    f = np.array([fold[f"q{i}"] for i in range(len(y))])
    aucs, aps = [], []
    for k in range(4):
        tr, te = f != k, f == k
        m, s = x[tr].mean(0), x[tr].std(0)
        b = newton((x[tr] - m) / s, y[tr])
        p = ((x[te] - m) / s) @ b[:3] + b[3]
        aucs.append(auroc(p.tolist(), y[te].tolist()))
        aps.append(average_precision(p.tolist(), y[te].tolist()))
    assert got[0]["cv_auroc_mean"] == pytest.approx(np.mean(aucs), abs=1e-6)
    assert got[0]["cv_auroc_std"] == pytest.approx(np.std(aucs), abs=1e-6)
    assert got[0]["cv_auprc_mean"] == pytest.approx(np.mean(aps), abs=1e-6)


def test_probe_needs_two_classes(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], "query_id string, f__a double, r int")
    assert probe.linear_probes(df, (("f", "all", ("f__a",)),)).count() == 0


def test_evaluation(spark):
    rows = [("a", 1, 0, 1.0), ("b", 0, 1, 1.0), ("c", 0, 0, -1.0), ("d", 1, 1, -1.0), ("e", 1, None, 1.0), ("f", 1, 1, None)]
    df = spark.createDataFrame(rows, "query_id string, y_lo int, y_hi int, psi__msp double")
    splits = df.select("query_id", F.lit(TEST).alias("split"))
    p = RoutingPolicy(("psi.msp",), (0.0,), (1.0,), (5.0,), 0.0, 0.5)
    decided = evaluate.decisions(splits, df, df.select("query_id", "psi__msp"), p)
    got = evaluate.report(decided, 2).first()
    assert (got["n"], got["acc_policy"], got["cost_policy"]) == (4, 0.5, 1.0)
    assert (got["acc_always_lo"], got["cost_always_lo"], got["acc_always_hi"], got["cost_always_hi"]) == (0.5, 0.0, 0.5, 2.0)
    assert (got["acc_oracle"], got["cost_oracle"]) == (0.75, 0.5)
    assert [tuple(r) for r in evaluate.first_skipped(decided).collect()] == [("e", "no result"), ("f", "missing psi.msp")]
    assert {tuple(r) for r in evaluate.cost_points(evaluate.report(decided)).collect()} == {
        ("always_M_lo", 0.5, 0.0), ("always_M_hi", 0.5, 1.0), ("policy_pi", 0.5, 0.5), ("oracle_pi_star", 0.75, 0.25),
    }


def test_comparison_signals(spark):
    rows = [(i, role, *[v] * len(PSI)) for i, role, v in [("a", "M_lo", 1.0), ("a", "M_hi", 3.0), ("b", "M_lo", 1.0), ("c", "M_lo", 0.0), ("c", "M_hi", 0.0)]]
    wide = by_role(spark.createDataFrame(rows, "query_id string, role string, " + ", ".join(f"{m} double" for m in PSI)))
    pairs = spark.createDataFrame([("a", 1, None), ("b", 1, 2), ("c", 1, 2)], "query_id string, parsed_lo int, parsed_hi int")
    got = {r["query_id"]: r for r in chi(wide, pairs).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"]["chi__delta_msp"] == 2.0 and got["a"]["chi__prediction_disagreement"] is False
    assert got["c"]["chi__prediction_disagreement"] is True


def test_complete_cases_reads_text_columns(spark):
    df = spark.createDataFrame([("1.5", 1.0), ("x", 1.0), ("2", float("nan"))], "a string, b double")
    assert [r["a"] for r in table.complete_cases(df, ("a", "b")).collect()] == [1.5]
