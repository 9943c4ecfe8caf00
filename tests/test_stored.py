"""Rows parted by reason, row numbers of files, parts that grow, feature specs, vectors of texts."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from forkline.functions.text import words
from forkline.operators import policy, response, split
from forkline.operators.newton import Task, fit_many
from forkline.operators.geometry import principal_axes
from forkline.operators.text_vectors import document_frequencies, slot_places, text_vectors, _slot_counts
from forkline.plans import workload as W
from forkline.schemas import CALIB, HOLDOUT, TEST
from forkline.sources import registry, tables
from forkline.sources.broken import part, part_jsonl

SF = "/root/testdata/sf0.001"


def test_json_lines_are_parted_with_reasons(spark, tmp_path):
    lines = [
        '{"id": 1, "t": "a"}', "", "  ", '{"id": 2, "t": "next\u0085line"}', '{"t": "no id"}', '{"id": null}', "{", "[1]", '"text"',
        '{"id": "x"}', '{"id": 3, "other": {"deep": 1}}', '{"id": 4} trailing', "null", '{"id": 5, "t": "a\\nb"}',
    ]
    (tmp_path / "in.jsonl").write_bytes("\n".join(lines).encode())
    made = part_jsonl(spark, str(tmp_path / "in.jsonl"), "id BIGINT, t STRING", ("id",))
    good = {r["id"]: r["t"] for r in made.good.collect()}
    assert good == {1: "a", 2: "next\u0085line", 3: None, 5: "a\nb"} or good == {1: "a", 2: "next\u0085line", 3: None, 4: None, 5: "a\nb"}
    errors = {r["line"]: r["_reason"] for r in made.errors.collect()}
    assert errors["{"] == errors['{"id": "x"}'] == "malformed"
    assert errors['{"t": "no id"}'] == errors['{"id": null}'] == "no id"
    assert len(good) + len(errors) == 12
    with pytest.raises(ValueError, match="lines"):
        made.require("lines", "line")


def test_the_first_reason_counts_and_null_is_no_reason(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, -1), (4, 50)], "id int, v int")
    made = part(rows, {"negative": F.col("v") < 0, "not small": (F.col("v") > 9) | (F.col("v") < 0)})
    assert sorted(r["id"] for r in made.good.collect()) == [1, 2]
    assert {r["id"]: r["_reason"] for r in made.errors.collect()} == {3: "negative", 4: "not small"}
    assert {r["reason"]: r["n"] for r in made.reasons().collect()} == {"negative": 1, "not small": 1}
    assert part(rows.limit(0), {"negative": F.col("v") < 0}).good.count() == 0


def test_strict_signals_name_the_broken_row(spark):
    t = W.traces(spark, SF)
    m = F.col("model_response")
    assert response.psi(t).count() == t.count()
    other = t.withColumn("model_response", m.withField("protocol_version", F.lit("other")))
    for bad, what in ((other, "unknown protocol"), (t.withColumn("model_response", m.withField("trace.predicted_letter", F.lit("Z"))), "broken trace")):
        with pytest.raises(ValueError, match=f"{what} in 'documents:0'"):
            response.psi(bad)
        assert response.psi_parted(bad).good.count() == 0


def test_file_rows_are_numbered_where_they_lie(spark, tmp_path):
    """Equal rows, an empty file and several files: numbers are 0 to n - 1, rows of a file stay together, runs agree."""
    rows = spark.createDataFrame([("same",)] * 40 + [(f"r{i}",) for i in range(23)], "t string")
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    rows.limit(0).write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.read.schema("t string").parquet(f"{tmp_path}/in")
    runs = [sorted((r["row_index"], r["t"]) for r in registry.file_row_numbers(read).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and [i for i, _ in runs[0]] == list(range(63))
    plan = registry.file_row_numbers(read)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.split("file-rows")[0]


def test_parts_grow_without_moving(spark, tmp_path):
    rule = split.SplitRule(holdout_n=20, test_fraction=0.25, test_min=5, test_max=100)
    ids = spark.createDataFrame([(f"q{i}",) for i in range(900)], "query_id string")
    path, seen = f"{tmp_path}/parts", {}
    for n in (200, 500, 500, 900):
        some = ids.filter(F.substring("query_id", 2, 9).cast("int") < n)
        now = {r["query_id"]: r["split"] for r in split.extend_parts(spark, path, some, rule).collect()}
        assert len(now) == n and all(now[q] == s for q, s in seen.items())
        seen = now
    kinds = [list(seen.values()).count(s) for s in (HOLDOUT, TEST, CALIB)]
    assert kinds[0] == 20 and 0.18 < kinds[1] / 880 < 0.32
    with pytest.raises(ValueError, match="not in the corpus"):
        split.extend_parts(spark, path, ids.limit(300), rule)
    spark.createDataFrame([("q1", CALIB)], "query_id string, split string").write.mode("append").partitionBy("split").parquet(f"{path}/parts")
    with pytest.raises(ValueError, match="manifest"):
        split.extend_parts(spark, path, ids, rule)


def test_holdout_faults(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    held = spark.createDataFrame([("a",), ("b",), ("b",), ("x",), ("x",)], "query_id string")
    assert {tuple(r) for r in split.holdout_faults(q, held).collect()} == {("b", "twice"), ("x", "outside the corpus")}
    assert split.holdout_faults(q, held.limit(0)).count() == 0


def test_feature_spec_chooses_columns(spark, tmp_path):
    path = str(tmp_path / "spec")
    assert tables.load_feature_spec(spark, path) == {}
    tables.save_feature_spec(spark, ["psi__margin", "phi__structural__mattr"], path)
    spec = tables.load_feature_spec(spark, path)
    assert policy.runtime_columns(spec=spec) == ("psi__margin", "phi__structural__mattr")
    assert policy.runtime_columns(["psi.msp"], spec) == ("psi__msp",)
    tables.save_feature_spec(spark, ["chi__delta_msp"], path)
    with pytest.raises(ValueError, match="compare both models"):
        policy.runtime_columns(spec=tables.load_feature_spec(spark, path))


def test_text_vectors_equal_the_definition(spark):
    texts = ["One two two three", "", None, "...", "two", "one ONE one", "Füße über alles, don't", "two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, text string").repartition(3)
    total, held = document_frequencies(docs)
    tokens = {r["query_id"]: r["w"] or [] for r in docs.select("query_id", words(F.coalesce("text", F.lit(""))).alias("w")).collect()}
    counts = _slot_counts()
    want_df = np.zeros(len(held))
    for w in tokens.values():
        want_df[counts(w)[0]] += 1
    assert total == len(texts) and (held == want_df).all()
    places, signs = slot_places(16)
    got = {r["query_id"]: r["embedding"] for r in text_vectors(docs, width=16).collect()}
    for i, w in tokens.items():
        out = np.zeros(16)
        for slot, c in zip(*counts(w), strict=True):
            y = math.copysign(1 + math.log(abs(c)), c) * (math.log((total + 1) / (held[slot] + 1)) + 1)
            for p, s in zip(places[slot], signs[slot], strict=True):
                out[p] += s * y
        assert np.allclose(got[i], out / (np.linalg.norm(out) or 1), atol=1e-6)
    assert got[4] == got[7] and not any(got[1]) and not any(got[2])
    assert text_vectors(docs.limit(0)).count() == 0


def test_fits_of_many_blocks_at_once(spark):
    """Separable, collinear, constant and one-class fits in one table, each with its own rows."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    x[:, 2], x[:, 3] = 2 * x[:, 0], 0.1
    y = (x[:, 0] > 0).astype(int)
    folds = np.stack([np.arange(300) % 3, np.where(np.arange(300) < 100, np.arange(300) % 2, -1), np.where(y == 1, 0, -1)], axis=1)
    rows = spark.createDataFrame([(a.tolist(), int(b), c.tolist()) for a, b, c in zip(x, y, folds)], "x array<double>, y int, folds array<int>")
    tasks = [Task(0, (0, 1, 2, 3), 0), Task(0, (0, 1, 2, 3), 1), Task(1, (1, 0), 0), Task(0, (1,)), Task(2, (0, 1))]
    fits = fit_many(rows, tasks)
    assert fits[4] is None and [f.n for f in fits[:4]] == [200, 200, 50, 300]
    for fit, task in zip(fits[:4], tasks, strict=False):
        used = folds[:, task.block] >= 0 if task.left_out is None else (folds[:, task.block] >= 0) & (folds[:, task.block] != task.left_out)
        a, b = x[used][:, task.columns], y[used]
        z = np.column_stack([(a - np.array(fit.mean)) / np.array(fit.scale), np.ones(len(b))])
        w = np.append(fit.weights, fit.intercept)
        weight = np.where(b == 1, len(b) / (2 * b.sum()), len(b) / (2 * (len(b) - b.sum())))
        gradient = z.T @ (weight * (1 / (1 + np.exp(-z @ w)) - b)) + np.append(w[:-1], 0)
        assert np.abs(gradient).max() / len(b) < 1e-9 and fit.gradient < 1e-9
    assert fits[0].scale[3] == 1.0 and abs(fits[0].weights[0] - fits[0].weights[2]) < 1e-8


@pytest.mark.parametrize("width", [3, 40, 150])
def test_axes_of_flat_and_steep_spectra(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(400, width)) * np.linspace(2, 1, width)
    centred = x - x.mean(0)
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "vector array<double>")
    got = principal_axes(rows, x.mean(0), 3)
    want = np.linalg.svd(centred, full_matrices=False)[2][:3]
    assert np.allclose(np.abs((got * want).sum(1)), 1, atol=1e-10)
    assert principal_axes(rows.limit(1), x[0], 1).shape == (1, width)


def test_text_vectors_count_many_texts_at_once(monkeypatch):
    """A column of texts in pieces of bounded size; each occurrence used to be looked up by itself."""
    import pyarrow as pa

    from forkline.operators import text_vectors as module

    monkeypatch.setattr(module, "WORDS_AT_ONCE", 5_000)
    texts = [["a", "b"] * 1_000, [], ["c"] * 7_000, ["b", "a", "b"]]
    looked = []
    counts = module._column_counts()
    got = {}
    for first, n, row, slot, signed in counts(pa.array(texts, pa.list_(pa.string()))):
        looked.append((first, n))
        for r, s, c in zip(row.tolist(), slot.tolist(), signed.tolist(), strict=True):
            got[first + r, s] = c
    assert looked == [(0, 2), (2, 1), (3, 1)]
    want = {}
    one = module._slot_counts()
    for i, t in enumerate(texts):
        want |= {(i, s): c for s, c in zip(*(x.tolist() for x in one(t)), strict=True)}
    assert got == want and sorted(abs(c) for c in got.values()) == [1, 2, 1_000, 1_000, 7_000]


@pytest.mark.parametrize("name", ["counted_tokens", "compression_documents"])
def test_texts_stay_in_their_arrow_batch(spark, name):
    """The Python functions see Arrow columns: with pandas every text of a batch was a Python string as well."""
    import zlib

    import __spark_entry__ as e

    made = e.queries()[name](spark, e.SMALL)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    kinds = set(re.findall(r"^.*ArrowEvalPython .*\], (\d+)$", plan, re.M))
    assert kinds == {str(PythonEvalType.SQL_SCALAR_ARROW_UDF)}
    if name == "compression_documents":
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{e.SMALL}/documents.parquet").collect()}
        for r in made.collect():
            raw = (texts[r["doc_id"]] or "").encode()
            assert r["compression_ratio"] == (pytest.approx(len(zlib.compress(raw, 6)) / len(raw), abs=1e-6) if raw else None)
