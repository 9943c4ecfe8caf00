import math
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forkline.functions import grading as G
from forkline.functions import text as X
from forkline.functions.exprs import three_places
from forkline.functions.linear import sigmoid
from forkline.functions.scores import confidence, option_scores, unpack
from forkline.operators import response, text_features
from forkline.schemas import PSI, TRACE_DDL


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_matches_python(spark):
    values = ["\t a ", " b \n", "", "\x1c c \x85", "d e"]
    assert column(spark, values, X.strip) == [v.strip() for v in values]


def test_words(spark):
    got = column(spark, ["It's Ünder_score 'quoted' 42nd", "—", "don't''stop"], X.words)
    assert got == [["it's", "ünder_score", "quoted", "42nd"], [], ["don't''stop"]]


def sliding(tokens, w):
    n = len(tokens)
    if n == 0:
        return None
    if n < w:
        return len(set(tokens)) / n
    return sum(len(set(tokens[i : i + w])) / w for i in range(n - w + 1)) / (n - w + 1)


def test_mattr_equals_sliding_definition(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 80))) for _ in range(150)]
    for w in (1, 2, 7, 25):
        got = column(spark, texts, lambda c: X.mattr(X.words(c), w))
        for t, g in zip(texts, got):
            want = sliding(t.split(), w)
            assert (want is None and g is None) or math.isclose(g, want, abs_tol=1e-12)


def test_mattr_cases(spark):
    assert column(spark, ["a b a c"], lambda c: X.mattr(X.words(c), 2)) == [1.0]
    assert column(spark, ["a a", ""], lambda c: X.mattr(X.words(c), 5)) == [0.5, None]


def test_words_of_a_prompt_are_found_once(spark):
    """Text and options used to be searched for words four times: for the prompt, both counts and the overlaps."""
    rows = [
        ("a", "It's 'one' two\n", ["x y", None, "'z' don't"], {"subject": "Law's 'code'"}),
        ("b", "", ["p", ""], {"subject": ""}), ("c", "Ä b Ä", [], None), ("d", None, ["q"], None), ("e", "one", None, None),
    ]
    df = spark.createDataFrame(rows, "query_id string, text string, choices array<string>, metadata map<string,string>")
    subject = F.try_element_at("metadata", F.lit("subject"))
    prompt = X.user_message(X.question_text(F.col("text"), subject), X.choice_lines(F.col("choices")))
    got = df.select(X.words(prompt), X.prompt_words(subject, X.words(F.col("text")), F.transform("choices", X.words))).collect()
    assert all(a == b for a, b in got) and got[0][0][:3] == ["subject", "law's", "code"]
    made = text_features.text_features(df, with_compression=False)
    counts = {r["query_id"]: r["phi__structural__question_token_len"] for r in made.collect()}
    assert counts == {"a": 6.0, "b": 0.0, "c": 3.0, "d": None, "e": 1.0}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "regexp_count" not in plan and plan.count("regexp_extract_all(text") == 1


def test_mattr_of_texts_cut_into_pieces(spark, monkeypatch):
    """Equal words of different texts, and empty ones between, do not meet."""
    monkeypatch.setattr(X, "MATTR_TOKENS", 7)
    texts = ["a b a", "", "a a a a a a a a a", "b", "a b c d a", ""]
    got = column(spark, texts, lambda c: X.mattr(X.words(c), 3))
    assert [g is None for g in got] == [not t for t in texts]
    assert all(g is None or math.isclose(g, sliding(t.split(), 3)) for t, g in zip(texts, got))


def test_jaccard(spark):
    df = spark.createDataFrame([("", ""), ("a b", "B c"), ("a", "")], "a string, b string")
    got = df.select(X.set_jaccard(X.word_set(F.col("a")), X.word_set(F.col("b"))).alias("j")).collect()
    assert [r["j"] for r in got] == [1.0, pytest.approx(1 / 3), 0.0]


def test_compression(spark):
    texts = ["", "aaaa" * 50, "é"]
    want = [None] + [len(zlib.compress(t.encode(), 6)) / len(t.encode()) for t in texts[1:]]
    assert column(spark, texts, lambda c: X.compression_ratio(c, 6)) == want


def test_user_message_template(spark):
    df = spark.createDataFrame([("math", "Q ", ["x ", "y"])], "s string, t string, c array<string>")
    got = df.select(
        X.user_message(X.question_text(F.col("t"), F.col("s")), X.choice_lines(F.col("c"))).alias("m")
    ).first()["m"]
    assert got == "Subject: math\n\nQ\n\nA. x\nB. y\n\nAnswer:\n"


@pytest.mark.parametrize(
    "text, n, want",
    [
        ("B", 2, 1), ("I think B", 4, None), ("\n\n b ", 4, 1), ("(C) because", 3, 2), ("", 4, None), ("none", 4, None),
        ("é b", 4, 1), ("a_b C", 4, 2), ("D", 3, None), ("x\ny A", 4, None), ("answer: a\r\nB", 4, 0),
    ],
)
def test_parse(spark, text, n, want):
    assert column(spark, [text], lambda c: G.parsed_answer(c, F.lit(n))) == [want]


def test_grade(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (None, 0)], "p int, a int")
    assert [r[0] for r in df.select(G.is_correct(F.col("p"), F.col("a"))).collect()] == [1, 0, 0]


def test_finish_reason(spark):
    got = column(spark, [[], None, [1, 9], [1, 2, 3], [1]], lambda c: G.finish_reason(c, (9,), 3), "array<int>")
    assert got == ["unknown", "unknown", "eos", "length", "unknown"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(-20000, 20000), min_size=200, max_size=200))
def test_three_places_like_python(spark, numbers):
    values = [n / 10000 for n in numbers] + [0.8125, 0.0015, 0.0045, 0.9995, 1.0, -0.0004]
    assert column(spark, values, three_places, "double") == [f"{v:.3f}" for v in values]


def test_sigmoid_is_stable(spark):
    got = column(spark, [0.0, 800.0, -800.0, 2.0], sigmoid, "double")
    assert got[:3] == [0.5, 1.0, 0.0] and got[3] == pytest.approx(1 / (1 + math.exp(-2)))


def psi_of(spark, scores, predicted="A", temperature=1.0):
    labels = [chr(65 + i) for i in range(len(scores))]
    row = (len(scores), predicted, (labels, scores, labels, len(scores)), None, None, None)
    df = spark.createDataFrame([(row,)], f"trace {TRACE_DDL}")
    entries = option_scores(F.col("trace"))
    found = confidence(entries, F.col("trace.predicted_letter"), temperature)
    out = unpack(found["packed"], found["predicted_logprob"])
    return df.select(*[v.alias(k) for k, v in out.items()]).first().asDict()


def test_psi_uniform(spark):
    got = psi_of(spark, [0.0] * 4)
    assert got["entropy"] == pytest.approx(math.log(4)) and got["normalized_entropy"] == pytest.approx(1)
    assert (got["msp"], got["margin"], got["top_probability_ratio"]) == (0.25, 0.0, 1.0)
    assert got["effective_support"] == pytest.approx(4)


def test_psi_certain_and_single(spark):
    got = psi_of(spark, [0.0, -1000.0])
    assert (got["entropy"], got["msp"], got["margin"], got["top_probability_ratio"]) == (0.0, 1.0, 1.0, 1e6)
    got = psi_of(spark, [-0.3])
    assert got["normalized_entropy"] == 0 and got["margin"] == got["msp"] == 1 and got["top_probability_ratio"] == 1e6


def test_psi_nothing_scored(spark):
    got = psi_of(spark, [float("-inf")] * 3)
    assert all(got[m] is None for m in PSI)


def test_psi_temperature_keeps_raw_score(spark):
    scores = [math.log(0.5), math.log(0.3), math.log(0.2)]
    one, two = psi_of(spark, scores), psi_of(spark, scores, temperature=2.0)
    assert one["msp"] == pytest.approx(0.5) and one["margin"] == pytest.approx(0.2)
    assert one["top_probability_ratio"] == pytest.approx(5 / 3)
    assert one["predicted_logprob"] == two["mean_logprob"] == pytest.approx(math.log(0.5))
    assert two["msp"] < one["msp"]


def test_score_forms(spark):
    """Candidate list, option map and spelling map give the same scores; a missing letter is -inf."""
    rows = [
        ((2, "A", (["B", "A"], [-2.0, -1.0], ["A", "B"], 2), None, None, None),),
        ((2, "A", None, {"B": -2.0, "A": -1.0}, None, None),),
        ((2, "A", None, None, {" a": -1.0, "A": -3.0, "b": -2.0}, None),),
        ((2, "A", None, None, {"A": -1.0}, None),),
    ]
    df = spark.createDataFrame(rows, f"trace {TRACE_DDL}")
    got = [[tuple(e) for e in r["s"]] for r in df.select(option_scores(F.col("trace")).alias("s")).collect()]
    assert got[0] == got[1] == got[2] == [("A", -1.0), ("B", -2.0)]
    assert got[3] == [("A", -1.0), ("B", float("-inf"))]


def test_packed_steps(spark):
    df = spark.createDataFrame([([[0.0, 1.0, 1.0], [2.0, 0.0, 0.0]], [1, 2])], "l array<array<double>>, t array<int>")
    got = df.select(response.packed_steps(F.col("l"), F.col("t"), 2).alias("s")).first()["s"]
    z = math.log(1 + 2 * math.e)
    assert got[0]["logprob"] == pytest.approx(1 - z)
    assert [t["token_id"] for t in got[0]["top"]] == [1, 2]
    assert got[1]["top"][0]["token_id"] == 0


def test_unknown_scorer():
    with pytest.raises(NotImplementedError):
        response.score_candidates("teacher_forced", None, None)
