"""Runs of repeated words against a check of every period."""

import hashlib
import random
import re
import zlib

import pytest

from forkline.llm import queries, runs


def brute_runs(words, shortest=12):
    """(start, length, period) of every run, from the definition."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                out.setdefault((i, j - i + q), q)  # periods ascend: the first is the smallest
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def texts_of(rng):
    """Random texts over small alphabets, powers, nested and touching repeats."""
    yield from ([], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 500, list("ab") * 6, list("abc") * 3, list("abaab" * 9), list("aab" * 20 + "b" * 30))
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    yield list(fib[-1])
    yield (list("xyz") * 5 + ["q"]) * 7
    for _ in range(250):
        alphabet = "abcdefghij"[: rng.randint(1, 10)]
        words = rng.choices(alphabet, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            at, size = rng.randint(0, len(words)), rng.randint(1, 20)
            words[at:at] = words[at : at + size] * rng.randint(1, 5)
        yield words


@pytest.mark.parametrize("shortest", [2, 3, 12])
def test_runs_equal_brute_force(shortest):
    texts = list(texts_of(random.Random(7)))
    got = runs.runs_of([[w.encode() for w in t] for t in texts], shortest)
    for words, found in zip(texts, got, strict=True):
        assert [tuple(r) for r in found.tolist()] == brute_runs(words, shortest), words


def test_texts_of_a_batch_do_not_meet():
    """Equal texts side by side, whose words would run on from one to the next."""
    texts = [[b"a", b"b", b"c"] * 3] * 40 + [[b"a"] * 13] * 3
    assert [r.tolist() for r in runs.runs_of(texts)] == [[]] * 40 + [[[0, 13, 1]]] * 3


def test_nulls_repeats_clashing_columns_and_long_texts(spark):
    long = " ".join(random.Random(2).choices("abcdefghijklmnop", k=30_000)) + " x y z" * 5_000
    rows = [(None, None), (1, ""), (1, ""), (2, " \x0b\t"), (3, "a b " * 12), (4, "A a " * 6), (5, long)]
    docs = spark.createDataFrame([(d, t, "kept", 1) for d, t in rows], "doc_id int, text string, `a.b` string, runs int")
    got = runs.tandem_runs(docs)
    assert got.columns == ["doc_id", "text", "a.b", "n_words", "runs", "collapsed"]
    found = got.collect()
    assert {r["a.b"] for r in found} == {"kept"} and len(found) == len(rows)
    for r in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert r["n_words"] == len(words)
        if len(words) < 100:
            assert [tuple(x) for x in r["runs"]] == brute_runs(words)
    assert [tuple(x) for x in found[-1]["runs"]][-1][1:] == (15_000, 3)
    assert found[-1]["collapsed"].endswith("x y z") and len(found[-1]["collapsed"].split()) == 30_003
    assert runs.tandem_runs(docs.limit(0)).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 6000")
    more = [(None, "a b " * 20), (-7, None), (10**6, "")] + [(10**6 + i, " ".join(f"w{k}" for k in range(3 * i))) for i in range(1, 60)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [brute_row(*r) if r[0] is not None else brute_row_of_null(r[1]) for r in map(tuple, docs.collect())]
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def brute_row_of_null(text):
    """Nothing is planted in a text without an id."""
    free = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    return (None, *brute_row(free, text)[1:])
