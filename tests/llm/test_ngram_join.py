"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re
from itertools import combinations

import pytest

from forkline.llm import ngram_join
from forkline.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    meet = {}
    for d, s in sets.items():
        for x in s:
            meet.setdefault(x, []).append(d)
    pairs = {p for ds in meet.values() for p in combinations(sorted(ds), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            label[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def run(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_given_documents(given):
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    assert run(given) == brute(rows)


def test_variants_of_one_text_in_small_blocks(spark, monkeypatch):
    """Chains of edits, where neighbours link and the ends do not, next to many near copies that share a passage."""
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "ANCHOR_SHARE", 2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(30):
        text = list(base)
        for j in range(k):
            text[(j * 7) % 80] = f"x{j}"
        rows.append((k, " ".join(text)))
    for k in range(30, 60):
        rows.append((k, " ".join([*base[:12], *(f"q{k}_{i}" for i in range(30)), *base[12:20]])))
    for k in range(60, 90):
        rows.append((k, " ".join([*(f"z{i}" for i in range(60)), f"own{k}"])))
    rows += [(100, rows[70][1]), (101, rows[70][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = run(df)
    assert got == brute(rows)
    assert got[100][1] == 60


def test_sole_open_members_that_are_not_the_tops(spark):
    """Two families of copies that only meet in one member each, neither the smallest id of its family."""
    c, p, q = ([f"{x}{i}" for i in range(n)] for x, n in (("c", 79), ("p", 13), ("q", 52)))
    rows = []
    for at, x in ((10, "t"), (40, "u")):
        tail = [f"{x}{i}" for i in range(27)]
        rows += [(at + k, " ".join([f"{x}own{k}", *c, *tail])) for k in range(8)]
        rows.append((at + 20, " ".join([*p, *c, *tail[:14]])))
    # The passage's smallest id links with neither; copies of its rest are frequent, so the passage is in its prefix.
    rows += [(0, " ".join([*p, *c[:4], *q]))] + [(70 + k, " ".join(q)) for k in range(20)]
    want = brute(rows)
    assert want[10][1] == want[40][1] == 10 and want[0][1] == 0
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_edges_of_the_contract(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One  two"), (5, "one TWO"), (6, "one two three four"), (7, "É a b c d"),
            (8, "é a b c d"), (9, "a b c d e"), (10, "a b c d e a b c d e"), (11, "x" * 300_000)]
    df = spark.createDataFrame([(d, t, "k", 0) for d, t in rows], "doc_id long, text string, a string, n int")
    assert run(df) == brute(rows)
    assert run(df.where("false")) == {}
    nulls = ngram_join.jaccard_components(spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e")], "doc_id long, text string"))
    assert sorted(map(str, nulls.collect())) == sorted(map(str, [
        nulls.collect()[0].__class__(doc_id=d, n_shingles=1, component_id=d) for d in (None, 3, 3)]))


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 203)}}


def template(n, own, common=104, shared_own=0):
    """Texts of one template and words of their own at the end; none is similar to another with 21 own words of 125."""
    head = [f"t{i}" for i in range(common)]
    return [(d, " ".join([*head, *(f"o{d}x{i}" for i in range(own))])) for d in range(n)]


def test_a_template_makes_no_pairs(spark, monkeypatch):
    """All texts meet on template shingles; the joins of groups make no row, so the work is in proportion to the texts."""
    made, real = {}, ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, name: made.setdefault(name, real(df, name)))
    rows = template(3_000, 21)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(docs).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == len(rows)
    assert made["open"].count() == 0 and made["tops"].count() == 0 and made["rest"].count() == 0


def test_templates_with_links_equal_brute_force(spark):
    rows = template(40, 21) + [(d + 100, t) for d, t in template(40, 14)] + [(d + 200, t.replace("t0 ", f"u{d % 5} ")) for d, t in template(40, 15, 90)]
    rng = random.Random(6)
    for d in range(300, 380):  # sizes around the borders of bands and prefixes
        n = rng.randint(20, 40)
        words = [f"t{i}" for i in range(n)]
        words[rng.randrange(n)] = f"z{rng.randrange(4)}"
        rows.append((d, " ".join(words)))
    want = brute(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
