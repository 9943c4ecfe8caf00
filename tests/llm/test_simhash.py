"""SimHash near-duplicates against a plain Python version."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from forkline.llm import queries, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Label of each row of (id, fingerprint): smallest id reachable."""
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    prints = {}
    for i, f in rows:
        prints.setdefault(f, i)
        a, b = root(prints[f]), root(i)
        top[max(a, b)] = min(a, b)
    for f in prints:
        for g in prints:
            if f < g and (f ^ g).bit_count() <= 2:
                a, b = root(prints[f]), root(prints[g])
                top[max(a, b)] = min(a, b)
    return {(i, f): root(i) for i, f in rows}


def rows_of(df):
    return sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in df.collect()), key=str)


def test_fingerprints_equal_the_definition_and_sparks_hash(spark):
    texts = [None, "", " \t\n", "One", "a B", "a b c", "x " * 700, "é ü \x0b ñ q r s t", "a b c a b c a b c d"]
    rng = random.Random(3)
    texts += [" ".join(rng.choices("abcdefgh", k=rng.randint(3, 40))) for _ in range(50)]
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]
    native = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert native % 2**64 == simhash.fingerprints(["A b  C"])[0]
    gathered, simhash.GATHERED = simhash.GATHERED, 7
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]
    simhash.GATHERED = gathered


@pytest.mark.parametrize("blocks", [4, 8, 16])
def test_tiles_within_the_radius_meet_once(blocks):
    rng = np.random.default_rng(5)
    steps = {tuple(d) for d in simhash.offsets(blocks, 2).tolist()}
    for x in rng.integers(0, 2**63, 50, dtype=np.uint64):
        for y in [x, x ^ np.uint64(1 << int(rng.integers(64))), x ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))]:
            change = (simhash.counts(np.array([x]), blocks) - simhash.counts(np.array([y]), blocks))[0]
            assert ((tuple(change.tolist()) in steps) + (tuple((-change).tolist()) in steps)) == (1 + (not change.any()))


@pytest.mark.parametrize(("cell", "blocks"), [(20_000, 4), (7, 4), (3, 8), (20_000, 16)])
def test_links_join_what_pairs_join(spark, cell, blocks):
    rng = random.Random(cell)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1, 3, 12}
    for _ in range(250):  # chains, and one dense family
        prints.add(rng.choice(sorted(prints)) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    prints |= {5 ^ 1 << a ^ 1 << b for a in range(12) for b in range(a)}
    rows = [(i, f) for i, f in enumerate(sorted(prints, key=lambda _: rng.random()))]
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in rows], "print bigint, node bigint")
    edges = simhash.links(nodes, 2, cell, blocks).collect()
    top = {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    assert {(i, f): root(i) for i, f in rows} == brute_components(rows)
    assert len(edges) < 6 * len(rows) * max(1, len(rows) // cell)


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b  c d"), (None, "a b c d"), (3, None), (4, ""), (5, "unlike all others here"),
            (7, "unlike all others here"), (9, "quite another one of these"), (9, "a b c d")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id int, text string, print string, `component_id` int")
    named = [(d, brute_fingerprint(t)) for d, t in rows if d is not None]
    labels = brute_components(named)
    want = sorted(((d, f, labels[d, f]) for d, f in named), key=str)
    got = rows_of(simhash.near_duplicates(docs))
    assert [r for r in got if r[0] is not None] == want
    assert [r for r in got if r[0] is None] == [(None, brute_fingerprint("a b c d"), None)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_query_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs]
    labels = brute_components(rows)
    assert rows_of(queries.op11_simhash(spark, "/root/testdata/sf0.001")) == sorted(((i, f, labels[i, f]) for i, f in rows), key=str)
