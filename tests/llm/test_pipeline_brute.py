"""The pipeline's stages and the quotation links against plain Python on small inputs."""

import random
import re

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F
from test_ngram_join import brute as brute_groups
from test_text_operators import brute_statistics

from forkline.llm import pii, quality_rules, quotes
from forkline.session import stage

SF = "/root/testdata/sf0.001"


def brute_quality(text, rules):
    n, chars, symbols, lines, repeated = brute_statistics(text)
    if n < 50 or 100 * repeated > 50 * n:
        return False
    value = {"n_words": n, "word_length": chars / n, "symbol_share": symbols / chars, "dup_line_share": lines / n, "repeat_share": repeated / n}
    return not any(all((value[f] >= cut) == above for f, above, cut in rule.tests) for rule in rules)


def brute_windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return words, [tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12) if words else 0)]


def brute_contaminated(text, windows):
    words, hit = brute_windows(text)[0], set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def brute_attempts(texts, key):
    """Draws of each entity: again while the surrogate is an entity, or that of a smaller (draw, form)."""
    plain = lambda k, f: (k, re.sub("^g:[^:]*:", "g::", f) if k == "person" else f)
    forms = {(k, f) for t in texts for k, _, _, f in pii.mentions(t)}
    listed = {("person", f"g::{n}") for n in pii.GIVEN}
    known = {plain(*e) for e in forms} | listed
    attempt = dict.fromkeys(known - listed, 0)
    while True:
        made, bad = {}, set()
        for e, a in attempt.items():
            made.setdefault((e[0], pii.surrogate(*e, a, key)), []).append((a, e[1]))
        for (kind, new), drawn in made.items():
            bad |= {(kind, f) for a, f in drawn if (kind, new) in known or (a, f) != min(drawn)}
        if not bad:
            return {e: attempt.get(plain(*e), 0) for e in forms}
        attempt.update({e: attempt[e] + 1 for e in bad})


def families(first):
    """Two families of copies whose only link is between members that are not the smallest ids."""
    c, p, q = ([f"{x}{i}" for i in range(n)] for x, n in (("c", 79), ("p", 13), ("q", 52)))
    rows = [(first, [*p, *c[:4], *q])] + [(first + 70 + k, q) for k in range(20)]
    for at, x in ((10, "t"), (40, "u")):
        tail = [f"{x}{i}" for i in range(27)]
        rows += [(first + at + k, [f"{x}own{k}", *c, *tail]) for k in range(8)] + [(first + at + 20, [*p, *c, *tail[:14]])]
    return [(d, " ".join(w)) for d, w in rows]


def test_each_stage_keeps_what_plain_python_keeps(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    more = [{**dict.fromkeys(given.columns), "doc_id": d, "text": t, "n_chars": len(t)} for d, t in families(10**6)]
    docs = given.unionByName(spark.createDataFrame([tuple(r[c] for c in given.columns) for r in more], given.schema))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = {r["doc_id"]: r["text"] for r in docs.collect()}

    rules = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).rules
    want = [{d: t for d, t in now.items() if brute_quality(t, rules)}]
    groups = brute_groups(list(want[-1].items()))
    want.append({d: t for d, t in want[-1].items() if groups[d][1] == d})
    windows = {w for t in items for w in brute_windows(t)[1]}
    want.append({d: t for d, t in want[-1].items() if not brute_contaminated(t, windows)})
    attempts = brute_attempts(want[-1].values(), corpus_pipeline.PII_KEY)
    want.append({d: pii.replaced(t, corpus_pipeline.PII_KEY, attempts)[0] for d, t in want[-1].items()})

    for (name, function), kept in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stage(function(spark, docs, SF), "stage")
        rows = docs.collect()
        assert len(rows) == len(kept) and {r["doc_id"]: r["text"] for r in rows} == kept, name
    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    assert 10**6 + 10 in kept and 10**6 + 40 not in kept
    ids = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    assert ids == {d: sp.encode(t) for d, t in kept.items()}


CLASHING = ("kept", "n_words", "items", "surrogates", "a.b", "__id", "path", "component_id", "rule")


def test_stages_keep_clashing_and_dotted_columns(spark):
    """Values and types of all columns are those given, in every stage but the last, and on an empty table."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs = given.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHING})
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    plain = given
    for name, function in corpus_pipeline.STAGES[:-1]:
        empty = function(spark, docs.where("false"), SF)
        assert empty.columns == docs.columns and empty.collect() == []
        docs, plain = stage(function(spark, docs, SF), "stage"), stage(function(spark, plain, SF), "stage")
        assert docs.dtypes == [*given.dtypes, *((c, "string") for c in CLASHING)], name
        rows = docs.where("doc_id is not null").collect()
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHING), name
        assert {(r["doc_id"], r["text"]) for r in rows} == {(r["doc_id"], r["text"]) for r in plain.collect()}, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.where("false"), SF).collect() == []
    assert last(spark, docs, SF).select("`a.b`", "kept", "token_ids").count() == docs.count()


def brute_links(rows):
    """Target of each passage, from all messages in order."""
    fold = lambda t: " ".join(t.lower().split())
    own = {(c, t): quotes.parsed(x)[0] for c, t, x in rows}
    offers = {m: {fold(p) for p in [o, *o.split("\n"), *re.split(r"\n[ \t]*\n", o)]} - {""} for m, o in own.items()}

    def target(conv, turn, passage):
        inside = [m for m in offers if m[0] == conv and m[1] < turn and passage in offers[m]]
        outside = [m for m in offers if m[0] != conv and passage in offers[m]]
        return min(inside or outside, default=None) if passage else None

    out = {}
    for c, t, x in rows:
        for no, (_, lines) in enumerate(quotes.parsed(x)[1]):
            to = target(c, t, fold("\n".join(lines)))
            if to is None:
                votes = [v for v in (target(c, t, fold(x)) for x in lines) if v]
                to = min(set(votes), key=lambda v: (-votes.count(v), v), default=None)
            out[c, t, no] = to or (None, None)
    return out


def test_quotation_links(spark):
    rng, rows = random.Random(11), []
    for conv in range(12):
        for turn in range(rng.randint(1, 7)):
            said = lambda n: [f"Line {rng.randint(0, 9)}" for _ in range(rng.randint(0, n))]
            lines = [line for _ in range(2) for line in [*("> " + x for x in said(3)), *said(2), *("> > " + x for x in said(1)), ""]]
            rows.append((conv, turn, "\n".join(lines)))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r["conv_id"], r["turn"], r["no"]): (r["to_conv"], r["to_turn"]) for r in quotes.linked_passages(quotes.with_parts(df)).collect()}
    assert got == brute_links(rows) and len({v for v in got.values()}) > 10
