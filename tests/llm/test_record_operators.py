"""WARC, URL filters, quotation linking, secret scans and the pipeline's stages on small fixtures."""

import hashlib
import random
import re
from datetime import date

import corpus_pipeline
from pyspark.sql import functions as F

from forkline.llm import quotes, secret_scan, url_filter, warc
from forkline.session import scratch_path


def test_warc_round_trip(spark):
    big, other = "é" * 600, "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 60
    rows = [(1, "http://a/x", big), (2, None, big), (3, "http://c", big), (3, "http://c", big), (4, "u\r\nX: y", "short"), (5, "http://d", "short"),
            (6, "http://e", None), (None, "http://f", other), (None, None, ""), (8, "http://g", other)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path, with_payload=True)
    assert records.where("not complete").count() == 0 and records.count() == 3 * len(rows)
    got = sorted((str(warc_row) for warc_row in warc.captures(records).selectExpr(
        "try_cast(regexp_extract(metadata.fields[0], '^page_id: (-?[0-9]+)', 1) as bigint) as page_id", "payload_bytes", "payload_digest",
        "response.type as kind", "size(requests) as asked").collect()))
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    revisit = {(1, big), (2, big), (None, other)}
    make = warc.captures(records).sparkSession.createDataFrame(
        [(p, len((h or "").encode()), sha(h), "revisit" if (p, h) in revisit else "response", 1) for p, _, h in rows],
        "page_id long, payload_bytes long, payload_digest string, kind string, asked int")
    assert got == sorted(str(r) for r in make.collect())
    lone = records.where("type = 'request'").limit(1)
    assert warc.captures(lone).first()["response"] is None
    empty = scratch_path(spark, "warc-test")
    warc.write_archives(pages.where("false"), empty)
    assert warc.captures(warc.read_archives(spark, empty)).count() == 0


def brute_verdict(url, day, entries):
    """Deciding entry among all (domain, path, action, from, to)."""
    if url is None or day is None:
        return "pass"
    name = url.split("://")[1].split("/")[0].lower()
    where = "/" + url.split("://")[1].partition("/")[2]
    met = [e for e in entries if (name == e[0] or name.endswith("." + e[0])) and where.startswith(e[1]) and e[3] <= day and (e[4] is None or day < e[4])]
    return max(met, key=lambda e: (e[0].count("."), len(e[1]), e[2] == "allow", e[3]))[2] if met else "pass"


def test_one_month_of_one_top_level_domain(spark):
    """All captures lie in a month and under ``com``; once it is not listed, once it is the only entry."""
    rng = random.Random(8)
    rows = [(f"http://{rng.choice(['a', 'b.a', 'c', 'd'])}{rng.randrange(40)}.com/{rng.choice('xyz')}", date(2024, 5, rng.randint(1, 31))) for _ in range(2000)]
    captures = spark.createDataFrame(rows, "url string, fetched_on date").repartition(8)
    several = [(f"a{i}.com", "/", "block", date(2024, 4, 20), date(2024, 5, 1 + i % 28)) for i in range(0, 40, 3)]
    several += [("c1.com", "/x", "allow", date(2024, 5, 7), None), ("c1.com", "/", "block", date(2023, 1, 1), None)]
    for entries in (several, [("com", "/", "block", date(2024, 5, 6), date(2024, 5, 13)), ("com", "/x", "allow", date(2024, 5, 9), None)], [("org", "/", "block", date(2020, 1, 1), None)]):
        listed = spark.createDataFrame(entries, "domain string, path string, action string, valid_from date, valid_to date")
        got = url_filter.evaluated(captures, listed).collect()
        assert len(got) == len(rows) and all(r["verdict"] == brute_verdict(r["url"], r["fetched_on"], entries) for r in got)


def test_paths_of_urls(spark):
    rows = [("http://a.com", "/"), ("http://a.com/x?y#z", "/x"), ("HTTP://u@a.com:1?q", "/"), ("no url", "/"), (None, None)]
    got = spark.createDataFrame(rows, "u string, want string").select(url_filter.path(F.col("u")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def brute_walk(parents):
    """Messages in reply order, depth first, by turn."""
    out = []

    def go(turn):
        out.append(turn)
        for child in sorted(t for t, p in parents.items() if p == turn):
            go(child)

    for root in sorted(t for t, p in parents.items() if p is None):
        go(root)
    return {t: i for i, t in enumerate(out)}


def test_reply_order_is_depth_first(spark):
    rng, rows, want = random.Random(4), [], {}
    for conv in range(30):
        turns = sorted(rng.sample(range(-3, 60), rng.randint(1, 25)))
        parents = {t: rng.choice([None, *turns[:i]]) if i else None for i, t in enumerate(turns)}
        rows += [(conv, t, p) for t, p in parents.items()]
        want |= {(conv, t): at for t, at in brute_walk(parents).items()}
    chain = {t: t - 1 if t else None for t in range(300)}
    rows += [(99, t, p) for t, p in chain.items()]
    want |= {(99, t): t for t in chain}
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, parent_turn bigint")
    assert {(r["conv_id"], r["turn"]): r["position"] for r in quotes.positions(df).collect()} == want
    assert quotes.positions(df.limit(0)).collect() == []


def brute_features(text):
    """(candidate, features that need no dictionary) of each candidate of a text."""
    word = lambda pattern, t: float(bool(re.search(pattern, t)))
    credential = r"(?i)\b(token|secret|passw(or)?d|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)\b"
    harmless = r"(?i)\b(sha1|sha256|md5|commit|uuid|checksum|etag|integrity|digest|example)\b"
    kind = lambda c: "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "+"
    found = list(re.finditer(r"[A-Za-z0-9+/_\-]{16,}", text or ""))
    for k, m in enumerate(found):
        c, n = m.group(), float(len(m.group()))
        before = text[found[k - 1].end() if k else 0 : m.start()][-60:]
        after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)][:60]
        yield c, {
            "length": n, "digit_share": sum(x.isdigit() for x in c) / n, "upper_share": sum(x.isupper() for x in c) / n,
            "transitions": sum(kind(a) != kind(b) for a, b in zip(c, c[1:], strict=False)) / n, "distinct_share": len(set(c)) / n,
            "assigned": word("[=:][ \t]*[\"'`]?$", before), "quoted": word("[\"'`]$", before), "credential_near": word(credential, before),
            "harmless_near": word(harmless, before), "credential_after": word(credential, after), "harmless_after": word(harmless, after)}


def test_candidates_and_features_equal_brute_force(spark):
    rng = random.Random(3)
    key = lambda: "".join(rng.choices("abcdefABCDEF0123456789+/_-", k=rng.randint(10, 45)))
    texts = [" ".join(rng.choice([key(), 'token = "' + key() + '"', "commit " + key(), "api_key: " + key(), "é " + key() + ", sha1", "plain words"])
                      for _ in range(rng.randint(0, 9))) for _ in range(120)] + [None, "", "x" * 5000, "A1" * 8]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string")
    got = {}
    for r in secret_scan.with_features(secret_scan.findings(docs), ["abc"]).collect():
        got[r["doc_id"], r["number"]] = (r["candidate"], r)
    want = {(i, k): x for i, t in enumerate(texts) for k, x in enumerate(brute_features(t))}
    assert set(got) == set(want)
    for at, (c, features) in want.items():
        assert got[at][0] == c
        for name, v in features.items():
            assert abs(got[at][1][name] - v) < 1e-12, (name, c)
        triples = {c.lower()[i : i + 3] for i in range(len(c) - 2)}
        assert abs(got[at][1]["coverage"] - ("abc" in triples) / len(triples)) < 1e-12


def test_dictionary_is_relative_to_the_corpus(spark):
    rows = [("common words here",)] * 990 + [("rarely qxz",)] * 9 + [(None,)]
    docs = spark.createDataFrame(rows, "text string")
    assert "com" in secret_scan.dictionary(docs) and "qxz" in secret_scan.dictionary(docs)
    assert "qxz" not in secret_scan.dictionary(docs, least_share=0.01) and "wor" in secret_scan.dictionary(docs, least_share=0.99)
    assert secret_scan.dictionary(docs.where("false")) == []


def test_list_as_of(spark):
    d = lambda m, k=1: date(2024, m, k)
    changes = spark.createDataFrame(
        [("a.com", "/", "block", d(2), "add"), ("a.com", "/", "block", d(4), "remove"), ("A.com", "/", "block", d(6), "add"),
         ("x.a.com", "/ok", "allow", d(2), "add"), ("b.com", None, "block", d(3), "add"), ("b.com", None, "block", d(3), "remove"),
         (None, "/", "block", d(1), "add"), ("c.com", "/", "block", None, "add")],
        "domain string, path string, action string, changed_on date, change string")
    asks = [("http://a.com/p", d(1), "pass"), ("http://a.com", d(2), "block"), ("https://x.a.com:80/ok?q", d(3), "allow"), ("http://x.a.com/no", d(3), "block"),
            ("http://a.com/", d(4), "pass"), ("http://a.com/", d(12), "block"), ("http://nota.com/", d(12), "pass"), ("http://b.com/", d(5), "block"),
            (None, d(5), "pass"), ("no url", d(5), "pass"), ("http://a.com/", None, "pass"), ("http://a.com", d(2), "block")]
    captures = spark.createDataFrame([(u, f, w, "v") for u, f, w in asks], "url string, fetched_on date, want string, verdict string")
    rows = url_filter.evaluated(captures, url_filter.intervals(changes)).collect()
    assert len(rows) == len(asks) and all(r["verdict"] == r["want"] for r in rows)
    assert url_filter.evaluated(captures.where("false"), url_filter.intervals(changes)).count() == 0
    assert url_filter.evaluated(captures, url_filter.intervals(changes.where("false"))).where("verdict <> 'pass'").count() == 0


def test_quotes_are_linked(spark):
    rows = [(1, 0, "Hello there,\nhow are you?\n\nBye"), (1, 1, "> hello  there,\n> how are you?\n>\n> Bye\nFine."), (1, 2, ">> how are you?\n> Fine.\nGood"),
            (1, 3, "> Fine.\n> not said\nWell"), (2, 0, "> how are you?\nFrom elsewhere"), (2, 1, None), (2, 2, "> nowhere\n> at all"), (None, 5, "> Fine."), (2, 1, None)]
    df = spark.createDataFrame([(c, t, "user", x, 1) for c, t, x in rows], "conv_id long, turn long, role string, text string, depth int")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(df).collect()}
    assert quotes.conversations(df).count() == len(rows)
    assert [got[1, t]["parent_turn"] for t in range(4)] == [None, 0, 1, 1] and [got[1, t]["depth"] for t in range(4)] == [0, 1, 2, 2]
    assert got[1, 1]["own_text"] == "Fine." and got[1, 2]["n_linked"] == 2 and got[1, 3]["root_turn"] == 0
    assert got[2, 0]["n_linked"] == 1 and got[2, 0]["parent_turn"] is None and got[2, 2]["n_linked"] == 0
    assert got[2, 1]["own_text"] is None and got[None, 5]["depth"] is None
    assert quotes.conversations(df.where("false")).count() == 0


def test_quote_of_what_the_message_itself_repeats(spark):
    """The earliest message of the hash is the quoting one, or a later one of its conversation."""
    rows = [(1, 0, "> how are you?\nhow are you?"), (1, 1, "> Fine.\nok"), (1, 2, "Fine."), (2, 3, "how are you?\nFine."), (2, 4, "how are you?"),
            (3, 0, "how are you?"), (4, 0, "> how are you?\nhi"), (5, 0, "> only here\nonly here")]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    links = {(r["conv_id"], r["turn"]): (r["to_conv"], r["to_turn"]) for r in quotes.linked_passages(quotes.with_parts(df)).collect()}
    assert links == {(1, 0): (2, 3), (1, 1): (2, 3), (4, 0): (1, 0), (5, 0): (None, None)}


def test_dictionary_and_words_after(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c for a in letters for b in letters for c in letters[:5]]
    rows = [(1, " ".join(words)), (2, "Rare zzzy word; token qqqqqqqqqqqqqqqqqqqq here"), (3, None), (4, "x 'zyxwvutsrqponmlkjihg' # sha1 of the commit")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    triples = secret_scan.dictionary(docs)
    assert set(words) | {"rar", "are", "zzz", "zzy"} <= set(triples) and "qqq" not in triples
    got = {r["doc_id"]: r for r in secret_scan.with_features(secret_scan.findings(docs), triples).collect()}
    assert (got[4]["harmless_near"], got[4]["harmless_after"], got[4]["words_after"], got[4]["coverage"]) == (0.0, 1.0, 4.0, 0.0)
    assert (got[2]["harmless_after"], got[2]["words_after"], got[2]["before"], got[2]["after"]) == (0.0, 1.0, "Rare zzzy word; token ", " here")


def test_secret_scan_on_held_out_findings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = secret_scan.findings(docs.limit(4000)).cache()
    featured = secret_scan.with_features(found, secret_scan.dictionary(spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")))
    hexes = featured.withColumn("truth", featured["candidate"].rlike("^[0-9a-f]{40}$").cast("int"))
    model = secret_scan.fit(hexes.where("doc_id % 2 = 0"), "truth")
    rows = secret_scan.scored(hexes.where("doc_id % 2 = 1"), model).select("truth", "is_secret").collect()
    right = sum(r["truth"] == r["is_secret"] for r in rows)
    assert right >= 0.98 * len(rows) and any(r["truth"] for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "key " + "ab1" * 9000), (4, "tok = 'abcdefghij0123456789' " * 2)], "number long, text string")
    some = secret_scan.scored(secret_scan.with_features(secret_scan.findings(odd), []), None).collect()
    assert len(some) == 3 and all(r["is_secret"] and r["score"] is None for r in some)
    assert secret_scan.fit(featured.where("false").selectExpr("*", "1 as truth"), "truth") is None
    found.unpersist()


def test_one_document_of_each_group(spark):
    """Repeated ids, null ids and texts that share an id."""
    word = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, word("a")), (1, word("a")), (2, word("a").upper()), (None, word("a")), (None, word("a") + " end"), (3, word("b")), (3, word("c")),
            (None, word("d")), (None, word("d")), (None, word("d") + " end"), (4, word("e")), (5, word("e") + " end"), (6, None), (6, None), (7, word("c"))]
    docs = spark.createDataFrame([(d, t, "k", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, n_chars int").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.schema == docs.schema
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, word("a")), (3, word("b")), (None, word("d")), (4, word("e")), (6, None), (7, word("c"))], key=str)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    now = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        now = function(spark, now, sf)
        assert now.schema.names == docs.schema.names, name
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 50
    assert corpus_pipeline.run(spark, sf).count() == counts[-1]
