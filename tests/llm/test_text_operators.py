"""Quality rules, decontamination, token counts, encoding and PII against brute force and exact round trips."""

import hashlib
import pickle
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from forkline.llm import decontaminate, pii, quality_rules, sentencepiece_wfst, token_counts
from forkline.llm.normaliser import Normaliser

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  b ", "\n\n x \t y", "▁a▁", "日本語 テキスト 🎈", "a\x00b <s> <0x0A>", "x" * 70_000, "The The The The The The\nl\nl\n \n\n"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 0, "k") for i, t in enumerate(ODD)] + [(3, ODD[3], 0, "k"), (None, "one two", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, kept string").repartition(3)


def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked))


def test_statistics(spark):
    for t in [*ODD, *[x for x in texts(spark) if len(x) < 6000], "a b c a b c a b", "a a a a"]:
        assert quality_rules.text_statistics(t) == brute_statistics(t)


def test_learned_list_generalises():
    rng = random.Random(3)
    rows = [(float(rng.randint(50, 900)), rng.gauss(5, 0.4), abs(rng.gauss(0, 0.004)), 0.0, 0.0) for _ in range(900)]
    bad = [False] * 900
    rows += [(float(rng.randint(50, 900)), rng.gauss(5, 0.4), rng.uniform(0.1, 0.4), 0.0, 0.0) for _ in range(150)]
    rows += [(float(rng.randint(50, 900)), rng.gauss(5, 0.4), 0.0, 0.0, rng.uniform(0.3, 0.5)) for _ in range(150)]
    bad += [True] * 300
    order = rng.sample(range(1200), 1200)
    x, y = np.array(rows)[order], np.array(bad)[order]
    names = list(quality_rules.FEATURES)
    rules = quality_rules.learn(x[:800], y[:800], names)
    got = np.zeros(400, bool)
    for rule in rules.rules:
        got |= np.logical_and.reduce([(x[800:, names.index(f)] >= c) == above for f, above, c in rule.tests])
    assert (got == y[800:]).mean() > 0.97 and 2 <= len(rules.rules) <= 4
    assert quality_rules.learn(x[:0], y[:0], names).rules == ()


def test_rules_need_held_out_rows():
    """Every third row is held out: rules that only the other rows bear out are not kept."""
    names, n = list(quality_rules.FEATURES), 300
    held = np.arange(n) % 3 == 2
    x, bad = np.zeros((n, len(names))), np.zeros(n, bool)
    grown = np.flatnonzero(~held)
    x[grown[:3], 2], bad[grown[:3]] = 1.0, True
    assert quality_rules.learn(x, bad, names).rules == ()
    x[grown[:90], 2], bad[grown[:90]] = 1.0, True
    some = np.flatnonzero(held)[:3]
    x[some, 2], bad[some[:2]] = 1.0, True
    assert quality_rules.learn(x, bad, names).rules == ()
    bad[some] = True
    (rule,) = quality_rules.learn(x, bad, names).rules
    assert rule.covered == 3 and rule.precision == 1.0


def test_quality_on_given_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels)
    rows = quality_rules.judged(docs, rules).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) < 0.5 * len(bad)


def test_quality_edges(spark, odd):
    none = quality_rules.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_rules.judged(odd, none)
    assert got.count() == len(ODD) + 2 and not got.where("text is null and kept").count()
    assert quality_rules.judged(odd.where("false"), none).count() == 0


def wu_manber(patterns, block=10):
    text, sizes = b"".join(patterns), np.array([len(p) for p in patterns])
    ends = np.cumsum(sizes)
    return decontaminate.WuManber(text, ends - sizes, ends, block)


def test_wu_manber_finds_all():
    rng = random.Random(1)
    for _ in range(60):
        patterns = sorted({"".join(rng.choice("ab ") for _ in range(rng.randint(2, 9))).encode() for _ in range(8)})
        text = "".join(rng.choice("ab ") for _ in range(300)).encode()
        want = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))
        assert sorted(wu_manber(patterns, rng.randint(1, 4)).find(text)) == want


def test_tables_are_compact():
    """At most 100 bytes of tables for a byte of benchmark text, in few objects."""
    rng = random.Random(2)
    items = [(str(i), " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(500))) for i in range(100)]
    windows = decontaminate.Windows(items)
    assert len(pickle.dumps(windows)) < 40 * sum(len(t) for _, t in items)
    text = next(decontaminate.normalised(pa.array(["x " + items[7][1][60:300] + " y"])))[0]
    ranges, found = windows.hits(text)
    assert found == ["7"] and len(ranges) == 1


def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    doc, hit, names = words(text), set(), set()
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            window = w[i : i + 13]
            for k in range(len(doc) - len(window) + 1):
                if doc[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    names.add(str(name))
    return len(doc), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("pass_bytes", [4_000_000, 60])
def test_contamination(spark, odd, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    base = [f"W{i % 17}é" for i in range(40)]
    items = [(1, " ".join(base[:20])), (2, " ".join(base[5:30])), (10, "one TWO"), (11, None), (12, "..."), (13, "テキスト")]
    rows = [(0, " -- ".join(base)), (1, " ".join(base[3:18]) + " x " + "one two, " * 3), (2, "none two one"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    for r in got.collect():
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == brute_contamination(r["text"], items)
        assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])
    assert decontaminate.contamination(odd, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_tokens_are_those_of_the_library(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in token_counts.token_counts(docs, MODEL, cache_rows=500).collect():
        want = len(sp.encode(r["text"] or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), want, want > 4096)
    for r in sentencepiece_wfst.encoded(docs, MODEL, cache_rows=500).collect():
        assert r["token_ids"] == sp.encode(r["text"] or "") and r["n_tokens"] == len(r["token_ids"])
        assert r["round_trip"] == (r["text"] is not None and "▁" not in r["text"])
    back = sentencepiece_wfst.decoded(sentencepiece_wfst.encoded(odd, MODEL), MODEL, into="again")
    assert all(r["again"] == r["text"] for r in back.where("round_trip").collect())


def test_least_weight_path_of_a_unigram_model():
    rng = random.Random(5)
    pieces = [("".join(rng.choice("abc") for _ in range(n)), -rng.random() * 5, i) for i, n in enumerate([1, 1, 1, 2, 2, 2, 3, 3, 4])]
    pieces = list({p[0]: p for p in pieces}.values())
    fst = sentencepiece_wfst.Transducer(pieces, {}, 99, merges=False)
    weight = {t: -s for t, s, _ in pieces}

    def least(text):
        best = [0.0] + [float("inf")] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                w = weight.get(text[i:j], fst.fallback_weight if j == i + 1 else float("inf"))
                best[j] = min(best[j], best[i] + w)
        return best[-1]

    for _ in range(50):
        text = "".join(rng.choice("abcd") for _ in range(12))
        path = fst.shortest(text)
        got = sum(fst.rank[fst.text[n]] if n >= 0 else fst.fallback_weight for _, n in path)
        assert abs(got - least(text)) < 1e-9


def test_surrogates_are_permutations():
    key = b"k"
    assert len({pii.shuffled_number(x, 97, key, "t") for x in range(97)}) == 97
    forms = [f"{a}{b}@mail{c}.example.com" for a in "abxy" for b in range(10) for c in range(3)]
    made = [pii.surrogate("email", f, 0, key) for f in forms]
    assert len(set(made)) == len(forms) and all(re.fullmatch(r"[a-z]\d@[a-z]{4}\d\.example\.com", m) for m in made)
    for card in ("4111111111111111", "4845168114407329"):
        new = pii.surrogate("card", card, 0, key)
        assert new[0] == "4" and (pii.check_digit(new[:-1]) == int(new[-1])) == (pii.check_digit(card[:-1]) == int(card[-1]))
    assert all(0 <= int(x) < 256 for x in pii.surrogate("ip", "10.0.0.7", 0, key).split("."))


def test_pseudonymised_texts(spark, odd):
    text = ("Write to Ann.Lee@Mail7.example.com or ann.lee@mail7.example.com, call +1 (017) 555-7713 or +1(017)555-7713; "
            "host 97.51.17.173. Card 4111 1111 1111 1111, 4111111111111111 and v1.2.3.4.5. Mrs. Maria Keller met Dr Keller and Иван Петров.")
    rows = [(1, text), (2, "call +1 (017) 555-7713 now"), (3, "nothing here 2024, 12 words"), (4, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (100_000, 0):
        got = {r["doc_id"]: r for r in pii.pseudonymised(docs, b"key", most_sent=most).collect()}
        new = got[1]["text"]
        for gone in ("555-7713", "mail7", "97.51.17.173", "4111", "Keller", "Maria", "Иван"):
            assert gone not in new
        assert got[3]["text"] == rows[2][1] and got[3]["surrogates"] == [] and got[4]["text"] == new
        phones = re.findall(r"\+1 ?\(\d{3}\) ?\d{3}-\d{4}", new)
        assert len(phones) == 2 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
        assert phones[0] in got[2]["text"] and "v1.2.3.4.5" in new
        given, family = re.search(r"Mrs\. (\w+) (\w+) met Dr (\w+)", new).group(1, 2)
        assert given in pii.NAMES["latin", "f"] and new.count(family) == 2
        assert re.search(r"and (\w+) ", new).group(1) and [new[s["start"] : s["start"] + len(s["surrogate"])] for s in got[1]["surrogates"]] == [s["surrogate"] for s in got[1]["surrogates"]]
    kept = pii.pseudonymised(odd, b"key")
    assert kept.count() == len(ODD) + 2 and kept.columns == ["doc_id", "text", "n_tokens", "kept", "surrogates"]
    assert pii.pseudonymised(odd.where("false"), b"key").count() == 0


def test_draws_until_distinct(spark):
    """Two-digit locals under one domain fill their shape, so surrogates meet real entities and are drawn again."""
    forms = [("ip", f"10.0.{i}.{j}") for i in range(8) for j in range(30)] + [("phone", f"+1|{i}") for i in range(10)] + [("phone", "+1|77")]
    known = spark.createDataFrame(forms[:240] + [("phone", "+1|77"), ("phone", "+1|78")], "kind string, form string")
    again = {(r["kind"], r["form"]): r["attempt"] for r in pii.redrawn(known, b"key").collect()}
    drawn = Counter((k, pii.surrogate(k, f, again.get((k, f), 0), b"key")) for k, f in [tuple(r) for r in known.collect()])
    assert max(drawn.values()) == 1 and not set(drawn) & {tuple(r) for r in known.collect()}


def test_unlisted_given_names_are_drawn_until_distinct(spark):
    key, name = b"k", lambda form: form.split(":", 2)[2]
    met = name(pii.surrogate("person", "g:m:Bok", 0, key))
    onto_listed = next(n for n in ("".join(x) for x in product("BCDFGHJKLMNPQRSTVWXZ", "aeiouy", "aeiouy", "bcdfghjklmnpqrstvwxz"))
                       if name(pii.surrogate("person", f"g:m:{n}", 0, key)) == "Paul")
    forms = ["g:m:Bok", "g::Bok", f"g:f:{met}", f"g:m:{onto_listed}", "g:m:Hans", "g:f:Maria", "n::Bok"]
    known = spark.createDataFrame([("person", f) for f in forms], "kind string, form string")
    again = {r["form"]: r["attempt"] for r in pii.redrawn(known, key).collect()}
    assert again["g:m:Bok"] == again["g::Bok"] > 0 and again[f"g:m:{onto_listed}"] > 0 and "g:m:Hans" not in again
    open_names = {f: name(pii.surrogate("person", f, again.get(f, 0), key)) for f in forms if f[0] == "g" and name(f) not in pii.GIVEN}
    assert not set(open_names.values()) & ({name(f) for f in forms if f[0] == "g"} | set(pii.GIVEN))
    assert len(set(open_names.values())) == 3


def with_characters(rule):
    """The given model with a table of characters of the library."""
    table = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.precompiled_charsmap = sentencepiece_model_pb2.ModelProto.FromString(table.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    return table, proto.SerializeToString()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_the_table_of_characters_is_compiled(spark, odd, tmp_path, rule):
    """Compatibility forms, marks that join, removed and folded characters: texts and ids equal the library's."""
    table, proto = with_characters(rule)
    normal = Normaliser(sentencepiece_model_pb2.ModelProto.FromString(proto).normalizer_spec.precompiled_charsmap)
    rng = random.Random(rule)
    made = ["ＡＢＣ　ﬁ Straße ① ½ e\u0301 ｶﾞ \u1e9b\u0323 İ Ǆ \ufeff\u200b\x01\t한글 각 ﷺ", "\x01", "\u3000a", "ΑΣ ΣΑΣ", "a\u0300\u0301b"]
    made += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xF900, 0xFFF0), 32, 0x301])) for _ in range(60)) for _ in range(60)]
    assert [normal(t) for t in made] == [table.normalize(t) for t in made]
    path = tmp_path / "rewriting.model"
    path.write_bytes(proto)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for r in sentencepiece_wfst.encoded(docs, str(path)).collect():
        assert r["token_ids"] == sp.encode(r["text"] or ""), r["text"]
    for r in token_counts.token_counts(docs, str(path)).collect():
        assert r["n_tokens"] == len(sp.encode(r["text"] or "")), r["text"]


def test_models_that_move_spaces_are_refused(odd, tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    sentencepiece_wfst.check_transducer(proto.SerializeToString())
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "spaces.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="changes spaces"):
        sentencepiece_wfst.encoded(odd, str(path))


def other_models(folder):
    """The given model, and models that differ from it: pieces taken away, ranks turned round, ids moved, a unigram model."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    given, paths = proto.SerializeToString(), [MODEL]
    rng, kind = random.Random(4), sentencepiece_model_pb2.ModelProto.SentencePiece
    for name in ("fewer", "turned", "moved", "unigram"):
        proto = sentencepiece_model_pb2.ModelProto.FromString(given)
        normal = [p for p in proto.pieces if p.type == kind.NORMAL]
        rest = [p for p in proto.pieces if p.type != kind.NORMAL]
        if name == "fewer":
            normal = [p for p in normal if len(p.piece) == 1 or rng.random() < 0.5]
        if name == "moved":
            rng.shuffle(normal)
        scores = [p.score for p in normal]
        if name == "turned":
            scores = scores[::-1]
        if name == "unigram":
            proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
            scores = [-1.0 - rng.random() * 12 for _ in scores]
        made = [(p.piece, p.type, p.score) for p in rest] + [(p.piece, p.type, s) for p, s in zip(normal, scores, strict=True)]
        del proto.pieces[:]
        for piece, of, score in made:
            proto.pieces.add(piece=piece, type=of, score=score)
        paths.append(f"{folder}/{name}.model")
        with open(paths[-1], "wb") as f:
            f.write(proto.SerializeToString())
    return paths


def test_models_in_turn_in_one_session(spark, odd, tmp_path):
    """Workers are kept between jobs, and with them what they hold of models used before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").limit(60)
    docs = docs.unionByName(odd.select("doc_id", "text").where("length(text) < 3000")).repartition(4).persist()
    given = [r["text"] for r in docs.collect()]
    paths, differ = other_models(tmp_path), set()
    for _ in range(3):
        for path in paths:
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            want = {t: sp.encode(t or "") for t in given}
            differ.add(str(sorted(map(str, want.values()))))
            encoded = sentencepiece_wfst.encoded(docs, path, cache_rows=200)
            for r in sentencepiece_wfst.decoded(encoded, path, into="again").collect():
                assert r["token_ids"] == want[r["text"]], path
                assert not r["round_trip"] or r["again"] == r["text"]
            for r in token_counts.token_counts(docs, path, cache_rows=200).collect():
                assert r["n_tokens"] == len(want[r["text"]]), path
    assert len(differ) == len(paths)
    docs.unpersist()


def test_pieces_that_are_not_compiled_are_refused(odd, tmp_path):
    for number, kind in enumerate(("USER_DEFINED", "UNUSED")):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(MODEL, "rb") as f:
            proto.ParseFromString(f.read())
        proto.pieces[1000].type = getattr(sentencepiece_model_pb2.ModelProto.SentencePiece, kind)
        path = tmp_path / f"{number}.model"
        path.write_bytes(proto.SerializeToString())
        with pytest.raises(ValueError, match="user-defined or unused"):
            sentencepiece_wfst.encoded(odd, str(path))


def test_a_repeated_id_brings_no_more_rows_to_the_driver(spark):
    docs = spark.createDataFrame([(1, f"word{i} " * 60) for i in range(50)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    assert quality_rules.fit(docs, labels, sample_rows=10) is not None
