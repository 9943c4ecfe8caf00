"""Conversation repair against a search over all edits of each conversation."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

from forkline.llm import conversation_repair as repair
from forkline.llm import queries

LEGAL = re.compile("(s?(ua)+)?")
SPACE = r"\x20\x09-\x0D"


def prefix_is_open(initials):
    """Whether more roles can make the initials legal."""
    return any(LEGAL.fullmatch(initials + "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n))


def brute_repair(rows):
    """(cost, audit, lines) of the least edits of (role, text, fault) rows: all of them are tried, most expensive last."""
    n = len(rows)

    @lru_cache(None)
    def least(i, initials):
        tail = initials
        out = []
        if i == n and LEGAL.fullmatch(initials):
            out.append((0, "", ()))
        if i < n:
            role, text, fault = rows[i]
            c, a, lines = least(i + 1, tail)
            out.append((4 + c, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                for edit, cost, new in [("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")]:
                    if len(new[:1]) and prefix_is_open(tail + new[0]):
                        c, a, lines = least(i + 1, tail + new[0])
                        out.append((cost + 3 * (fault == "truncated") + c, edit + a, (f"{new}:{text}", *lines)))
        return min(out + inserted(i, tail), default=(10**9, "", ()))

    def inserted(i, initials, depth=2):
        out = []
        for new in ("user", "assistant"):
            if depth and prefix_is_open(initials + new[0]):
                c, a, lines = bare(i, initials + new[0], depth - 1)
                out.append((3 + c, "I" + a, (f"{new}:", *lines)))
        return out

    def bare(i, initials, depth):
        out = inserted(i, initials, depth)
        if i == n and LEGAL.fullmatch(initials):
            out.append((0, "", ()))
        if i < n:
            role, text, fault = rows[i]
            tail = initials
            c, a, lines = least(i + 1, tail)
            out.append((4 + c, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                for edit, cost, new in [("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")]:
                    if len(new[:1]) and prefix_is_open(tail + new[0]):
                        c, a, lines = least(i + 1, tail + new[0])
                        out.append((cost + 3 * (fault == "truncated") + c, edit + a, (f"{new}:{text}", *lines)))
        return min(out, default=(10**9, "", ()))

    return least(0, "")


def brute_row(rows):
    """The columns of one conversation from its (turn, role, text) rows."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
    seen, marked = set(), []
    for _, role, text in rows:
        last = re.findall(f"[^{SPACE}]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    faults = [f for _, _, f in marked]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    cost, audit, lines = brute_repair(marked)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, sha("\n".join(lines)))


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def result(spark, rows):
    audits = repair.diagnosed(rows)
    shas = {r["key"]: r["sha256"] for r in repair.digests(repair.repaired_rows(rows, audits)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r["key"]: (*(r[n] for n in NAMES), shas.get(r["key"], empty)) for r in audits.collect()}


def conversations(rng, n):
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Ussr", "umpire", None])
            if rng.random() < 0.6:
                role = ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "Why? \n", "cut", "cut ", "", " \t", None, "ünï.", ".", "x.\x0b", "a\nb.", f"own {turn}."])
            yield conv, rng.choice([turn, turn, turn, None, turn + 2]), role, text


def test_repairs_equal_a_search_over_all_edits(spark):
    rng = random.Random(13)
    rows = list(conversations(rng, 400))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (-1, None, None, None), (-1, None, None, None)]
    rows += [(1000, t, ("user", "assistant")[t % 2], "same.") for t in range(40)] + [(1001, 5, "system", "only.")] * 3
    rows += [(1002, 2**40, "user", "a."), (1002, -5, "assistant", "b.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, audit int, `a.b` string")
    want = {}
    for conv, *r in rows:
        want.setdefault("" if conv is None else f"={conv}", []).append(tuple(r))
    assert result(spark, df.repartition(7)) == {k: brute_row(v) for k, v in want.items()}


def test_a_long_conversation_is_cut_in_ranges(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{t}."])) for t in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(spark, spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got["=7"] == brute_row([r[1:] for r in rows])


def test_shared_endings_are_solved_once():
    rng = random.Random(1)
    ends = ["".join(rng.choices("uaUA0", k=50)) for _ in range(3)]
    signatures = sorted({"".join(rng.choices("suax", k=4)) + e for e in ends for _ in range(200)}, key=lambda s: s[::-1])
    done = list(repair.solved(iter(signatures)))
    assert sum(r[3] for r in done) <= 3 * 50 + 4 * len(signatures) < sum(map(len, signatures)) / 10
    assert {r[:3] for r in done} == {next(repair.solved(iter([s])))[:3] for s in signatures}


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    audits = repair.diagnosed(none)
    assert audits.collect() == [] and repair.digests(repair.repaired_rows(none, audits)).collect() == []


def test_query_damages_by_name(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    more = spark.createDataFrame([(None, None, None, None), (5000, None, "user", "a."), (5000, 1, None, "b! c"), (None, 3, "user", None)], given.schema)
    given.unionByName(more).write.parquet(f"{tmp_path}/conversations.parquet")
    want, ids = {}, set()
    for c, t, role, text in given.unionByName(more).select("conv_id", "turn", "role", "text").collect():
        ids.add(c)
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        role, text = "user" if h == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
        want.setdefault(c, []).extend([(t, role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    got = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert {r["conv_id"]: (*(r[n] for n in NAMES), r["repaired_sha256"]) for r in got} == {c: brute_row(want[c]) for c in ids}
    assert len(got) == len(ids)
