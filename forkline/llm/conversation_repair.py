"""Repair of conversation structure by the cheapest edits, on a suffix-shared automaton of role and fault signatures.

A conversation's rows, in order, give a signature: one sign per row for its role's initial and its fault. Signatures of
all conversations are made distinct and dealt in ranges of their reversed text, so that signatures with a common end lie
side by side. Read from the end they form an automaton whose nodes are the different endings; a task holds the path to
the ending at hand and adds a node only for what the signature before did not share. For each node and each state of
the grammar ``(s?(ua)+)?`` the cost to go and the first edit of the best audit suffix are computed once. All edits that
may come first have different letters and one successor each, so the least letter among the cheapest edits gives the
ASCII-least audit, and no audit is stored in a node.

Only narrow rows (key, turn, role, digest) are sorted to find signatures, in ranges that split a long conversation; its
pieces, a byte per row, meet at the end. Texts are shuffled once and stream past their audit, never held together.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.session import stage

#: Signs of a signature: rows with no fault, truncated rows, and rows that must go, by class of role.
FINE, CUT, GONE = "suax", "SUAX", "0123"
REMOVE, ADD, ROLE = 4, 3, 3  # costs of an edit; ROLE also for a truncated row that stays
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a; the role that may be made next, and where each role leads.
NEXT_ROLE, AFTER = "uuau", {"s": 1, "u": 2, "a": 3}
ALLOWED = ("su", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\f\r"


def conv_key(conv_id: Column) -> Column:
    """A text for each id; a null id has its own."""
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def _prepared(rows: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return rows.select(
        conv_key(F.col("conv_id")).alias("key"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))


ORDER = ("turn", "role", "digest")  # null turns first


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signs of each conversation's rows in this partition, with the place of the first as its order."""
    now, place, signs = None, None, []

    def piece():
        return pa.RecordBatch.from_pylist([{"key": now, "has_turn": place[0] is not None, "turn": place[0], "role": place[1],
                                            "digest": place[2], "piece": "".join(signs)}], schema=PIECE)

    for batch in batches:
        for key, turn, role, digest, sign in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if now is not None:
                    yield piece()
                now, place, signs = key, (turn, role, digest), []
            signs.append(sign)
    if now is not None:
        yield piece()


PIECE = pa.schema([("key", pa.string()), ("has_turn", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()),
                   ("digest", pa.string()), ("piece", pa.string())])


def _node(sign: str, later: tuple) -> tuple:
    """Per state (cost to go, first edit) before a row of this sign, whose later rows cost ``later``."""
    at = CUT.find(sign) if sign in CUT else FINE.find(sign)
    stays = 0 if sign in FINE else ROLE
    base = []
    for state in range(4):
        best = (REMOVE + later[state][0], "D")
        if at >= 0:
            role = FINE[at]
            if role in ALLOWED[state]:
                best = min(best, (stays + later[AFTER[role]][0], "K"))
            best = min(best, (stays + ROLE + later[AFTER[NEXT_ROLE[state]]][0], "R"))
        base.append(best)
    two, three = min(base[2], (ADD + base[3][0], "I")), min(base[3], (ADD + base[2][0], "I"))
    return min(base[0], (ADD + two[0], "I")), min(base[1], (ADD + two[0], "I")), two, three


END = ((0, ""), (2 * ADD, "I"), (ADD, "I"), (0, ""))


def _audit(signature: str, nodes: list[tuple]) -> str:
    """The edits from the first row on; the last node is that of the whole signature."""
    out, state, i = [], 0, 0
    while True:
        edit = nodes[len(signature) - i][state][1]
        if not edit:
            return "".join(out)
        out.append(edit)
        if edit == "K":
            state = AFTER[signature[i].lower()]
        elif edit != "D":
            state = AFTER[NEXT_ROLE[state]]
        i += edit != "I"


def solved(signatures: Iterator[str]) -> Iterator[tuple[str, int, str, int]]:
    """(signature, cost, audit, number of nodes added) of each signature; fewest nodes if sorted from the end."""
    path, nodes = "", [END]
    for signature in signatures:
        ending = signature.translate(SAME_END)[::-1]
        shared = next((i for i, (x, y) in enumerate(zip(path, ending, strict=False)) if x != y), min(len(path), len(ending)))
        del nodes[shared + 1 :]
        for sign in ending[shared:]:
            nodes.append(_node(sign, nodes[-1]))
        path = ending
        yield signature, nodes[-1][0][0], _audit(signature, nodes), len(ending) - shared


SAME_END = str.maketrans(GONE, GONE[0] * 4)  # rows that must go are alike


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flow = (s for batch in batches for s in batch.column(0).to_pylist())
    done = solved(flow)
    roles = str.maketrans(CUT + GONE, FINE + FINE)
    while some := list(itertools.islice(done, 1000)):
        illegal = [sum(p not in LEGAL for p in itertools.pairwise(s.translate(roles))) for s, *_ in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in some]), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some]),
             pa.array(illegal, pa.int64())], names=["signature", "cost", "audit", "illegal"])


def diagnosed(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (``conv_id, turn, role, text``): ``key``, ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost`` and ``audit`` (D delete, I insert, K keep, R rerole).

    Rows are ordered by turn, null turns first, then by role and by the SHA-256 of the text. A null role or text is one
    space; a null id is a conversation of its own. The first fault of a row counts: blank, duplicate (role and text
    seen earlier in the conversation), truncated (last sign that is no space is none of ``.!?``). A role counts by
    its first letter. Repeated rows are duplicates; other columns are ignored; an empty table gives an empty result.
    """
    trimmed = F.rtrim("text", F.lit(SPACE))
    narrow = _prepared(rows).select(
        "key", "turn", "role", F.sha2("text", 256).alias("digest"), (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    same = stage(narrow.groupBy("key", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("copies")), "rows")
    first = same.groupBy("key", "role", "digest").agg(F.min(F.struct(F.expr("turn is not null").alias("x"), "turn")).alias("first"))
    kind = F.expr("case left(role, 1) when 's' then 1 when 'u' then 2 when 'a' then 3 else 4 end")
    signs = same.join(first, ["key", "role", "digest"]).withColumn("kind", kind).withColumn(
        "repeats", F.expr("copies - if(turn <=> first.turn, 1, 0)"))
    sign = F.expr(
        f"case when blank then repeat(substr('{GONE}', kind, 1), int(copies)) else concat("
        f"if(turn <=> first.turn, substr(if(cut, '{CUT}', '{FINE}'), kind, 1), ''), repeat(substr('{GONE}', kind, 1), int(repeats))) end")
    signs = stage(signs.select("key", "turn", "role", "digest", sign.alias("sign"), *(
        F.expr(x).alias(n) for n, x in (
            ("blank", "if(blank, copies, 0)"), ("duplicate", "if(blank, 0, repeats)"), ("truncated", "if(cut and not blank, copies - repeats, 0)")))),
        "signs")

    counts = signs.groupBy("key", "turn").agg(*(F.sum(n).alias(n) for n in FAULTS)).groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *(F.sum(n).alias(n) for n in FAULTS))
    dealt = signs.select("key", "turn", "role", "digest", "sign").repartitionByRange("key", *ORDER).sortWithinPartitions("key", *ORDER)
    pieces = dealt.mapInArrow(_pieces, "key string, has_turn boolean, turn bigint, role string, digest string, piece string")
    whole = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("has_turn", "turn", "role", "digest", "piece"))).alias("p"))
    signatures = stage(whole.select("key", F.expr("array_join(p.piece, '')").alias("signature")), "signatures")
    ending = F.reverse(F.translate("signature", GONE, GONE[0] * 4))
    distinct = stage(signatures.select("signature").distinct(), "distinct-signatures")
    solutions = distinct.repartitionByRange(ending).sortWithinPartitions(ending).mapInArrow(
        _solve, "signature string, cost bigint, audit string, illegal bigint")
    return counts.join(signatures, "key").join(stage(solutions, "solutions"), "signature").select(
        "key", "gaps", *FAULTS, "illegal", "cost", "audit")


FAULTS = ("blank", "duplicate", "truncated")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the repaired conversations; each conversation comes as its audit, then its rows in order."""
    names = ["key", "position", "edit", "role", "text"]

    def rows():
        key, audit, i, state, position = None, "", 0, 0, 0
        for batch in batches:
            for k, head, role, text in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if head is not None:  # what is left of the audit before are inserted rows
                    while i < len(audit):
                        state = AFTER[NEXT_ROLE[state]]
                        yield key, position, "I", NAMES["--ua"[state]], ""
                        position, i = position + 1, i + 1
                    key, audit, i, state, position = k, head, 0, 0, 0
                    continue
                while audit[i] == "I":
                    state = AFTER[NEXT_ROLE[state]]
                    yield key, position, "I", NAMES["--ua"[state]], ""
                    position, i = position + 1, i + 1
                edit, i = audit[i], i + 1
                if edit == "D":
                    continue
                state = AFTER[role[:1] if edit == "K" else NEXT_ROLE[state]]
                yield key, position, edit, role if edit == "K" else NAMES["--ua"[state]], text
                position += 1
        while i < len(audit):
            state = AFTER[NEXT_ROLE[state]]
            yield key, position, "I", NAMES["--ua"[state]], ""
            position, i = position + 1, i + 1

    flow = rows()
    while some := list(itertools.islice(flow, 2000)):
        made = list(zip(*some, strict=True))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], names=names)


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``key, position, edit, role, text`` of the conversations after the edits of ``diagnosed``.

    A partition holds whole conversations, one after the other, each in order. A conversation of which nothing is left
    has no rows.
    """
    texts = _prepared(rows).withColumn("digest", F.sha2("text", 256)).withColumn("head", F.lit(None).cast("string"))
    heads = audits.selectExpr(
        "key", "cast(null as bigint) as turn", "cast(null as string) as role", "cast(null as string) as text",
        "cast(null as string) as digest", "audit as head")
    dealt = texts.select(*heads.columns).unionByName(heads).repartition("key").sortWithinPartitions("key", F.expr("head is null"), *ORDER)
    return dealt.select("key", "head", "role", "text").mapInArrow(
        _edited, "key string, position bigint, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """``key, sha256`` of the ``role:text`` lines of what ``repaired_rows`` gives, read as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, out = None, None, []
        for batch in batches:
            for key, role, text in zip(*(batch.column(j).to_pylist() for j in (0, 3, 4)), strict=True):
                if key == now:
                    made.update(b"\n")
                else:
                    if made:
                        out.append((now, made.hexdigest()))
                    now, made = key, hashlib.sha256()
                made.update(f"{role}:{text}".encode())
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "sha256"])
                out = []
        if made:
            out.append((now, made.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "sha256"])

    return repaired.mapInArrow(run, "key string, sha256 string")
