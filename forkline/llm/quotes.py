"""Quotation linking: quoted passages joined to the messages they come from, and conversations in reply order.

Lines are parsed into quote levels (leading ``>`` signs, with or without spaces). Lines of one level in a row are a
passage; its letters are lower-cased and its white space collapsed before it is hashed, so re-wrapped quotes agree.
Every message offers the hashes of its own text: whole, by paragraph and by line. A passage links to the earliest
message of its conversation that offers its hash, else to the earliest of any other conversation. So each hash keeps
the earliest message and the earliest of a second conversation, for quotes in the first one's own; a line that very many messages share makes no pairs. A passage that no message offers as a whole links
where most of its lines come from.

A message replies to the message of its conversation that its first outermost linked quote comes from. Roots and
depths of replies, and places in the depth-first reply order, are found by pointer doubling, so long chains take few
rounds and no conversation is gathered in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forkline.session import stage

SIGNS = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")


def folded(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> str | None:
    """128 bits of the folded text; None for a text without words."""
    text = folded(text)
    return hashlib.md5(text.encode("utf-8")).hexdigest() if text else None


def parsed(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """The text without quotes, and its passages as (level, lines)."""
    own, passages, before = [], [], 0
    for line in (text or "").split("\n"):
        m = SIGNS.match(line)
        level = m.group(1).count(">") if m else 0
        if not level:
            own.append(line)
        elif level == before:
            passages[-1][1].append(line[m.end():])
        else:
            passages.append((level, [line[m.end():]]))
        before = level
    return "\n".join(own).strip("\n"), passages


def offers(own: str) -> list[str]:
    parts = {digest(own), *map(digest, own.split("\n")), *map(digest, re.split(r"\n[ \t]*\n", own))}
    return sorted(x for x in parts if x)


def with_parts(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, own_text, offers, passages`` of each message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage = pa.struct([("no", pa.int32()), ("level", pa.int32()), ("hash", pa.string()), ("lines", pa.list_(pa.string()))])
        for batch in batches:
            own, offered, quoted = [], [], []
            for text in batch.column(3).to_pylist():
                o, ps = parsed(text)
                own.append(None if text is None else o)
                offered.append(offers(o))
                quoted.append([{"no": i, "level": level, "hash": digest("\n".join(lines)), "lines": [x for x in map(digest, lines) if x]}
                               for i, (level, lines) in enumerate(ps)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(own, pa.string()), pa.array(offered, pa.list_(pa.string())), pa.array(quoted, pa.list_(passage))],
                names=["conv_id", "turn", "role", "own_text", "offers", "passages"])

    return messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "conv_id bigint, turn bigint, role string, own_text string, offers array<string>, "
             "passages array<struct<no: int, level: int, hash: string, lines: array<string>>>")


def _targets(wanted: DataFrame, in_conversation: DataFrame, anywhere: DataFrame) -> DataFrame:
    """``wanted`` (conv_id, turn, hash, ...) with ``to_conv`` and ``to_turn`` of the earliest other message."""
    near = wanted.join(in_conversation, ["conv_id", "hash"], "left")
    far = near.join(anywhere, "hash", "left")
    inside = "near_turn < turn"
    outside = "far.conv_id <> conv_id"
    return far.withColumn("to_conv", F.expr(f"case when {inside} then conv_id when {outside} then far.conv_id else next.conv_id end")).withColumn(
        "to_turn", F.expr(f"case when {inside} then near_turn when {outside} then far.turn else next.turn end")).drop("near_turn", "far", "next")


def linked_passages(parts: DataFrame) -> DataFrame:
    """``conv_id, turn, no, level, to_conv, to_turn`` of every quoted passage; null targets where none is found."""
    known = parts.dropna(subset=["conv_id", "turn"])
    index = known.select("conv_id", "turn", F.explode("offers").alias("hash"))
    near = index.groupBy("conv_id", "hash").agg(F.min("turn").alias("near_turn"))
    # The first two conversations of a hash; the limit is applied before the shuffle too, so no hash gathers many rows.
    first = near.withColumn("__no", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).where("__no <= 2")
    one = F.struct("conv_id", F.col("near_turn").alias("turn"))
    far = first.groupBy("hash").agg(F.min(one).alias("far"), F.min(F.when(F.col("__no") == 2, one)).alias("next"))
    far = stage(far, "earliest")
    quoted = known.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*").distinct()
    whole = stage(_targets(quoted, near, far), "passages")
    found = whole.where("to_turn is not null").select("conv_id", "turn", "no", "level", "to_conv", "to_turn")
    lost = whole.where("to_turn is null").drop("to_conv", "to_turn", "hash")
    by_line = _targets(lost.select("conv_id", "turn", "no", F.explode("lines").alias("hash")), near, far)
    votes = by_line.where("to_turn is not null").groupBy("conv_id", "turn", "no", "to_conv", "to_turn").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("conv_id", "turn", "no").agg(F.min(F.struct((-F.col("n")).alias("n"), "to_conv", "to_turn")).alias("v"))
    rest = lost.join(chosen, ["conv_id", "turn", "no"], "left").select("conv_id", "turn", "no", "level", "v.to_conv", "v.to_turn")
    return found.union(rest)


def rooted(replies: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``conv_id, turn, root_turn, depth`` from ``conv_id, turn, parent_turn`` (null at a root; parents are earlier)."""
    now = stage(replies.select(
        "conv_id", "turn", F.coalesce("parent_turn", "turn").alias("root_turn"),
        F.expr("if(parent_turn is null, 0L, 1L)").alias("depth"), F.col("parent_turn").isNull().alias("settled")), "reply")
    for _ in range(most_rounds):
        if not now.where("not settled").limit(1).count():
            return now.drop("settled")
        # Only messages that do not point to their root yet go on.
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("__root"),
                        F.col("depth").alias("__depth"), F.col("settled").alias("__settled"))
        moved = now.where("not settled").join(up, ["conv_id", "root_turn"]).select(
            "conv_id", "turn", F.col("__root").alias("root_turn"), (F.col("depth") + F.col("__depth")).alias("depth"),
            F.col("__settled").alias("settled"))
        now = stage(now.where("settled").unionByName(moved), "reply")
    raise RuntimeError("replies did not settle")


def positions(replies: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``conv_id, turn, position``: place of each message when a conversation is read in reply order, depth first.

    A message is followed by its replies, by turn, each with all replies to it; roots follow by turn. ``replies`` has one
    row per (conv_id, turn) with its ``parent_turn``. The walk around the trees goes down to a message and up from it;
    each step names the next, and pointer doubling counts the ways down that are still to come, so a conversation is
    never gathered and long chains take few rounds.
    """
    beside = Window.partitionBy("conv_id", "parent_turn").orderBy("turn")
    known = replies.select("conv_id", "turn", "parent_turn").withColumn("sibling", F.lead("turn").over(beside))
    first = replies.where("parent_turn is not null").groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    known = known.join(first, ["conv_id", "turn"], "left")
    # Steps are (turn, down or up); the step up from the last root is the end.
    step = "named_struct('turn', {0}, 'up', {1})".format
    down = known.select("conv_id", F.expr(step("turn", "false")).alias("at"), F.expr(
        f"if(child is not null, {step('child', 'false')}, {step('turn', 'true')})").alias("next"), F.lit(1).alias("ahead"))
    up = known.select("conv_id", F.expr(step("turn", "true")).alias("at"), F.expr(
        f"case when sibling is not null then {step('sibling', 'false')} when parent_turn is not null then {step('parent_turn', 'true')} end").alias("next"),
        F.lit(0).alias("ahead"))
    now = stage(down.union(up), "walk")
    for _ in range(most_rounds):
        if now.where("next is not null").isEmpty():
            left = now.where("not at.up").select("conv_id", F.col("at.turn").alias("turn"), "ahead")
            whole = left.groupBy("conv_id").agg(F.max("ahead").alias("n"))
            return left.join(whole, "conv_id").select("conv_id", "turn", (F.col("n") - F.col("ahead")).cast("bigint").alias("position"))
        then = now.select("conv_id", F.col("at").alias("next"), F.col("next").alias("__next"), F.col("ahead").alias("__ahead"))
        moved = now.where("next is not null").join(then, ["conv_id", "next"]).select(
            "conv_id", "at", F.col("__next").alias("next"), (F.col("ahead") + F.col("__ahead")).alias("ahead"))
        now = stage(now.where("next is null").unionByName(moved), "walk")
    raise RuntimeError("the walks did not end")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message without its quotes: ``conv_id, turn, role, own_text, parent_turn, root_turn, depth, position,
    n_passages, n_linked``. Sorted by ``conv_id, position`` they are the conversations in reply order, depth first.

    Null and empty texts have no passages and offer nothing. Messages with a null conversation or turn are returned
    without links. Rows that repeat (conv_id, turn) are one message for links and are each returned. Input columns
    other than ``conv_id, turn, role, text`` are ignored.
    """
    parts = stage(with_parts(messages), "parts")
    links = stage(linked_passages(parts), "links")
    parents = links.where("level = 1 and to_conv = conv_id").groupBy("conv_id", "turn").agg(F.min(F.struct("no", "to_turn")).alias("p"))
    counts = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_passages"), F.count("to_turn").alias("n_linked"))
    nodes = parts.dropna(subset=["conv_id", "turn"]).select("conv_id", "turn").distinct()
    replies = nodes.join(parents.select("conv_id", "turn", F.col("p.to_turn").alias("parent_turn")), ["conv_id", "turn"], "left")
    replies = stage(replies, "replies")
    known = replies.join(rooted(replies), ["conv_id", "turn"]).join(positions(replies), ["conv_id", "turn"]).join(counts, ["conv_id", "turn"], "left")
    return parts.select("conv_id", "turn", "role", "own_text").join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "own_text", "parent_turn", "root_turn", "depth", "position",
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
