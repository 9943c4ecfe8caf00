"""URL filters as a temporal list join, with DataFrame functions only.

Dated changes of list entries become validity intervals. Every capture is evaluated against the entries for its host,
its parent domains and its path that were active when it was fetched. A bitmap of the listed domains, of fixed size,
drops the hosts' suffixes that no entry can match before anything is shuffled, so a top-level domain is no key unless it
is listed. The as-of join meets on (domain, week): intervals are spread over the weeks they touch, so a listed domain
with very many captures is as many keys as its captures span weeks, and Spark splits what is still skewed; no more
intervals are compared with a capture than were active in its week. Of the matching entries the most specific decides: more
labels, then the longer path, then allow before block, then the later start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forkline.session import stage

FILTER_BITS = 21  # of the bitmap of listed domains: at most 2^18 rows are broadcast


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and trailing dots; null where there is none."""
    got = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.nullif(F.regexp_replace(got, r"\.+$", ""), F.lit(""))


def path(url: Column) -> Column:
    """Path of a URL as it is written, without query and fragment; ``/`` where it is empty, and for text without a host."""
    got = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(got == "", "/").otherwise(got)


def intervals(changes: DataFrame) -> DataFrame:
    """``domain, path, action, valid_from, valid_to`` from ``domain, path, action, changed_on, change`` (add or remove).

    An entry is active from the day it is added up to, not including, the day of its next change; adding it again
    only goes on. Of several changes on a day the removal comes first, so an entry removed and added that day is
    active. An open end is null. Rows with a null domain, action or day are no entries; a null path is ``/``.
    """
    clean = changes.select(
        F.lower("domain").alias("domain"), F.coalesce("path", F.lit("/")).alias("path"), "action", "changed_on", "change"
    ).dropna(subset=["domain", "action", "changed_on"]).distinct()
    # One state per entry and day before the window, so it sees a row per day at most.
    daily = clean.groupBy("domain", "path", "action", "changed_on").agg(F.max((F.col("change") == "add").cast("int")).alias("on"))
    order = W.partitionBy("domain", "path", "action").orderBy("changed_on")
    runs = daily.withColumn("valid_to", F.lead("changed_on").over(order))
    return runs.where("on = 1").select("domain", "path", "action", F.col("changed_on").alias("valid_from"), "valid_to")


def _listed(seen: DataFrame, entries: DataFrame) -> DataFrame:
    """``seen`` without most rows whose ``__domain`` is no entry's domain: a broadcast bitmap of hashes tells."""
    at, bit = f"shiftright(pmod(xxhash64({{0}}), {1 << FILTER_BITS}), 3)", "cast(pmod(xxhash64({0}), 8) as int)"
    octets = entries.groupBy(F.expr(at.format("domain")).alias("__at")).agg(
        F.expr(f"bit_or(shiftleft(1, {bit.format('domain')}))").alias("__bits"))
    marked = seen.withColumn("__at", F.expr(at.format("__domain"))).join(F.broadcast(octets), "__at")
    return marked.where(f"(shiftright(__bits, {bit.format('__domain')}) & 1) = 1").select(*seen.columns)


def evaluated(captures: DataFrame, entries: DataFrame, *, url_column: str = "url", day_column: str = "fetched_on") -> DataFrame:
    """``captures`` with ``host``, ``verdict`` (block, allow or pass), and ``matched_domain``, ``matched_path``,
    ``valid_from``, ``valid_to`` of the deciding entry; columns of these names are replaced.

    ``entries`` are intervals. A capture with a null URL, host or day passes. Repeated captures are each evaluated.
    With an empty list all pass.
    """
    made = ("host", "verdict", "matched_domain", "matched_path", "valid_from", "valid_to")
    # Stored with their numbers: every branch, and a task run again, sees the same number for a row.
    source = stage(captures.drop(*made).withColumn("__row", F.monotonically_increasing_id()), "captures")
    week = lambda c: F.floor(F.datediff(c, F.lit("1970-01-05")) / 7).cast("int")
    # What an entry can match: each suffix of the host's labels.
    seen = source.select(
        "__row", F.col(f"`{day_column}`").alias("__day"), week(F.col(f"`{day_column}`")).alias("__week"),
        host(F.col(f"`{url_column}`")).alias("__host"), path(F.col(f"`{url_column}`")).alias("__path"))
    labels = F.split("__host", r"\.")
    seen = seen.dropna(subset=["__host", "__day"]).withColumn("__label", F.explode(F.sequence(F.lit(1), F.size(labels))))
    seen = seen.withColumn("__domain", F.array_join(F.slice(labels, F.col("__label"), F.size(labels)), "."))
    entries = stage(entries, "entries")
    seen = _listed(seen.drop("__host", "__label"), entries)
    # No interval is followed beyond the weeks of the captures.
    span = source.agg(F.min(week(F.col(f"`{day_column}`"))).alias("lo"), F.max(week(F.col(f"`{day_column}`"))).alias("hi")).first()
    spread = entries.withColumn("__lo", F.lit(span["lo"]).cast("int")).withColumn("__hi", F.lit(span["hi"]).cast("int")).where("__hi is not null")
    since = F.greatest(week(F.col("valid_from")), F.col("__lo"))
    until = F.least(F.coalesce(week(F.date_sub("valid_to", 1)), F.col("__hi")), F.col("__hi"))
    spread = spread.where(since <= until).withColumn("__week", F.explode(F.sequence(since, until))).drop("__lo", "__hi")
    met = seen.join(spread, (F.col("__domain") == F.col("domain")) & (seen["__week"] == spread["__week"])).where(
        "valid_from <= __day and (valid_to is null or __day < valid_to) and startswith(__path, path)")
    best = met.groupBy("__row").agg(F.max(F.struct(
        F.size(F.split("domain", r"\.")).alias("labels"), F.length("path").alias("length"),
        (F.col("action") == "allow").alias("allow"), "valid_from", "domain", "path", "action", "valid_to")).alias("__best"))
    out = source.join(best, "__row", "left").withColumn("host", host(F.col(f"`{url_column}`")))
    return out.select(
        *[F.col(f"`{c}`") for c in source.columns if c != "__row"], "host", F.coalesce("__best.action", F.lit("pass")).alias("verdict"),
        F.col("__best.domain").alias("matched_domain"), F.col("__best.path").alias("matched_path"),
        F.col("__best.valid_from").alias("valid_from"), F.col("__best.valid_to").alias("valid_to"))
