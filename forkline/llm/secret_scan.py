"""Secret scans: candidates from texts, and a random forest that removes false positives. DataFrame functions only.

A candidate is a run of 16 or more characters of keys and tokens; shorter passwords, and those with other signs, are
not candidates. Its features are its length, the share of transitions between classes of characters, the share of its
letter triples that dictionary words have, its path, and words before and after it. The forest is trained with spark.ml on labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.session import stage

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}+"
NEAR = 60  # characters before and after a candidate that are looked at
CREDENTIAL = r"(?i)\b(token|secret|passw(or)?d|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)\b"
HARMLESS = r"(?i)\b(sha1|sha256|md5|commit|uuid|checksum|etag|integrity|digest|example)\b"
TRY_PATH = r"(?i)(^|[/_.\-])(test|tests|example|examples|doc|docs|sample|fixture|fixtures|mock)s?([/_.\-]|$)"

FEATURES = [
    "length", "digit_share", "upper_share", "transitions", "distinct_share", "coverage", "path_depth", "path_trial",
    "assigned", "quoted", "credential_near", "harmless_near", "words_before",
    "credential_after", "harmless_after", "words_after",
]


def dictionary(texts: DataFrame, text_column: str = "text", least_share: float = 0.001) -> list[str]:
    """Letter triples that words of at least ``least_share`` of the texts have, candidates left out.

    The share is of the corpus, so a larger corpus does not make every triple known. A task hands on one row for each
    of the 26^3 triples at most. Null texts have no words, but count as texts.
    """
    prose = F.lower(F.regexp_replace(F.coalesce(f"`{text_column}`", F.lit("")), CANDIDATE, " "))
    found = F.array_distinct(F.flatten(F.transform(
        F.array_distinct(F.regexp_extract_all(prose, F.lit("[a-z]{3,}"), F.lit(0))),
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))
    counts = texts.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
    n = {r["t"]: r["n"] for r in counts}
    total = n.pop("", 0)
    return sorted(t for t, k in n.items() if k >= least_share * total)


def findings(docs: DataFrame, *, text_column: str = "text", path: Column | None = None) -> DataFrame:
    """One row per candidate: all columns of ``docs`` but the text, ``number``, ``path``, ``candidate``, ``before``
    and ``after`` (what precedes and follows it); columns of these names are replaced.

    Null and empty texts have none. Every candidate of the whole text is found, also repeated ones.
    """
    made = ("number", "path", "candidate", "before", "after")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in made and c != text_column]
    text = F.col(f"`{text_column}`")
    some = docs.where(text.rlike(CANDIDATE)).select(
        *keep, (path if path is not None else F.lit(None).cast("string")).alias("path"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("__found"), F.split(text, CANDIDATE).alias("__between"))
    lead, trail = F.slice("__between", F.lit(1), F.size("__found")), F.slice("__between", F.lit(2), F.size("__found"))
    some = some.withColumn("__lead", F.transform(lead, lambda x: F.right(x, F.lit(NEAR))))
    some = some.withColumn("__trail", F.transform(trail, lambda x: F.left(x, F.lit(NEAR))))
    each = some.select("*", F.posexplode(F.arrays_zip("__found", "__lead", "__trail")))
    return each.select(*keep, F.col("pos").alias("number"), "path", F.col("col.__found").alias("candidate"),
                       F.col("col.__lead").alias("before"), F.col("col.__trail").alias("after"))


def with_features(found: DataFrame, triples: list[str]) -> DataFrame:
    """``found`` (of ``findings``) with the columns ``FEATURES``; columns of these names are replaced.

    A null path has depth 0 and is no trial; a null text around a candidate gives no flag. ``coverage`` is the share of
    the candidate's different lower-case triples that are among ``triples``.
    """
    c, low = F.col("candidate"), F.lower("candidate")
    chars = F.split(F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "+/_-", "++++"), "")
    n = F.length(c).cast("double")
    changes = F.expr("size(filter(sequence(1, size(__kinds) - 1), i -> __kinds[i] <> __kinds[i - 1]))")
    own = F.expr("array_distinct(transform(sequence(1, length(__low) - 2), i -> substring(__low, i, 3)))")
    known = F.expr(f"filter(__own, t -> t in ({', '.join(map(repr, triples))}))" if triples else "filter(__own, t -> false)")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return (
        found.withColumn("__kinds", F.filter(chars, lambda x: x != "")).withColumn("__low", low).withColumn("__own", own)
        .withColumn("length", n)
        .withColumn("digit_share", F.length(F.regexp_replace(c, "[^0-9]", "")) / n)
        .withColumn("upper_share", F.length(F.regexp_replace(c, "[^A-Z]", "")) / n)
        .withColumn("transitions", changes / n)
        .withColumn("distinct_share", F.size(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))) / n)
        .withColumn("coverage", F.size(known) / F.size("__own"))
        .withColumn("path_depth", F.coalesce(F.size(F.split("path", "/")), F.lit(0)).cast("double"))
        .withColumn("path_trial", flag(F.col("path").rlike(TRY_PATH)))
        .withColumn("assigned", flag(F.col("before").rlike("[=:][ \t]*[\"'`]?$")))
        .withColumn("quoted", flag(F.col("before").rlike("[\"'`]$")))
        .withColumn("credential_near", flag(F.col("before").rlike(CREDENTIAL)))
        .withColumn("harmless_near", flag(F.col("before").rlike(HARMLESS)))
        .withColumn("words_before", F.size(F.filter(F.split("before", r"\s+"), lambda x: F.length(x) > 1)).cast("double"))
        .withColumn("credential_after", flag(F.col("after").rlike(CREDENTIAL)))
        .withColumn("harmless_after", flag(F.col("after").rlike(HARMLESS)))
        .withColumn("words_after", F.size(F.filter(F.split("after", r"\s+"), lambda x: F.length(x) > 1)).cast("double"))
        .drop("__kinds", "__low", "__own")
    )


def fit(labelled: DataFrame, label_column: str, *, sample_rows: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel | None:
    """Forest from at most ``sample_rows`` labelled findings with features (1 secret, 0 not), the first by hash.

    Rows with a null label are left out. None where the labels do not hold both classes.
    """
    rows = labelled.where(F.col(label_column).isNotNull()).select(F.col(label_column).cast("double").alias("label"), "candidate", "before", *FEATURES)
    rows = rows.orderBy(F.xxhash64("candidate", "before"), "label").limit(sample_rows).drop("before")
    rows = stage(rows.drop("candidate"), "labelled")
    if rows.select("label").distinct().count() < 2:
        return None
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(ready)


def scored(found: DataFrame, model: RandomForestClassificationModel | None, cut: float = 0.5) -> DataFrame:
    """``found`` (with features) and ``score``, ``is_secret``. Without a model every candidate stays, with a null score."""
    if model is None:
        return found.withColumn("score", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(found)
    out = model.copy().setFeaturesCol("__features").setProbabilityCol("__probability").setRawPredictionCol("__raw").setPredictionCol("__class").transform(ready)
    out = out.withColumn("score", vector_to_array("__probability")[1]).withColumn("is_secret", F.col("score") >= cut)
    return out.drop("__features", "__probability", "__raw", "__class")
