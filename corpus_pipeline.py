"""Pipeline from raw documents to token ids, in five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last keep the columns of the documents, with their values and types, whatever their names; the last
adds its own, which replace columns of the same names. An empty table gives an empty result in each stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm import decontaminate, ngram_join, pii, quality_rules, sentencepiece_wfst
from forkline.llm.queries import MODEL, PII_KEY, read
from forkline.session import stage
from forkline.sources.registry import row_numbers


NAMED = ("doc_id", "text", "n_chars")  # the columns that stages know


def columns_kept(function: Callable) -> Callable:
    """The stage with all other columns under private names, so that none is replaced, whatever its name or type."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        private = [c if c in NAMED else f"__kept{i}" for i, c in enumerate(docs.columns)]
        return function(spark, docs.toDF(*private), sf_dir).select(*private).toDF(*docs.columns)

    return run


@columns_kept
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go.

    Null and empty texts fail the base rules. Rows are judged one by one, so repeated rows share their fate, and a null
    id is no matter; rows with a null id teach nothing. A long text is judged whole.
    """
    rules = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).where("kept")


@columns_kept
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Rows of one id and text are one document. Documents without an id, and further texts of an id, take part like all
    others; they come after all ids, by their text.
    """
    named = with_document_ids(docs)
    groups = ngram_join.jaccard_components(named, id_column="__id")
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__other"))
    return named.join(others, F.col("__id") == F.col("__other"), "left_anti").select(*docs.columns)


def with_document_ids(docs: DataFrame) -> DataFrame:
    """One row of each document with its own ``__id``: its ``doc_id``, else a number above all ids.

    Only rows whose id is null or repeated are compared; where there are none, nothing is shuffled but ids.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("__id"))
    several = stage(ids.groupBy("__id").count().where("__id is null or count > 1").select("__id"), "repeated-ids")
    docs = docs.withColumn("__id", F.col("doc_id").cast("bigint"))
    if several.isEmpty():
        return docs
    same = docs["__id"].eqNullSafe(several["__id"])
    once, rest = docs.join(several, same, "left_anti"), [c for c in docs.columns if c not in ("__id", "text")]
    each = docs.join(several, same, "left_semi").groupBy("__id", "text").agg(F.min(F.struct(*rest)).alias("__rest"))
    # The first text keeps the id, a null text being the last.
    first = each.where("__id is not null").groupBy("__id").agg(F.min(F.struct(F.col("text").isNull(), "text")).alias("__first"))
    each = each.join(first, "__id", "left").withColumn(
        "__named", F.expr("__id is not null and __first.text <=> text")).drop("__first")
    each = stage(each.withColumn("__order", F.struct("text", "__id")), "repeated-documents")
    top = ids.agg(F.coalesce(F.max("__id"), F.lit(0))).first()[0]
    others = row_numbers(each.where("not __named"), "__order", "__no").withColumn("__id", F.lit(top) + 1 + F.col("__no"))
    each = each.where("__named").unionByName(others.drop("__no")).select("__id", "text", "__rest.*")
    return stage(once.unionByName(each), "documents")


@columns_kept
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null and empty texts have no words and stay; repeated rows are each judged."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.where("not contaminated")


@columns_kept
def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts are replaced by surrogates; ``n_chars`` follows the new text.

    Null and empty texts stay as they are; an entity has one surrogate in all texts and repeated rows.
    """
    made = pii.pseudonymised(docs, PII_KEY)
    return made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left; a null or empty text has none."""
    return sentencepiece_wfst.encoded(docs, MODEL)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("PII surrogates", surrogates),
    ("SentencePiece encoding", encode),
]

#: The learned list of the first stage and the keyed draws of the fourth have no SQL form; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
