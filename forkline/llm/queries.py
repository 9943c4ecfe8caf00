"""The operators over the given tables: one query each."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm import (
    conversation_repair, decontaminate, ngram_join, pii, quality_rules, quotes, runs, secret_scan, sentencepiece_wfst, simhash,
    token_counts, url_filter, warc,
)
from forkline.session import scratch_path, stage

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PII_KEY = b"surrogates of the documents table"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all documents. The labelled findings are those of documents in ``labels``, taken for reviewed; the
    reviewer is stood in for by the format of issued tokens, 160 bits in hexadecimal of one case, which is no feature."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    path = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt"))
    found = stage(secret_scan.findings(docs, path=path).drop("source", "lang"), "findings")
    featured = secret_scan.with_features(found, secret_scan.dictionary(docs))
    reviewed = featured.join(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    verdict = F.col("candidate").rlike("^([0-9a-f]{40}|[0-9A-F]{40})$").cast("int")
    model = secret_scan.fit(reviewed.withColumn("verdict", verdict), "verdict")
    return secret_scan.scored(featured, model).select(
        "doc_id", "number", F.sha2("candidate", 256).alias("candidate_sha256"), *secret_scan.FEATURES, "score", "is_secret")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_wfst.encoded(docs, MODEL).select("doc_id", "n_tokens", "round_trip", "token_ids")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept", "rule")


def url_captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures of the pages with a day each, and dated changes of a list over the pages' domains."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.expr("date_add(date '2024-01-01', cast(pmod(page_id * 37, 366) as int))"))
    domains = pages.select(F.regexp_replace(url_filter.host(F.col("url")), r"^(www|m|blog)\.", "").alias("domain")).distinct()
    domains = domains.dropna().withColumn("k", F.expr("cast(conv(substring(md5(domain), 1, 7), 16, 10) as bigint)"))
    day = "date_add(date '2024-01-01', cast({} as int))".format
    changes = domains.where("k % 2 = 0 or domain rlike 'casino|bets|pills'").select("domain", F.expr(
        f"inline(array(named_struct('path', '/', 'action', 'block', 'changed_on', {day('k % 300')}, 'change', 'add'),"
        f"if(k % 3 <> 0, named_struct('path', '/', 'action', 'block', 'changed_on', {day('k % 300 + 20 + k % 97')}, 'change', 'remove'), null),"
        f"if(k % 5 = 0, named_struct('path', '/', 'action', 'block', 'changed_on', {day('k % 300 + 150')}, 'change', 'add'), null),"
        f"if(k % 4 = 0, named_struct('path', '/en/', 'action', 'allow', 'changed_on', {day('k % 200')}, 'change', 'add'), null)))"))
    return captures, changes.dropna()


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, changes = url_captures(spark, sf_dir)
    return url_filter.evaluated(captures, url_filter.intervals(changes))


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    made = warc.captures(warc.read_archives(spark, path))
    return made.select(
        warc.page_field(F.col("metadata.fields")).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", warc.page_field(F.col("first_fields"))).alias("refers_to"))


def quoting_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail: each turn quotes the turn before it in full, and the first line of the one before that."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    one = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("said").alias("one"))
    two = said.select("conv_id", (F.col("turn") + 2).alias("turn"), F.regexp_extract("said", "^[^\n]*", 0).alias("two"))
    quoted = turns.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    return quoted.select("conv_id", "turn", "role", F.concat_ws(
        "\n", F.concat(F.lit("> > "), "two"), F.concat(F.lit("> "), F.regexp_replace("one", "\n", "\n> ")), "text").alias("text"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quoting_messages(spark, sf_dir))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, PII_KEY)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, MODEL).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by their ids, repeat some of their words up to the end; without an id none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                h = -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
                words = texts[k].encode().split() if texts[k] and h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, docs.select("doc_id", "text").schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = runs.tandem_runs(planted_periods(read(spark, sf_dir, "documents")))
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as no, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return made.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.no")).alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * -best.no div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def damaged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the turns, by their names, are dropped, emptied, left without sentence ends, repeated or made the user's."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    shown = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    turns = turns.withColumn("h", F.crc32(shown) % 20).where("h <> 0").withColumn(
        "role", F.expr("if(h = 4, 'user', coalesce(role, ' '))")).withColumn(
        "text", F.expr("case h when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '') else coalesce(text, ' ') end"))
    return turns.withColumn("copy", F.explode(F.expr("sequence(1, if(h = 3, 2, 1))"))).select("conv_id", "turn", "role", "text")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged_turns(spark, sf_dir)
    audits = stage(conversation_repair.diagnosed(rows), "audits")
    shas = conversation_repair.digests(conversation_repair.repaired_rows(rows, audits))
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("key", conversation_repair.conv_key(F.col("conv_id")))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(audits, "key", "left").join(shas, "key", "left").select(
        "conv_id", *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_sentencepiece, op3_ngram_jaccard_join, op4_quality_rules, op5_url_filter, op6_warc_transactions,
        op7_quotation_linking, op8_benchmark_decontamination, op9_pii_surrogates, op10_token_counts, op11_simhash,
        op12_periodic_runs, op13_conversation_repair,
    )
}
