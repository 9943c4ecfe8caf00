"""Source registry and row normalisers: raw benchmark rows → the query schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forkline.functions.text import strip
from forkline.session import stage


def _letter_ordinal(key: Column) -> Column:
    """A single letter → 0, 1, …; anything else → NULL."""
    return F.when(key.rlike(r"^[A-Z]$"), F.ascii(key) - 65)


def arc(df: DataFrame) -> DataFrame:
    """``id, question, choices{text,label}, answerKey``: the key is looked up in the labels, else it is a letter."""
    key = F.upper(strip(F.col("answerKey")))
    position = F.array_position(F.col("choices.label"), key).cast("int")
    return df.select(
        "*",
        strip(F.col("question")).alias("text"),
        F.col("choices.text").alias("_choices"),
        F.coalesce(F.when(position > 0, position - 1), _letter_ordinal(key)).alias("answer_index"),
        F.create_map(F.lit("native_id"), F.col("id").cast("string")).alias("metadata"),
    )


def mmlu_pro(df: DataFrame) -> DataFrame:
    """``question, options|choices, answer_index?, answer, subject?|category?``."""

    def opt(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    options = F.coalesce(
        *[F.when(F.size(opt(c, "array<string>")) > 0, opt(c, "array<string>")) for c in ("options", "choices")]
    )
    key = F.upper(strip(F.col("answer").cast("string")))
    subject = F.coalesce(F.nullif(opt("subject", "string"), F.lit("")), opt("category", "string"), F.lit("unknown"))
    return df.select(
        "*",
        strip(F.col("question")).alias("text"),
        options.alias("_choices"),
        F.coalesce(opt("answer_index", "int").cast("int"), _letter_ordinal(key)).alias("_answer"),
        F.create_map(F.lit("subject"), subject).alias("metadata"),
    ).drop("answer_index").withColumnRenamed("_answer", "answer_index")


def truthfulqa(df: DataFrame) -> DataFrame:
    """``question, mc1_targets{choices,labels}``: exactly one label is 1."""
    labels = F.col("mc1_targets.labels")
    one = F.size(F.filter(labels, lambda x: x == 1)) == 1
    return df.select(
        "*",
        strip(F.col("question")).alias("text"),
        F.col("mc1_targets.choices").alias("_choices"),
        F.when(one, (F.array_position(labels, F.lit(1)) - 1).cast("int")).alias("answer_index"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def hellaswag(df: DataFrame) -> DataFrame:
    """``ctx|ctx_a,ctx_b, endings, label``."""
    joined = strip(F.concat(F.coalesce("ctx_a", F.lit("")), F.lit(" "), F.coalesce("ctx_b", F.lit(""))))
    return df.select(
        "*",
        F.coalesce(F.nullif("ctx", F.lit("")), joined).alias("text"),
        F.col("endings").alias("_choices"),
        F.expr("try_cast(label AS int)").alias("answer_index"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


@dataclass(frozen=True)
class SourceSpec:
    """Where a labelled corpus lies and how its rows are read."""

    name: str
    normaliser: Callable[[DataFrame], DataFrame]
    splits: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    order_by: str = "id"
    schema: str | None = None
    aliases: tuple[str, ...] = field(default=())


# Registered names, the splits they use and the splits they must not use.
REGISTRY: dict[str, SourceSpec] = {
    s.name: s
    for s in (
        SourceSpec(
            "ARC-Challenge", arc, ("validation", "test"), ("train",), "id",
            "id STRING, question STRING, choices STRUCT<text: ARRAY<STRING>, label: ARRAY<STRING>>, answerKey STRING",
        ),
        SourceSpec(
            "MMLU_PRO", mmlu_pro, ("test",), ("validation",), "question_id",
            "question_id BIGINT, question STRING, options ARRAY<STRING>, answer_index INT, answer STRING, "
            "subject STRING, category STRING",
            aliases=("MMLU-Pro",),
        ),
        SourceSpec(
            "TruthfulQA", truthfulqa, ("validation",), (), "question",
            "question STRING, mc1_targets STRUCT<choices: ARRAY<STRING>, labels: ARRAY<INT>>",
        ),
        SourceSpec(
            "HellaSwag", hellaswag, ("validation",), (), "ind",
            "ind BIGINT, ctx STRING, ctx_a STRING, ctx_b STRING, endings ARRAY<STRING>, label STRING",
        ),
    )
}


def register(spec: SourceSpec) -> None:
    REGISTRY[spec.name] = spec


def unregister(name: str) -> None:
    REGISTRY.pop(name, None)


def get_source(name: str) -> SourceSpec:
    for spec in REGISTRY.values():
        if name == spec.name or name in spec.aliases:
            return spec
    raise KeyError(f"unknown source {name!r}; registered: {sorted(REGISTRY)}")


def file_row_numbers(files: DataFrame, out: str = "row_index") -> DataFrame:
    """0-based position of each row of a Parquet scan, files by name and rows as they lie in them.

    Only the row counts of files are added up; rows stay where they are read. Equal rows have places of their own, the
    same ones on every run.
    """
    placed = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = files.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count("*").alias("_n"))
    # One row per file, in prefix sums; stored, its size is known, and Spark broadcasts it where it is small.
    before = stage(counts.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before")), "file-rows")
    return placed.join(before, "_file").withColumn(out, F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")


def row_numbers(df: DataFrame, order_by: str, out: str = "row_index") -> DataFrame:
    """0-based position in ``order_by`` order, contiguous over the whole table.

    Range-partition, write the partition number with the rows (so that it cannot
    change on a retry), count each partition, rank inside partitions. Partition
    counts are one row per partition.
    """
    ranged = stage(df.repartitionByRange(order_by).withColumn("_part", F.spark_partition_id()), "row-numbers")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order_by)) - 1
    return (
        ranged.withColumn("_local", local)
        .join(before, "_part")
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_part", "_local", "_before")
    )


def normalise(df: DataFrame, spec: SourceSpec, split: str | Column, row_index: str = "row_index") -> DataFrame:
    """Rows of one source in the query schema, with a reason where a row cannot be read."""
    split_col = split if isinstance(split, Column) else F.lit(split)
    out = spec.normaliser(df)
    reject = (
        F.when(F.col("_choices").isNull(), "no choices")
        .when(F.col("answer_index").isNull(), "bad answer")
    )
    return out.select(
        F.concat_ws(":", F.lit(spec.name), split_col, F.col(row_index).cast("string")).alias("query_id"),
        F.lit(spec.name).alias("dataset"),
        "text",
        F.col("_choices").alias("choices"),
        F.col("answer_index").cast("int").alias("answer_index"),
        "metadata",
        reject.alias("reject_reason"),
    )


def load_corpus(spark: SparkSession, spec: SourceSpec, root: str, fmt: str = "parquet") -> DataFrame:
    """All allowed splits of a source, read from ``root/<split>``; bad or duplicate rows are an error.

    Rows of Parquet files are numbered as they lie in them, those of other formats by the source's key.
    """
    parts = []
    for split in spec.splits:
        if split in spec.exclude:
            raise ValueError(f"split {split!r} of {spec.name} must not be used")
        reader = spark.read.schema(spec.schema) if spec.schema else spark.read
        read = reader.format(fmt).load(f"{root}/{split}")
        rows = file_row_numbers(read) if fmt == "parquet" else row_numbers(read, spec.order_by)
        parts.append(normalise(rows, spec, split))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bad = out.filter(F.col("reject_reason").isNotNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{spec.name}: {bad[0]['reject_reason']} in {bad[0]['query_id']}")
    require_unique(out)
    return out.drop("reject_reason")


def require_unique(df: DataFrame, id_col: str = "query_id") -> None:
    twice = df.groupBy(id_col).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {id_col} {twice[0][id_col]!r}")
