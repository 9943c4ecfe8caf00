"""Token counts of whole texts by a two-tier lookup of pre-tokens in the map task.

No piece of the vocabulary holds a space after another character, so a text falls apart at its runs of spaces into
pre-tokens that are encoded independently. Lengths of frequent pre-tokens, found on a bounded sample of texts, are
broadcast as one compact table; every other pre-token is encoded by the library once and kept in the worker's own
bounded cache. Pre-tokens are never shuffled, and the tables only save time: every text is counted in full.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline.llm.arrow import add_columns
from forkline.llm.normaliser import Normaliser

MARK = "▁"  # the vocabulary's sign for a space
RUNS = re.compile(f"{MARK}+[^{MARK}]*")
LONGEST_KEPT = 64  # characters of a pre-token that a cache may hold


def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_model(sp) -> None:
    """Refuse a model whose texts do not fall apart at spaces."""
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_unknown(i)) and re.search(f"[^{MARK}]{MARK}", piece):
            raise ValueError(f"piece {i} crosses a word border")
    if len(sp.encode("a  b ")) != len(sp.encode("a")) + len(sp.encode(" b")) + 1:
        raise ValueError("the model's normaliser changes spaces")


def pre_tokens(text: str) -> list[str]:
    """What the library would encode one by one; each stands for itself after one space sign.

    An empty string is a lone space sign at the end of the text.
    """
    if "  " in text or MARK in text or text.startswith(" "):
        return [x[1:] for x in RUNS.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


class Lengths(dict):
    """Pre-token lengths: the frequent ones, and what this worker has met since."""

    def __init__(self, sp, normal: Normaliser, frequent: dict[str, int], most: int):
        super().__init__(frequent)
        self.sp, self.normal, self.frequent, self.most = sp, normal, frequent, most
        self[""] = 1

    def __missing__(self, word: str) -> int:
        n = len(self.sp.encode(word))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
                self[""] = 1
            self[word] = n
        return n


def count_tokens(text: str | None, lengths: Lengths) -> int:
    return sum(map(lengths.__getitem__, pre_tokens(lengths.normal(text)))) if text else 0


def without_characters(model: bytes) -> tuple[bytes, bytes]:
    """The model without its table of characters, and the table: whole texts are rewritten before they fall apart, as a
    character may become a space, and their parts are not rewritten again."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(model)
    table = proto.normalizer_spec.precompiled_charsmap
    if not table:
        return model, b""
    proto.normalizer_spec.precompiled_charsmap = b""
    return proto.SerializeToString(), table


_caches: dict[tuple, Lengths] = {}


def named(value: bytes) -> str:
    """Name of what a worker keeps: equal for equal content only, whatever object holds it."""
    return hashlib.sha256(value).hexdigest()


def _cache(name: tuple, model, frequent) -> Lengths:
    """The worker's cache for a name (model, frequent table, size); one at a time."""
    if name not in _caches:
        _caches.clear()
        plain, charsmap = model.value
        _caches[name] = Lengths(processor(plain), Normaliser(charsmap), frequent.value, name[-1])
    return _caches[name]


def frequent_pre_tokens(docs: DataFrame, text_column: str, sample_rows: int, table_rows: int, sample_bytes: int = 65_536) -> list[str]:
    """The most frequent pre-tokens of about ``sample_rows`` texts chosen by hash, of at most ``sample_bytes`` each.

    The sample decides only what the first tier holds, never a count.
    """
    texts = docs.select(F.col(text_column).alias("text"))
    total = texts.count()
    share = min(1.0, sample_rows / max(1, total))
    chosen = texts.where(F.expr(f"pmod(xxhash64(text), 1000000) < {share * 1e6} and octet_length(text) <= {sample_bytes}"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(w for w in pre_tokens(text) if len(w) <= LONGEST_KEPT)
        top = sorted(seen, key=lambda w: (-seen[w], w))[:table_rows]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string())], names=["word"])

    return [r["word"] for r in chosen.limit(2 * sample_rows).repartition(1).mapInArrow(count, "word string").collect()]


def token_counts(
    docs: DataFrame, model_path: str, *, text_column: str = "text", limit: int = 4096, sample_rows: int = 2_000,
    table_rows: int = 32_768, cache_rows: int = 400_000,
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; columns of these names are replaced.

    ``model_path`` is read on the driver and sent to the workers. A null or empty text has no bytes and no tokens.
    ``cache_rows`` bounds a worker's memory; a full cache starts anew.
    """
    context = docs.sparkSession.sparkContext
    with open(model_path, "rb") as f:
        model = f.read()
    check_model(processor(model))
    plain, charsmap = without_characters(model)
    sp = processor(plain)
    words = frequent_pre_tokens(docs, text_column, sample_rows, table_rows)
    sent = context.broadcast((plain, charsmap))
    table = dict(zip(words, map(len, sp.encode(words)), strict=True))
    frequent = context.broadcast(table)
    name = (named(model), named(repr(table).encode()), cache_rows)

    def compute(texts: pa.Array) -> list[pa.Array]:
        lengths = _cache(name, sent, frequent)
        n = [count_tokens(t, lengths) for t in texts.to_pylist()]
        return [pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64()), pa.array(n, pa.int64())]

    out = add_columns(docs, text_column, compute, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
