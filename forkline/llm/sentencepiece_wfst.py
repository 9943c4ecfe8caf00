"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is compiled from a model: the normaliser's table of characters (NFKC, case folding; the identity where
the model has none), by which the longest stretch at a place is rewritten, then a space sign for each space and one
before the text;
every piece is a chain of arcs that ends in its id; a character that no piece has passes through byte arcs. A text is
composed with it as a lattice: an arc for each piece that matches at a position. The path of least weight in the
tropical semiring (weights add along a path, the least of several paths counts) is the encoding.

* Unigram models: an arc weighs minus the piece's score.
* Merge (BPE) models: an arc weighs 0 after a piece with which it may stand, else infinity. Two pieces may stand side
  by side if merging their joined characters by rank gives just these two. The merges of a whole text give the one
  sequence in which all neighbours may stand, so one path is finite, and the search may go depth first.

No arc crosses a place between two characters that stand side by side in no piece, so the lattice of a text falls
apart there, and always at its runs of spaces. The segments between are solved once and kept in the worker's bounded
cache. Decoding runs the transducer backwards:
ids to bytes, space signs to spaces, without the sign that was put first.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline.llm.arrow import add_columns
from forkline.llm.normaliser import Normaliser
from forkline.llm.token_counts import LONGEST_KEPT, MARK, check_model, named, pre_tokens, processor

INFINITY = float("inf")


class Transducer:
    """Compiled pieces (text, score, id), byte ids and kind of model."""

    def __init__(self, pieces: Iterable[tuple[str, float, int]], bytes_from: dict[int, int], unknown: int, merges: bool):
        self.merges, self.bytes_from, self.unknown = merges, bytes_from, unknown
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for text, score, number in pieces:
            self.rank[text], self.id[text] = -score, number
        self.trie: dict = {}  # character to [next characters or None, id or -1]
        for text, number in self.id.items():
            node, entry = self.trie, None
            for ch in text:
                if node is None:
                    node = entry[0] = {}
                entry = node.setdefault(ch, [None, -1])
                node = entry[0]
            entry[1] = number
        worst = max(self.rank.values(), default=0.0)
        self.fallback_weight = worst + 10.0  # more than any piece
        self.text = {number: text for text, number in self.id.items()}
        self.inner = {a + b for text in self.id for a, b in zip(text, text[1:], strict=False)}
        self.longest = max(map(len, self.id), default=0)
        self.beside: dict[int, bool] = {}

    @classmethod
    def compile(cls, sp) -> Transducer:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(sp.serialized_model_proto())
        kind = pb.ModelProto.SentencePiece
        normal, by_byte = [], {}
        for i, piece in enumerate(proto.pieces):
            if piece.type == kind.BYTE:
                by_byte[int(piece.piece[3:5], 16)] = i
            elif piece.type == kind.NORMAL:
                normal.append((piece.piece, piece.score, i))
        return cls(normal, by_byte, sp.unk_id(), proto.trainer_spec.model_type == pb.TrainerSpec.BPE)

    def merged(self, text: str) -> list[str]:
        """Pieces after merging neighbours by rank, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = INFINITY, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1], INFINITY)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, left: int, right: int) -> bool:
        """Whether the merges of two joined pieces give just these; ``left`` is -1 at the start."""
        known = self.beside.get(left << 32 | right)
        if known is None:
            if len(self.beside) > 500_000:
                self.beside.clear()
            want = [self.text[right]] if left < 0 else [self.text[left], self.text[right]]
            known = self.beside[left << 32 | right] = self.merged("".join(want)) == want
        return known

    def segments(self, text: str) -> list[str]:
        """The text cut where no arc can cross."""
        cuts = [i + 1 for i, pair in enumerate(zip(text, text[1:], strict=False)) if pair[0] + pair[1] not in self.inner]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if cuts else [text]

    def shortest(self, text: str) -> list[tuple[int, int]]:
        """(end, id) of the arcs on the path of least weight; the id is -2 for a character that no piece has."""
        return self._only_finite(text) if self.merges else self._least(text)

    def _arcs(self, text: str, i: int) -> list[tuple[int, int]]:
        """(end, id) of the arcs that start at a place, by length; a character that no piece has always passes."""
        arcs, node, j = [], self.trie, i
        for ch in text[i : i + self.longest]:
            entry = node.get(ch)
            if entry is None:
                break
            j += 1
            node, number = entry
            if number >= 0:
                arcs.append((j, number))
            if node is None:
                break
        if text[i] not in self.id:
            arcs.append((i + 1, -2))
        return arcs

    def _only_finite(self, text: str) -> list[tuple[int, int]]:
        """The path of weight 0, depth first: all others are infinite, so the first that is complete is the least.

        A place has one finite way to it; if no arc leads on from there, the place is never tried again.
        """
        n, beside = len(text), self.beside
        path: list[tuple[int, int]] = []
        open_arcs, dead = [self._arcs(text, 0)], set()
        at, left = 0, -1
        while at < n:
            arcs = open_arcs[-1]
            while arcs:
                end, number = arcs.pop()
                if end in dead:
                    continue
                if left != -2 and number != -2:
                    stands = beside.get(left << 32 | number)
                    if stands is None:
                        stands = self._stands(left, number)
                    if not stands:
                        continue
                path.append((end, number))
                at, left = end, number
                if at < n:
                    open_arcs.append(self._arcs(text, at))
                break
            else:
                dead.add(at)
                open_arcs.pop()
                path.pop()
                at, left = path[-1] if path else (0, -1)
        return path

    def _least(self, text: str) -> list[tuple[int, int]]:
        n = len(text)
        weight, back = [0.0] + [INFINITY] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            for end, number in self._arcs(text, i):
                w = weight[i] + (self.rank[self.text[number]] if number >= 0 else self.fallback_weight)
                if w < weight[end]:
                    weight[end], back[end] = w, (i, number)
        path, j = [], n
        while j:
            i, number = back[j]
            path.append((j, number))
            j = i
        return path[::-1]

    def ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for end, number in self.shortest(segment):
            if number >= 0:
                out.append(number)
            elif self.bytes_from:
                out.extend(self.bytes_from[b] for b in segment[end - 1].encode("utf-8"))
            else:
                out.append(self.unknown)
        return out


class Segments(dict):
    """Ids as bytes of 32-bit numbers, by pre-token (what follows a space sign) or by segment that has none before.

    The cache has two generations of ``most`` entries: a full one becomes the old one, from which what is met again
    is taken over.
    """

    def __init__(self, transducer: Transducer, most: int):
        super().__init__()
        self.transducer, self.most = transducer, most
        self.old: dict[str, bytes] = {}
        self.inside: dict[str, bytes] = {}  # segments after the first of a pre-token

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            # Letters alone are seldom cut; looking for places would cost more than it saves.
            first, *rest = [MARK + word] if word.isalpha() else self.transducer.segments(MARK + word)
            if len(first) <= len(word):
                got = self[first[1:]] + b"".join(map(self._inside, rest))
            else:
                got = array("i", self.transducer.ids(first)).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got

    def _inside(self, segment: str) -> bytes:
        known = self.inside.get(segment)
        if known is None:
            known = array("i", self.transducer.ids(segment)).tobytes()
            if len(segment) <= LONGEST_KEPT:
                if len(self.inside) >= self.most:
                    self.inside.clear()
                self.inside[segment] = known
        return known


def check_transducer(model: bytes) -> None:
    """Refuse a model that changes decoded texts, that takes away spaces or puts their sign elsewhere, that is neither a
    unigram nor a merge model, or that has pieces cut out before all others (user-defined) or merged but not used."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(model)
    if proto.trainer_spec.model_type not in (pb.TrainerSpec.UNIGRAM, pb.TrainerSpec.BPE):
        raise ValueError("neither a unigram nor a merge model")
    kind = pb.ModelProto.SentencePiece
    if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
        raise ValueError("the model has user-defined or unused pieces")
    spec = proto.normalizer_spec
    if proto.denormalizer_spec.precompiled_charsmap:
        raise ValueError("the model changes decoded texts")
    if not (spec.add_dummy_prefix and spec.escape_whitespaces) or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model's normaliser changes spaces")


class Codec:
    def __init__(self, sp, cache_rows: int):
        from sentencepiece import sentencepiece_model_pb2 as pb

        check_model(sp)
        proto = pb.ModelProto.FromString(sp.serialized_model_proto())
        self.normal = Normaliser(proto.normalizer_spec.precompiled_charsmap)
        self.segments = Segments(Transducer.compile(sp), cache_rows)
        self.output = [
            bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i)
            else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(sp.get_piece_size())
        ]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.segments.__getitem__, pre_tokens(self.normal(text)))) if text else b""

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.output.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}  # by the content of the model
CODECS_KEPT = 2


def _codec(name: str, model, cache_rows: int) -> Codec:
    """The worker's codec of a model; a few models at a time, the one used longest ago goes first."""
    codec = _codecs.pop(name, None) or Codec(processor(model.value), cache_rows)
    codec.segments.most = max(codec.segments.most, cache_rows)
    while len(_codecs) >= CODECS_KEPT:
        del _codecs[next(iter(_codecs))]
    _codecs[name] = codec
    return codec


def encoded(docs: DataFrame, model_path: str, *, text_column: str = "text", cache_rows: int = 300_000) -> DataFrame:
    """``docs`` with ``token_ids`` (integers, without begin or end), ``n_tokens`` and ``round_trip``, which says
    whether decoding the ids gives the text back; columns of these names are replaced.

    A null or empty text has no ids; decoding gives the empty text, so a null text has no round trip (false). The
    space sign of the vocabulary decodes to a space, so a text that holds that sign itself has none either, nor has a
    text that the normaliser rewrites. A model with user-defined or unused pieces is refused with a ValueError.
    """
    with open(model_path, "rb") as f:
        proto = f.read()
    check_transducer(proto)
    model, name = docs.sparkSession.sparkContext.broadcast(proto), named(proto)

    def compute(texts: pa.Array) -> list[pa.Array]:
        codec = _codec(name, model, cache_rows)
        cells, same, counts = [], [], []
        for text in texts.to_pylist():
            cell = codec.encode(text)
            cells.append(cell)
            ids = np.frombuffer(cell, np.int32)
            counts.append(len(ids))
            same.append(codec.decode(ids.tolist()) == text)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        values = pa.Array.from_buffers(pa.int32(), int(sum(counts)), [None, pa.py_buffer(b"".join(cells))])
        return [pa.ListArray.from_arrays(offsets, values), pa.array(counts, pa.int64()), pa.array(same, pa.bool_())]

    return add_columns(docs, text_column, compute, [
        T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
        T.StructField("round_trip", T.BooleanType())])


def decoded(table: DataFrame, model_path: str, *, ids_column: str = "token_ids", into: str = "text") -> DataFrame:
    """``table`` with the text of its ids as column ``into``; null ids give a null text."""
    with open(model_path, "rb") as f:
        proto = f.read()
    check_transducer(proto)
    model, name = table.sparkSession.sparkContext.broadcast(proto), named(proto)
    keep = [c for c in table.columns if c != into]
    source = table.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)], F.col(f"`{ids_column}`").alias("__ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__made", T.StringType())])

    def run(batches):
        for batch in batches:
            codec = _codec(name, model, 1)
            made = pa.array([None if x is None else codec.decode(x) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, into)
