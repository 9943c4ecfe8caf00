"""Surrogates for personal data: keyed, consistent in type, and of the same gender, script and format.

An entity is reduced to a canonical form, so its spellings share one surrogate everywhere (coreference). The form is
put through a keyed permutation of all strings of its shape: digits stay digits, vowels vowels, consonants
consonants, in their case and script; so two entities never share a surrogate by chance. Listed given names are
permuted among the names of their gender and script. Addresses stay valid addresses, card numbers keep their check
digit right or wrong, mail stays under its top-level domain, phone numbers keep country code and punctuation.

What the permutation cannot see is checked on the distinct entities of the corpus: a surrogate that is itself an
entity of the corpus, or that two entities ended up with, is drawn again until none is left. The entities that were
drawn again are sent to the tasks if they are few, else joined to the texts that hold them.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline.llm.arrow import add_columns, parts
from forkline.session import stage

# Given names, by script and gender.
NAMES = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Peter Paul Hans Klaus Jean Pierre Carlos Pedro".split(),
    ("latin", "f"): "Mary Linda Susan Sarah Karen Anna Maria Laura Julia Emma Heidi Ingrid Claire Sophie Carmen Lucia".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Дмитрий Алексей Николай Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
}
HONORIFICS = {
    "m": "Mr Herr Monsieur Señor Господин".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Señora Госпожа".split(),
    "": "Dr Prof".split(),
}
GENDER = {t: g for g, ts in HONORIFICS.items() for t in ts}
GIVEN = {n: k for k, ns in NAMES.items() for n in ns}
KINDS = ("email", "ip", "card", "phone", "person")

_name = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
ENTITY = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w%+-][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<card>(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w))"
    r"|(?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?)?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]\d{4}(?!\w)"
    r"|(?<!\w)\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
)
PERSON = re.compile(
    rf"(?<!\w)(?:(?P<title>{'|'.join(sorted(GENDER, key=len, reverse=True))})\.?[ \xa0](?P<first>{_name})(?:[ \xa0](?P<second>{_name}))?"
    rf"|(?P<given>{'|'.join(sorted(GIVEN))})[ \xa0](?P<family>{_name}))(?!\w)"
)
MAYBE_NUMBER = re.compile(r"[0-9@]")

ALPHABETS = [
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "àáâãäåèéêëìíîïòóôõöùúûü",
    "çñß", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
]
CLASS = {ch: (a, i) for a in ALPHABETS for i, ch in enumerate(a)}


def _draw(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def shuffled_number(x: int, size: int, key: bytes, *tweak: object) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network, walked until it is back in range."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(6):
            left, right = right, left ^ (_draw(key, *tweak, size, r, right) & mask)
        x = left << half | right
        if x < size:
            return x


def shuffled_text(text: str, key: bytes, *tweak: object) -> str:
    """A keyed permutation of all texts with the same class of character at each place; other characters stay."""
    size = x = 1
    x = 0
    for ch in text:
        if ch in CLASS:
            size, x = size * len(CLASS[ch][0]), x * len(CLASS[ch][0]) + CLASS[ch][1]
    shape = "".join(CLASS[ch][0][0] if ch in CLASS else ch for ch in text)
    x = shuffled_number(x, size, key, *tweak, shape)
    out = []
    for ch in reversed(text):
        if ch in CLASS:
            x, i = divmod(x, len(CLASS[ch][0]))
            ch = CLASS[ch][0][i]
        out.append(ch)
    return "".join(reversed(out))


def check_digit(digits: str) -> int:
    """The digit that makes ``digits`` and it pass the mod-10 check of card numbers."""
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def canonical(kind: str, m: re.Match) -> str:
    text = m.group()
    if kind == "email":
        return text.lower()
    if kind == "card":
        return re.sub(r"\D", "", text)
    if kind == "phone":
        code = re.match(r"\+\d+", text)
        return f"{code.group() if code else ''}|{re.sub(r'[^0-9]', '', text[code.end():] if code else text)}"
    return text


def _name_form(name: str, gender: str, given: bool) -> str:
    return f"{'g' if given else 'n'}:{gender}:{name}"


def surrogate(kind: str, form: str, attempt: int, key: bytes) -> str:
    """The canonical form of the surrogate of a canonical form."""
    tweak = (kind, attempt)
    if kind == "email":
        local, _, domain = form.rpartition("@")
        labels = domain.split(".")
        kept = {len(labels) - 1} | {i for i, x in enumerate(labels) if x == "example"}
        labels = [x if i in kept else shuffled_text(x, key, *tweak, "domain") for i, x in enumerate(labels)]
        return shuffled_text(local, key, *tweak, domain) + "@" + ".".join(labels)
    if kind == "ip":
        x = 0
        for octet in form.split("."):
            x = x * 256 + int(octet)
        x = shuffled_number(x, 2**32, key, *tweak)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        body = form[0] + shuffled_text(form[1:-1], key, *tweak, form[0])
        off = (int(form[-1]) - check_digit(form[:-1])) % 10
        return body + str((check_digit(body) + off) % 10)
    if kind == "phone":
        code, _, digits = form.partition("|")
        return f"{code}|{shuffled_text(digits, key, *tweak, code)}"
    sort, gender, name = form.split(":", 2)
    if sort == "g" and name in GIVEN:
        pool = NAMES[GIVEN[name]]
        # Steps through a keyed cycle of the pool, so no name stays itself at the first draw.
        cycle = sorted(pool, key=lambda n: _draw(key, *GIVEN[name], n))
        return f"g:{gender}:{cycle[(cycle.index(name) + 1 + attempt) % len(cycle)]}"
    return f"{sort}:{gender}:{shuffled_text(name, key, kind, attempt)}"


def _written(kind: str, shown: str, form: str) -> str:
    """The surrogate in the format of the mention it replaces."""
    if kind in ("card", "phone"):
        digits = iter(re.sub(r"\D", "", form))
        return re.sub(r"\d", lambda _: next(digits), shown)
    return form


def mentions(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, canonical form) of each part to replace, in order and without overlaps."""
    if not text:
        return []
    found = []
    if MAYBE_NUMBER.search(text):
        found = [(m.lastgroup, m.start(), m.end(), canonical(m.lastgroup, m)) for m in ENTITY.finditer(text)]
    taken = [(s, e) for _, s, e, _ in found]
    for m in PERSON.finditer(text):
        title, second = m["title"], m["second"]
        named = [(m.span("given"), True), (m.span("family"), False)] if title is None else (
            [(m.span("first"), True), (m.span("second"), False)] if second else [(m.span("first"), m["first"] in GIVEN)])
        given = next((text[s:e] for (s, e), g in named if g), "")
        gender = GENDER.get(title, "") or (GIVEN[given][1] if given in GIVEN else "")
        for (s, e), g in named:
            # A family name is the same name for every gender; a given name keeps its own.
            if not any(a < e and s < b for a, b in taken):
                found.append(("person", s, e, _name_form(text[s:e], gender if g else "", g)))
    return sorted(found, key=lambda x: x[1])


def replaced(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and where they are in it."""
    found = mentions(text)
    if not found:
        return text, []
    out, at, size, spans = [], 0, 0, []
    for kind, start, end, form in found:
        new = _written(kind, text[start:end], surrogate(kind, form, attempts.get((kind, form), 0), key))
        if kind == "person":
            new = new.split(":", 2)[2]
        out += [text[at:start], new]
        size += start - at
        spans.append({"kind": kind, "start": size, "surrogate": new})
        size += len(new)
        at = end
    return "".join([*out, text[at:]]), spans


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("surrogate", pa.string())]))
SPANS_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("surrogate", T.StringType())]))


def entities(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Distinct ``kind, form`` of all texts; repeats are merged in the map task and before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0):
                rows = sorted({(k, f) for t in part.column(0).to_pylist() for k, _, _, f in mentions(t)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.string())], names=["kind", "form"])

    return docs.select(F.col(f"`{text_column}`").cast("string")).mapInArrow(run, "kind string, form string").distinct()


def redrawn(known: DataFrame, key: bytes, most_rounds: int = 30) -> DataFrame:
    """``kind, form, attempt`` of the entities whose first surrogate is taken, with the draw that is free.

    Each round draws again for the entities whose surrogate is an entity of the corpus or another's surrogate; of
    those that share one, the smallest form keeps it. Listed given names are not drawn again, as their pool is closed;
    all of them count as taken. A given name is one entity here for all genders, so its draws stay the same.
    """

    @F.pandas_udf("string")
    def drawn(kind, form, attempt):
        return pa.array([surrogate(k, f, a, key) for k, f, a in zip(kind, form, attempt, strict=True)]).to_pandas()

    given = F.expr("kind = 'person' and form like 'g:%'")
    name = F.when(given, F.regexp_replace("form", "^g:[^:]*:", "g::")).otherwise(F.col("form"))
    forms = stage(known.select("kind", "form", name.alias("name")), "entities")
    listed = known.sparkSession.createDataFrame([("person", f"g::{n}") for n in GIVEN], "kind string, form string")
    known = forms.select("kind", F.col("name").alias("form")).union(listed).distinct()
    closed = (F.col("kind") == "person") & F.col("form").isin([f"g::{n}" for n in GIVEN])
    now = stage(known.where(~closed).withColumn("attempt", F.lit(0)).withColumn("new", drawn("kind", "form", "attempt")), "draws")
    for _ in range(most_rounds):
        taken = known.select("kind", F.col("form").alias("new"), F.lit(True).alias("real"))
        keeper = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "form")).alias("keeper"))
        bad = now.join(taken, ["kind", "new"], "left").join(keeper, ["kind", "new"]).select(
            "kind", "form", "attempt", "new", F.expr("real is not null or keeper.form <> form").alias("bad"))
        if not bad.where("bad").limit(1).count():
            again = now.where("attempt > 0").select("kind", F.col("form").alias("name"), "attempt")
            return forms.join(again, ["kind", "name"]).select("kind", "form", "attempt")
        moved = bad.withColumn("attempt", F.expr("attempt + if(bad, 1, 0)"))
        again = moved.where("bad").withColumn("new", drawn("kind", "form", "attempt")).drop("bad")
        now = stage(moved.where("not bad").drop("bad").unionByName(again), "draws")
    raise RuntimeError("surrogates did not become distinct")


def pseudonymised(docs: DataFrame, key: bytes, *, text_column: str = "text", most_sent: int = 100_000) -> DataFrame:
    """``docs`` with surrogates in the text column, and ``surrogates`` (kind, start, surrogate) of each text; a column
    of that name is replaced.

    Null and empty texts stay. Texts without personal data are returned as they are. Repeated rows get the same
    surrogates. ``most_sent`` bounds the entities drawn again that are sent to the tasks; with more, they are joined
    by text.
    """
    # The same texts are read twice: once for the check, once to replace.
    again = stage(redrawn(entities(docs, text_column), key), "redrawn")
    n = again.count()
    made = [T.StructField("__new", T.StringType()), T.StructField("surrogates", SPANS_TYPE)]
    if n <= most_sent:
        sent = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["form"]): r["attempt"] for r in again.collect()})

        def compute(texts: pa.Array) -> list[pa.Array]:
            rows = [replaced(t, key, sent.value) for t in texts.to_pylist()]
            return [pa.array([t for t, _ in rows], pa.string()), pa.array([s for _, s in rows], SPANS)]

        out = add_columns(docs, text_column, compute, made)
    else:
        out = _joined(docs, again, key, text_column, made)
    return out.withColumn(text_column, F.col("__new")).select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "surrogates"], "surrogates")


def _joined(docs: DataFrame, again: DataFrame, key: bytes, text_column: str, made: list) -> DataFrame:
    """Replace where too many entities were drawn again to send them: each text gets those it holds, by its hash."""
    name = F.sha2(F.col(f"`{text_column}`").cast("string"), 256)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({(h, k, f) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                           for k, _, _, f in mentions(t)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["__name", "kind", "form"])

    source = docs.select(name.alias("__name"), F.col(f"`{text_column}`").cast("string").alias("text"))
    mine = source.mapInArrow(held, "__name string, kind string, form string").distinct().join(again, ["kind", "form"])
    mine = mine.groupBy("__name").agg(F.collect_list(F.struct("kind", "form", "attempt")).alias("__mine"))
    both = docs.drop("surrogates").withColumn("__name", name).join(mine, "__name", "left").drop("__name")
    schema = T.StructType([*both.drop("__mine").schema.fields, *made])
    text_at, mine_at = both.columns.index(text_column), both.columns.index("__mine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, text_at):
                rows = [
                    replaced(t, key, {(x["kind"], x["form"]): x["attempt"] for x in own or []})
                    for t, own in zip(part.column(text_at).to_pylist(), part.column(mine_at).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(c for i, c in enumerate(part.columns) if i != mine_at), pa.array([t for t, _ in rows], pa.string()),
                     pa.array([s for _, s in rows], SPANS)], names=schema.names)

    return both.mapInArrow(run, schema)
