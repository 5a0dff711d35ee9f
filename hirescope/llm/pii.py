"""Information-theoretic sanitisation of personal data.

Base findings are e-mail addresses, IP addresses, card and phone numbers, by their
patterns. Each found value is a protected entity. The corpus then tells which terms
give an entity away where it has been taken out: for a term that stands within
``WINDOW`` words of an entity,

    p(entity | term) = uses of the term beside that entity / all uses of the term,

counted over all texts. -log2 of it is what remains unknown of the entity to one who
reads the term. A term with at most ``REMOVE_BITS`` left is removed wherever it stands
in a text that holds that entity, however far from it; one with at most
``GENERALISE_BITS`` is generalised to its kind. A term counts only with ``SUPPORT``
different surroundings of the entity, so that copies of one passage are no evidence.

A term is a stretch without ASCII white space, lower-cased, without punctuation at its
ends, of two characters or more. Spans are (start, end) in code points, end exclusive;
``kind`` is a base kind, or ``term`` (removed) or ``general`` (generalised). Term spans that
meet a base span are dropped.

Nulls: a null text is empty and holds nothing; a null id is kept. Spans depend on the
text alone, so repeated rows and copies get the same; they all count as uses. An empty
table gives no rows. Other columns are kept by ``sanitised`` and ignored by ``found``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.near_dup import small
from hirescope.llm.words import mapped, slices
from hirescope.session import written

KINDS = ("email", "ip", "card", "phone")
WINDOW, SUPPORT = 8, 2
REMOVE_BITS, GENERALISE_BITS = 1.0, 2.0
#: Distinct terms a worker counts before it passes the counts on.
ROOM = 80_000
#: Bits of the filter that says which terms may have been judged, and those of a bitmap in Spark.
FILTER_BITS, BITMAP_BITS = 1 << 21, 1 << 15

# The patterns of the base kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
# A run of digits that begins inside a longer one fails where the longer one does.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TERM = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest run of local characters before an @ sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end, kind) of all base findings, sorted, without the place."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _term(word: str) -> str:
    return word.lower().strip(_EDGE)


def _beside(text: str, spans: list[tuple[int, int, str]], window: int) -> Iterator[tuple]:
    """entity, term, surroundings: the terms beside each finding, and each finding's
    entity with no term."""
    words = [m.span() for m in _TERM.finditer(text)] if spans else []
    starts, ends = [s for s, _ in words], [e for _, e in words]
    meets = _meets(spans)
    for start, end, kind in spans:
        entity = f"{kind}:{text[start:end]}"
        yield entity, None, None
        i, j = bisect_left(starts, start), bisect_right(ends, end)
        near = [(s, min(e, start)) for s, e in words[max(0, i - window):i]] + [(max(s, end), e) for s, e in words[j:j + window]]
        own = [text[s:e] for s, e in near]
        about = int.from_bytes(hashlib.blake2b("\0".join(own).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        for word, (s, e) in zip(own, near, strict=True):
            term = _term(word)
            if len(term) > 1 and not meets(s, e):
                yield entity, term, about


def _meets(spans: list[tuple[int, int, str]]) -> Callable[[int, int], bool]:
    """Whether a stretch overlaps one of the sorted spans."""
    starts, ends = [s for s, _, _ in spans], list(accumulate((e for _, e, _ in spans), max))

    def meets(start: int, end: int) -> bool:
        i = bisect_left(starts, end)
        return i > 0 and ends[i - 1] > start

    return meets


def _outside(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[str, int, int]]:
    """word, start, end: the stretches without white space between the sorted spans."""
    at = 0
    for start, end in [*((s, e) for s, e, _ in spans), (len(text), len(text))]:
        if start > at:
            for m in _TERM.finditer(text, at, start):
                yield m[0], m.start(), m.end()
        at = max(at, end)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("_text", text).withColumn("_key", F.unhex(F.md5(text)))


def contexts(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """key (of the text), entity, term, about: the terms beside entities; and a row
    without a term for each finding."""

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["_key"], batch["_text"], strict=True):
                rows += [(key, *r) for r in _beside(text, base_spans(text), window)]
            yield pd.DataFrame(rows, columns=["key", "entity", "term", "about"], dtype=object)

    return mapped(
        _keyed(docs, text_col).select("_key", "_text"), beside, "key binary, entity string, term string, about long")


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n: uses of every term in all texts, partly summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()

        def terms() -> pd.DataFrame:
            summed: Counter[str] = Counter()
            for w, n in words.items():
                summed[_term(w)] += n
            words.clear()
            return pd.DataFrame({"term": pd.Series(list(summed), dtype=object), "n": list(summed.values())})

        for batch in batches:
            for text in batch["text"]:
                if text:
                    words.update(_ascii_split(text))
                    if len(words) > ROOM:
                        yield terms()
        yield terms()

    return mapped(docs.select(F.col(text_col).alias("text")), count, "term string, n long")


def _ascii_split(text: str) -> list[str]:
    """Split at ASCII white space alone."""
    if text.isascii():
        return text.replace("\x1c", "\0").replace("\x1d", "\0").replace("\x1e", "\0").replace("\x1f", "\0").split() \
            if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def _filter(terms: DataFrame) -> np.ndarray:
    """The terms' bits, of a fixed size: a term without its bit is none of them."""
    bit = F.crc32(F.col("term").cast("binary")) % FILTER_BITS
    rows = terms.select(bit.alias("bit")).groupBy((F.col("bit") / BITMAP_BITS).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(F.col("bit") % BITMAP_BITS).alias("bits"))
    out = np.zeros(FILTER_BITS, bool)
    # At most FILTER_BITS / BITMAP_BITS rows.
    for r in rows.collect():
        part = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        out[r["part"] * BITMAP_BITS:][:len(part)] = part
    return out


def uses(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """key, term, start, end: all uses of the terms (and, now and then, of other ones) in
    the texts that hold an entity, copies once."""
    bits = np.packbits(_filter(terms))

    def use(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judged = np.unpackbits(bits)
        known: dict[str, str | None] = {}
        for batch in batches:
            rows = []
            for key, text in zip(batch["_key"], batch["_text"], strict=True):
                spans = base_spans(text)
                for word, start, end in _outside(text, spans) if spans else ():
                    if word not in known:
                        if len(known) > ROOM:
                            known.clear()
                        term = _term(word)
                        known[word] = term if len(term) > 1 and judged[
                            zlib.crc32(term.encode("utf-8", "surrogatepass")) % FILTER_BITS] else None
                    if term := known[word]:
                        rows.append((key, term, start, end))
            yield pd.DataFrame(rows, columns=["key", "term", "start", "end"], dtype=object)

    return mapped(
        _keyed(docs, text_col).select("_key", "_text"), use, "key binary, term string, start long, end long").distinct()


def disclosing(docs: DataFrame, text_col: str = "text", window: int = WINDOW, support: int = SUPPORT,
               remove: float = REMOVE_BITS, generalise: float = GENERALISE_BITS) -> DataFrame:
    """key, spans (start, end, kind): the terms to take out of each text."""
    beside = written(contexts(docs, text_col, window), "beside")
    holds = beside.filter("term IS NULL").select("key", "entity").distinct()
    pairs = written(beside.filter("term IS NOT NULL").groupBy("entity", "term").agg(
        F.count("*").alias("together"), F.count_distinct("about").alias("surroundings")).filter(
        F.col("surroundings") >= support), "pairs")
    counts = term_counts(docs, text_col).groupBy("term").agg(F.sum("n").alias("n"))
    bits = -F.log2(F.col("together") / F.col("n"))
    judged = pairs.join(counts, "term").withColumn("bits", bits).filter(F.col("bits") <= generalise)
    kind = F.when(F.col("bits") <= remove, "term").otherwise("general")
    judged = written(judged.select("entity", "term", kind.alias("kind")), "judged")
    # A term has few entities here, so the uses meet them first, and then what the text holds.
    marked = uses(docs, judged, text_col).join(small(judged), "term").join(holds, ["key", "entity"], "left_semi")
    # A term that gives two entities away is removed if either asks for it.
    return marked.groupBy("key", "start", "end").agg(F.max("kind").alias("kind")).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_terms, base_sha256, spans."""

    def base(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, code, text in zip(batch["doc_id"], batch["_key"], batch["_text"], strict=True):
                spans = base_spans(text)
                n = Counter(k for _, _, k in spans)
                rows.append((key, code, *(n[k] for k in KINDS), hashlib.sha256(_joined(spans).encode()).hexdigest(),
                             [{"start": s, "end": e, "kind": k} for s, e, k in spans]))
            yield pd.DataFrame(rows, columns=["doc_id", "key", *(f"n_{k}" for k in KINDS), "base_sha256", "base"], dtype=object).astype(
                {"doc_id": batch["doc_id"].dtype})

    span = "array<struct<start:long,end:long,kind:string>>"
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("key", T.BinaryType()), *(
        T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()),
        T.StructField("base", T.DataType.fromDDL(span))])
    rows = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    rows = mapped(rows.select("doc_id", "_key", "_text"), base, schema)
    terms = disclosing(docs, text_col).withColumnRenamed("spans", "terms")
    order = F.array(*(F.lit(k) for k in (*KINDS, "general", "term")))
    both = F.array_sort(F.transform(F.concat("base", F.coalesce("terms", F.expr(f"cast(array() as {span})"))), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.array_join(F.transform(both, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.join(terms, "key", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"),
        "base_sha256", text.alias("spans"))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind; overlapping spans once, by the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            word = text[start:end]
            if kind == "general":
                kind = "number" if word.strip(_EDGE).isdigit() else "name" if word[:1].isupper() else "word"
            out += [text[at:start], f"[{kind}]"]
            at = end
        else:
            at = max(at, end)
    return "".join([*out, text[at:]])


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have; Spark doesn't tell upper case from lower."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its findings taken out of the text; null texts stay null."""
    key, spans = (_fresh(docs, n) for n in ("_key", "_terms"))
    terms = written(disclosing(docs, text_col).toDF(key, spans), "terms")
    place, width = docs.columns.index(text_col), len(docs.columns)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = pa.array(map(clean, batch.column(place).to_pylist(), batch.column(width).to_pylist()), batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), text).select(list(range(width)))

    def clean(text: str | None, extra: list[dict] | None) -> str | None:
        spans = base_spans(text) if text else []
        spans += [(x["start"], x["end"], x["kind"]) for x in extra or ()]
        return redacted(text, sorted(spans, key=lambda s: s[:2])) if spans else text

    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(text_col, F.lit(""))))).join(small(terms), key, "left")
    return keyed.select(*docs.columns, spans).mapInArrow(redact, docs.schema)
