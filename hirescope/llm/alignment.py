"""Tokens of two vocabularies laid side by side.

Each text is tokenised whole by a byte-level vocabulary (A, over a space and the text)
and by a piece vocabulary (B, which adds that space itself). Both sequences are turned
back into bytes, and a text whose bytes they don't both give back has no tokens here.
Where a token of A and one of B begin with a space at the same byte, the tokens before
them end together: these verified shared ends cut the document into windows, about a
word each. A window's alignment depends on its ids alone, so it is worked out once for
each pair of id tuples and remembered.

The corpus counts need a second pass. The first writes, for each chunk of documents, its
distinct windows' id pairs with their counts, and for each document the numbers of its
windows. Spark sums the pairs over the corpus, finds each B id's highest count, and
hands every chunk the counts of its own pairs only, so nothing that grows with the
corpus is broadcast, and a pair that stands in every document is one row a chunk.

Nulls: a null text counts as empty; a null id is kept. Empty texts and texts that don't
come back have zeros and an empty hash. Repeated rows are documents of their own. A very
long text is a chunk of its own. Ties for a B id's highest count are all best. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hirescope.llm import packing
from hirescope.llm.words import slices
from hirescope.session import written

#: Characters of the documents whose windows share a chunk's table.
CHUNK = 4_000_000
#: Words whose ids, and windows whose alignment, a worker remembers before it starts afresh.
ROOM = 300_000

_MEASURES = ("n_a", "n_b", "n_groups", "n_links")
#: Marks B's ids in a window's tuple.
_B = np.uint32(1 << 31)
_UNUSUAL = re.compile(r"\s (?:\s|\Z)|\A\s|  | \Z")
_PLAIN = re.compile(r" \S+").fullmatch


class Windows:
    """Windows aligned so far: a number by id tuple, and by number the groups as text,
    how many groups and links there are, and the links."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.sizes, self.numbers = sizes, {}
        self.texts: list[bytes] = []
        self.n_groups, self.n_links, self.links = [], [], []
        words = [np.array([f"{i}{end}" for i in range(max(map(len, sizes)))], object) for end in ",|;"]
        self.words = np.concatenate(words)

    def learn(self, keys: list[bytes]) -> None:
        """Align windows: the bytes of each stretch between two ends, of either side, lie
        in one token of A and one of B, which is a link; where both end, a group does."""
        self.numbers.update(zip(keys, range(len(self.texts), len(self.texts) + len(keys)), strict=True))
        ids = np.frombuffer(b"".join(keys), "<u4")
        window = np.arange(len(keys)).repeat([len(k) // 4 for k in keys])
        of_b = ids >= _B
        a, b = ids[~of_b].astype(np.int64), (ids[of_b] - _B).astype(np.int64)
        ends_a, ends_b = self.sizes[0][a].cumsum(), self.sizes[1][b].cumsum()
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        own_a, own_b = window[~of_b], window[of_b]
        n_links = np.bincount(own_a[at_a], minlength=len(keys))
        n_groups = np.bincount(own_a[np.searchsorted(ends_a, shared)], minlength=len(keys))
        self.n_links.append(n_links)
        self.n_groups.append(n_groups)
        self.links.append(a[at_a] << 32 | b[at_b])
        # The text, token by token: by group, A's before B's, each with the sign after it.
        group = np.concatenate([np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)])
        side = np.arange(len(group)) >= len(a)
        order = np.lexsort((side, group))
        group, side = group[order], side[order]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
        word = np.concatenate([a, b])[order] + len(self.words) // 3 * np.where(last, 1 + side, 0)
        words = self.words[word].tolist()
        stops = np.bincount(window, minlength=len(keys)).cumsum().tolist()
        self.texts += ["".join(words[i:j])[:-1].encode() for i, j in zip([0, *stops], stops, strict=False)]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of groups, of links, and all links."""
        out = []
        for parts in (self.n_groups, self.n_links, self.links):
            parts[:] = [np.concatenate(parts)] if parts else [np.zeros(0, np.int64)]
            out.append(parts[0])
        return tuple(out)


class Pair:
    """Both vocabularies, their tokens as bytes, and what a worker remembers of words and windows."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.encode_a = packing.coder(a)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b)
        self.bytes_a = self.encode_a.tokens()
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        # No piece goes on past a space before a word, so words may be encoded one by one.
        self.apart = not any(b" " in t.lstrip(b" ") for t in self.bytes_b)
        self.sizes = tuple(np.array([len(t) for t in tokens]) for tokens in (self.bytes_a, self.bytes_b))
        self.spaced = tuple(np.array([t[:1] == b" " for t in tokens]) for tokens in (self.bytes_a, self.bytes_b))
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.changed: set[str] = set()
        self.windows = Windows(self.sizes)

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def _plain_ids(self, words: list[str]) -> list[bytes]:
        """A's ids of words that begin with their only space: of all at once, cut by length."""
        if not words:
            return []
        data = self.encode_a.encode("".join(words))
        ids = np.frombuffer(data, "<u4")
        stops = np.searchsorted(self.sizes[0][ids].cumsum(), np.cumsum([len(w.encode()) for w in words])) + 1
        return [data[4 * i:4 * j] for i, j in zip([0, *stops.tolist()], stops.tolist(), strict=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of words that begin with a space."""
        plain = [w for w in words if _PLAIN(w)]
        ids = dict(zip(plain, self._plain_ids(plain), strict=True))
        for word, b in zip(words, self.pieces.encode([w[1:] for w in words], num_threads=1), strict=True):
            a = ids[word] if word in ids else self.encode_a.encode(word)
            self.words[word] = a, np.array(b, "<u4").tobytes()
            if b"".join(map(self.bytes_b.__getitem__, b)) != word.encode():
                self.changed.add(word)

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes] | None]:
        """Both vocabularies' ids of each text, or None where there are none or they don't give it back.

        In a usual text a space always begins a token of both, so it is tokenised word by
        word, and each word only once; others are tokenised as a whole.
        """
        cut = [[" " + w for w in t.split(" ")] if t and self.apart and not _UNUSUAL.search(t) else None for t in texts]
        if len(self.words) > ROOM:
            self.words.clear()
            self.changed.clear()
        self._learn(list({w for words in cut if words for w in words if w not in self.words}))
        for text, words in zip(texts, cut, strict=True):
            if not text:
                yield None
                continue
            if words:
                known = [self.words[w] for w in words]
                a, b = b"".join([k[0] for k in known]), b"".join([k[1] for k in known])
                if self.changed.isdisjoint(words):
                    yield a, b
                    continue
            else:
                a, b = self.encode_a.plain(" " + text), np.array(self.pieces.encode(text, num_threads=1), "<u4").tobytes()
            raw = (" " + text).encode()
            same = all(b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]) == raw
                       for ids, table in ((a, self.bytes_a), (b, self.bytes_b)))
            yield (a, b) if same else None

    def cut(self, ids_a: bytes, ids_b: bytes) -> list[bytes]:
        """The windows of a text: A's ids and B's between two shared ends before space-marked tokens."""
        both = np.frombuffer(ids_a, "<u4"), np.frombuffer(ids_b, "<u4")
        starts = []
        for ids, sizes in zip(both, self.sizes, strict=True):
            size = sizes[ids]
            starts.append(size.cumsum() - size)
        marked = [at[spaced[ids]] for at, spaced, ids in zip(starts, self.spaced, both, strict=True)]
        shared = np.intersect1d(*marked, assume_unique=True)
        shared = shared[shared > 0]
        # Window by window, A's ids before B's, in one row of bytes.
        place = [np.searchsorted(shared, at, "right") for at in starts]
        order = np.argsort(np.concatenate([place[0] * 2, place[1] * 2 + 1]), kind="stable")
        row = np.concatenate([both[0], both[1] | _B])[order].astype("<u4").tobytes()
        stops = (np.bincount(np.concatenate(place), minlength=len(shared) + 1).cumsum() * 4).tolist()
        return [row[i:j] for i, j in zip([0, *stops], stops, strict=False)]


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    if (a, b) not in _pairs:
        _pairs[a, b] = Pair(a, b)
    return _pairs[a, b]


class _Chunk:
    """The windows of some documents, numbered."""

    def __init__(self, name: int, both: Pair):
        self.name, self.both, self.chars, self.rows, self.at = name, both, 0, [], []
        if len(both.windows.texts) > ROOM:
            both.windows = Windows(both.sizes)

    def add(self, keys: list, texts: list[str | None]) -> None:
        known = self.both.windows
        found = list(self.both.tokens(texts))
        cut = [self.both.cut(*ids) if ids else [] for ids in found]
        new = list(dict.fromkeys([w for windows in cut for w in windows if w not in known.numbers]))
        if new:
            known.learn(new)
        for key, text, ids, windows in zip(keys, texts, found, cut, strict=True):
            at = [known.numbers[w] for w in windows]
            digest = hashlib.sha256(b";".join([known.texts[n] for n in at])).hexdigest() if at else ""
            n_a, n_b = (len(x) // 4 for x in ids) if ids else (0, 0)
            self.rows.append({"chunk": self.name, "doc_id": key, "n_a": n_a, "n_b": n_b, "groups_sha256": digest})
            self.at.append(np.array(at, np.int32))
            self.chars += len(text or "") + 1

    def closed(self) -> list[dict]:
        """A row for each document, and one for the chunk's pairs: which each window has, and how often in all."""
        n_groups, n_links, links = self.both.windows.table()
        for row, at in zip(self.rows, self.at, strict=True):
            row |= {"n_groups": int(n_groups[at].sum()), "n_links": int(n_links[at].sum())}
        used, number, times = np.unique(np.concatenate(self.at), return_inverse=True, return_counts=True)
        stops = np.cumsum([len(at) for at in self.at]).tolist()
        number = number.astype("<i4")
        for row, i, j in zip(self.rows, [0, *stops], stops, strict=False):
            row["windows"] = number[i:j].tobytes()
        sizes = n_links[used]
        first = n_links.cumsum()[used] - sizes
        inside = np.arange(sizes.sum()) - (sizes.cumsum() - sizes).repeat(sizes)
        codes, which = np.unique(links[first.repeat(sizes) + inside], return_inverse=True)
        counts = np.bincount(which, times.repeat(sizes), len(codes)).astype(np.int64)
        return [*self.rows, {
            "chunk": self.name, "codes": codes, "counts": counts,
            "sizes": sizes.astype("<i4").tobytes(), "links": which.astype("<i4").tobytes()}]


def chunked(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", chars: int = CHUNK) -> DataFrame:
    """First pass: documents with their windows' numbers, and each chunk's table of pairs."""
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType),
        *(T.StructField(n, T.LongType()) for n in _MEASURES), T.StructField("groups_sha256", T.StringType()),
        T.StructField("windows", T.BinaryType()), T.StructField("codes", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("sizes", T.BinaryType()),
        T.StructField("links", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a, b)
        chunk = _Chunk(TaskContext.get().partitionId() << 32, both)
        for batch in slices(batches):
            keys, texts = batch[0].to_pylist(), batch[1].to_pylist()
            start = room = 0
            for i, text in enumerate([*texts, None]):
                room += len(text or "") + 1
                if i == len(texts) or i > start and chunk.chars + room > chars:
                    chunk.add(keys[start:i], texts[start:i])
                    start, room = i, len(text or "") + 1
                if chunk.rows and chunk.chars + room > chars:
                    yield pa.RecordBatch.from_pylist(chunk.closed(), schema=arrow)
                    chunk = _Chunk(chunk.name + 1, both)
        if chunk.rows:
            yield pa.RecordBatch.from_pylist(chunk.closed(), schema=arrow)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _b_of(code: str) -> F.Column:
    return F.col(code).bitwiseAND(F.lit(0xFFFFFFFF))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Id pairs of the whole corpus: code (A's id times 2^32, plus B's), count, and whether it is its B id's highest."""
    each = chunks.filter("codes IS NOT NULL").select(F.explode(F.arrays_zip("codes", "counts")).alias("c"))
    pairs = written(each.groupBy(F.col("c.codes").alias("code")).agg(F.sum("c.counts").alias("count")), "pairs")
    highest = pairs.groupBy(_b_of("code").alias("_b")).agg(F.max("count").alias("_most"))
    return pairs.join(highest, _b_of("code") == F.col("_b")).select(
        "code", "count", (F.col("count") == F.col("_most")).alias("best"))


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text",
            chars: int = CHUNK) -> DataFrame:
    """Each document's tokens, groups and links, and how its links stand in the corpus."""
    chunks = written(chunked(docs, a, b, id_col, text_col, chars), "windows")
    own = chunks.filter("codes IS NOT NULL").select("chunk", F.posexplode("codes").alias("at", "code"))
    counted = own.join(pair_counts(chunks), "code").select(F.col("chunk").alias("of"), "at", "count", "best")
    measures = ["doc_id", *_MEASURES]
    schema = T.StructType([*(chunks.schema[n] for n in measures), T.StructField("n_best", T.LongType()),
                           T.StructField("count_sum", T.LongType()), chunks.schema["groups_sha256"]])
    arrow = to_arrow_schema(schema)

    def summed(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        has = np.array([x is not None for x in rows["sizes"].to_pylist()])
        table = rows.filter(pa.array(has))
        rows = rows.filter(pa.array(~has))
        sizes, links = (np.frombuffer(table[n][0].as_py(), "<i4") for n in ("sizes", "links"))
        order = np.argsort(pairs["at"].to_numpy())
        window = np.arange(len(sizes)).repeat(sizes)
        sums = []
        for name in ("best", "count"):
            value = pairs[name].to_numpy(zero_copy_only=False).astype(np.int64)[order]
            of = np.zeros(len(sizes), np.int64)
            np.add.at(of, window, value[links])
            sums.append(of)
        at = [np.frombuffer(x, "<i4") for x in rows["windows"].to_pylist()]
        n_best, count_sum = ([int(of[i].sum()) for i in at] for of in sums)
        return pa.Table.from_arrays([
            *(rows[n].combine_chunks() for n in measures), pa.array(n_best, pa.int64()),
            pa.array(count_sum, pa.int64()), rows["groups_sha256"].combine_chunks()], schema=arrow)

    held = chunks.select("chunk", *measures, "groups_sha256", "windows", "sizes", "links")
    return held.groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(summed, schema)
