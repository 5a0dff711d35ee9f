"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents of one length are alike to a packer, so the sweep works on runs: how
many documents have each length, and which sequences have each gap. Spark counts
the runs, deals every document its rank within its run, and joins the ranks to
the placements. The runs themselves are at most ``capacity`` rows however large
the corpus is, and are swept by one bounded task:

1. documents over half the capacity open a sequence each;
2. in each class of lengths, largest first, a successor sweep over the sorted
   runs gives every document the smallest gap that holds it. Documents that want
   the same gap are told apart by rank: the k-th of them takes the gap k places
   on (a running maximum over the sorted runs), so a gap takes one document a
   round;
3. gaps are updated and the sweep repeats; where no document of the class fits,
   the largest of them open as many sequences as their volume needs.

Nulls: a null text is empty; a null id is kept and packed like any other.
Empty texts hold the closing id alone. Repeated rows are packed once each. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array as _pack
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.words import mapped
from hirescope.session import written

CAPACITY = 2048
#: Groups that the documents of one length are numbered in.
SALTS = 128
#: Chunks of text whose ids a worker remembers before it starts afresh.
ROOM = 150_000

# The vocabulary's rule for cutting text before it merges.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space, a space, and no word after it: such a space may join its neighbours.
_RUN = re.compile(r"\s (?:\s|\Z)")


def _bytes_of(token: str) -> bytes:
    return bytes(_BYTE[c] for c in token)


def _byte_names() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others
    as the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTE = _byte_names()


class Ids:
    """Little-endian 32-bit token ids of texts under a byte-level vocabulary.

    A space that stands between words always begins a token of this vocabulary,
    so a text is encoded word by word and each word only once. The strings of special
    tokens are cut out first, the longest first where several begin at one place.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.ranks = {_bytes_of(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.coder = tiktoken.Encoding("packing", pat_str=CUT, mergeable_ranks=self.ranks, special_tokens={})
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        encode = self.encode

        class Spaced(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= ROOM:
                    self.clear()
                value = encode(" " + word)
                if len(word) <= 64:
                    self[word] = value
                return value

        self.spaced = Spaced()

    def encode(self, text: str) -> bytes:
        return _pack("I", self.coder.encode_ordinary(text)).tobytes()

    def tokens(self) -> list[bytes]:
        """Every token's bytes, by id; the special ones have none."""
        known = {i: t for t, i in self.ranks.items()}
        return [known.get(i, b"") for i in range(1 + max([*known, *self.special.values()]))]

    def __call__(self, text: str) -> bytes:
        """The ids of a text in which the special tokens' strings are those tokens."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(
            _pack("I", [self.special[part]]).tobytes() if part in self.special else self.plain(part)
            for part in self.cut.split(text) if part)

    def plain(self, text: str) -> bytes:
        """The ids of a text in which the special tokens' strings are ordinary text."""
        if _RUN.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        return b"".join([self.encode(first), *map(self.spaced.__getitem__, rest)])


_coders: dict[str, Ids] = {}


def coder(path: str) -> Ids:
    if path not in _coders:
        _coders[path] = Ids(path)
    return _coders[path]


def cut_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
               capacity: int = CAPACITY, close: int = 0) -> DataFrame:
    """Each document's ids, closed by ``close``, in pieces: doc_id, piece, start,
    length, ids_crc32. Only a document over the capacity is cut; its first piece
    takes what full pieces leave."""
    end = np.array([close], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = coder(vocabulary)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = ids(text or "") + end
                total = len(data) // 4
                start, length = 0, total % capacity or capacity
                for piece in range(-(-total // capacity)):
                    rows.append((key, piece, start, length, zlib.crc32(data[start * 4:(start + length) * 4])))
                    start, length = start + length, capacity
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype(
                {"doc_id": batch["doc_id"].dtype})

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *(
        T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), cut, schema)


class _Sweeps:
    """Rounds over the runs of one corpus; ``placed`` collects (length, first rank,
    count, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.rank = capacity, dict(counts), dict.fromkeys(counts, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.opened, self.placed = 0, []

    def place(self, length: int, n: int, sequence: int, gap: int) -> None:
        self.placed.append((length, self.rank[length], n, sequence, self.capacity - gap))
        self.rank[length] += n
        self.left[length] -= n
        if gap > length:
            self.gaps.setdefault(gap - length, []).append((sequence, n))

    def open(self, length: int, n: int) -> None:
        self.place(length, n, self.opened, self.capacity)
        self.opened += n

    def sweep(self, lengths: list[int]) -> int:
        """One round: how many of these documents found a gap."""
        lengths = sorted(s for s in lengths if self.left[s])
        gaps = sorted(g for g in self.gaps if lengths and g >= lengths[0])
        if not gaps:
            return 0
        runs = [(g, first, n) for g in gaps for first, n in self.gaps.pop(g)]
        ends = np.cumsum([n for _, _, n in runs])
        before = np.array([self.left[s] for s in lengths]).cumsum() - [self.left[s] for s in lengths]
        width = np.array([g for g, _, _ in runs])
        lower = np.concatenate([[0], ends])[np.searchsorted(width, lengths)]
        shift = np.maximum.accumulate(lower - before)
        at, found, taken = 0, 0, 0
        for s, start, n in zip(lengths, before + shift, [self.left[s] for s in lengths], strict=True):
            stop = min(int(start) + n, int(ends[-1]))
            while at < len(runs) and taken < stop:
                g, first, size = runs[at]
                base = int(ends[at]) - size
                skip = max(int(start), taken) - taken
                if skip:  # gaps that no document of this class is nearest to
                    skip = min(skip, base + size - taken)
                    self.gaps.setdefault(g, []).append((first + taken - base, skip))
                    taken += skip
                take = min(stop, base + size) - taken
                if take > 0:
                    self.place(s, take, first + taken - base, g)
                    taken += take
                    found += take
                if taken == base + size:
                    at += 1
        while at < len(runs):
            g, first, size = runs[at]
            base = int(ends[at]) - size
            if taken < base + size:
                self.gaps.setdefault(g, []).append((first + taken - base, base + size - taken))
            taken, at = base + size, at + 1
        return found

    def run(self, ratio: float) -> list[tuple[int, int, int, int, int]]:
        for s in sorted(self.left, reverse=True):
            if 2 * s > self.capacity:
                self.open(s, self.left[s])
        high = self.capacity // 2
        while high:
            low = min(high - 1, int(high / ratio))
            group = [s for s in self.left if low < s <= high]
            while any(self.left[s] for s in group):
                if not self.sweep(group):
                    need = -(-sum(s * self.left[s] for s in group) // self.capacity)
                    for s in sorted(group, reverse=True):
                        n = min(need, self.left[s])
                        if n:
                            self.open(s, n)
                            need -= n
            high = low
        return self.placed


def placements(runs: DataFrame, capacity: int = CAPACITY, ratio: float = 1.0) -> DataFrame:
    """Where the documents of each length go: length, first, n, sequence, offset.

    ``runs`` holds (length, n), at most ``capacity`` rows. Lengths within
    ``ratio`` of each other are swept together; at 1 each length is a class of its
    own, which packs best.
    """

    def rounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat(batches)
        counts = {int(s): int(n) for s, n in zip(every["length"], every["n"], strict=True)}
        placed = _Sweeps(counts, capacity).run(ratio)
        yield pd.DataFrame(placed, columns=["length", "first", "n", "sequence", "offset"], dtype="int64")

    return runs.select("length", "n").repartition(1).mapInPandas(
        rounds, "length long, first long, n long, sequence long, offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (at least doc_id, piece, length) with ``sequence_id`` and ``offset``."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = pieces.groupBy("length").agg(F.count("*").alias("n"))
    plan = placements(runs, capacity).groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first", "n", "sequence", "offset"))).alias("_runs"))
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    ranked = salted.withColumn("_rank", F.row_number().over(
        Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    rank = F.col("_before") + F.col("_rank")
    # A row for each length: at most `capacity` of them.
    return (
        ranked.join(groups.drop("_n"), ["length", "_salt"])
        .withColumn("_rank", rank)
        .join(F.broadcast(plan), "length")
        .withColumn("_at", F.filter("_runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["first"] + r["n"]))[0])
        .withColumn("sequence_id", F.col("_at.sequence") + F.col("_rank") - F.col("_at.first"))
        .withColumn("offset", F.col("_at.offset"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def packed(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces and their places."""
    return pack(written(cut_pieces(docs, vocabulary, id_col, text_col, capacity), "pieces"), capacity)
