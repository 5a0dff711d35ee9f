"""Byte-level BPE over a vocabulary of ranks, contracted by recursive queries.

A text is cut by the vocabulary's pattern, and each distinct word is encoded once by a
worker. The words of a batch become token-position rows, a row for each byte's token. A
recursive DuckDB query joins neighbouring rows to the merge table and contracts each
word's leftmost pair of the least rank, until no pair of any word is in the table.
Decoding puts the bytes of a row's ids together, looked up in the vocabulary.

Two things keep a long word from taking a round for each of its tokens, and neither
changes a result:

- All places of a word's least rank are contracted in one round, every second one where
  they overlap. This needs that no pair with the new token ranks before the new token
  itself. For tokens where one does (``alone``), only the leftmost place is taken.
- A query goes on for as many rounds as keep its rows in bounds; the next one starts
  from the words that were still changing.

Nulls: a null text counts as empty; a null id is kept. Empty texts have no tokens. Every
byte is a token, so each text comes back as it was. Repeated rows are encoded alike.
Equal ranks in a word go to the leftmost place. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hirescope.llm.words import slices

#: Words whose ids a worker remembers before it forgets the later half.
ROOM = 600_000
#: Characters of the texts, bytes of new words, and tokens to decode that one query takes.
CHARS, WORD_BYTES, TOKENS = 3_000_000, 300_000, 1_000_000
#: Rows that the rounds of one query may leave behind, and its rounds at most.
ROWS, ROUNDS = 6_000_000, 48
#: Memory of a worker's database.
MEMORY = "400MB"

_CONTRACT = """
WITH RECURSIVE state(place, id, round) AS MATERIALIZED (
    SELECT word::BIGINT << 32 | p, id, 0 FROM start
    UNION ALL
    (WITH pairs AS (
        SELECT place, place >> 32 AS word, id, round, row_number() OVER follow AS nth, lead(place) OVER follow AS next,
            CASE WHEN lead(place) OVER follow >> 32 = place >> 32 THEN id::BIGINT << 32 | lead(id) OVER follow END AS pair
        FROM state WINDOW follow AS (ORDER BY place)
    ), ranked AS MATERIALIZED (
        SELECT pairs.* EXCLUDE (pair), rank, alone, crossing FROM pairs LEFT JOIN merges USING (pair)
    ), least AS (
        SELECT word, min(rank::BIGINT << 32 | (place & 4294967295)) AS first FROM ranked WHERE rank IS NOT NULL GROUP BY word
    ), marked AS MATERIALIZED (
        SELECT ranked.*, coalesce(rank = first >> 32 AND (NOT alone OR place & 4294967295 = first & 4294967295), false) AS hit
        FROM ranked JOIN least USING (word)
    ), every_second AS (
        SELECT place FROM (SELECT place, row_number() OVER (PARTITION BY word, run ORDER BY nth) AS n FROM (
            SELECT place, word, nth, nth - row_number() OVER (PARTITION BY word ORDER BY nth) AS run
            FROM marked WHERE hit AND crossing)) WHERE n % 2 = 0
    ), taken AS (
        SELECT next FROM marked WHERE hit AND (NOT crossing OR place NOT IN (FROM every_second))
    )
    SELECT m.place, CASE WHEN m.hit THEN m.rank ELSE m.id END, m.round + 1
    FROM marked m ANTI JOIN taken t ON m.place = t.next WHERE m.round < {rounds})
), last AS (
    SELECT place >> 32 AS word, max(round) AS round FROM state GROUP BY 1
)
SELECT word, s.round AS round, list(id ORDER BY place) AS ids
FROM state s JOIN last ON s.place >> 32 = word AND s.round = last.round
GROUP BY word, s.round ORDER BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens that makes a token, with that token's rank."""
    pairs, made, alone, crossing = [], [], set(), set()
    for token, rank in ranks.items():
        left, right = set(), set()
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs.append(a << 32 | b)
                made.append(rank)
                alone.update(x for x in (a, b) if x > rank)
                left.add(a)
                right.add(b)
        if left & right:
            crossing.add(rank)
    return pa.table({
        "pair": pa.array(pairs, pa.int64()), "rank": pa.array(made, pa.int32()),
        "alone": [r in alone for r in made], "crossing": [r in crossing for r in made]})


class Tokens(dict):
    """Bytes by id; none for an id outside the vocabulary."""

    def __missing__(self, token: int) -> bytes:
        return b""


class Coder:
    """A worker's database with one vocabulary, and the ids of words seen so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        ranks = self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.unusual = regex.compile(r"\s (?:\s|\Z)").search
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.tokens = Tokens((rank, token) for token, rank in ranks.items())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.register("given", _merge_table(ranks))
        self.db.execute("CREATE TABLE merges AS FROM given")
        self.db.unregister("given")

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, given as their bytes."""
        done: list[bytes] = [b""] * len(words)
        going, sizes = np.arange(len(words)), np.array([len(w) for w in words])
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        while len(going):
            rounds = int(max(1, min(ROUNDS, ROWS // sizes.sum())))
            at = np.arange(sizes.sum()) - (sizes.cumsum() - sizes).repeat(sizes)
            self.db.register("start", pa.table({"word": going.repeat(sizes), "p": at, "id": ids}))
            found = self.db.sql(_CONTRACT.format(rounds=rounds)).to_arrow_table().combine_chunks()
            self.db.unregister("start")
            lists = found["ids"].chunk(0)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4")
            data, word = flat.tobytes(), found["word"].to_numpy()
            for i, a, b in zip(word.tolist(), (4 * ends).tolist(), (4 * ends[1:]).tolist(), strict=False):
                done[i] = data[a:b]
            # A word that changed in the last round may change further.
            more = found["round"].to_numpy() == rounds
            sizes, going = np.diff(ends)[more], word[more]
            ids = flat[more.repeat(np.diff(ends))]
        return done

    def _learn(self, words: Iterable[str]) -> None:
        group, size = [], 0
        for word in [*words, None]:
            # A word that is a token is that token, as in tiktoken.
            token = None if word is None else self.ranks.get(word.encode())
            if token is not None:
                self.known[word] = token.to_bytes(4, "little")
                continue
            if group and (word is None or size + len(word) > WORD_BYTES):
                self.known.update(zip(group, self._contracted([w.encode() for w in group]), strict=True))
                group, size = [], 0
            if word is not None:
                group.append(word)
                size += len(word)

    def _words(self, unit: str) -> list[str]:
        """A stretch cut by the pattern; a space and letters are one word of it."""
        return [unit] if unit[:1] == " " and unit[1:].isalpha() else self.find(unit)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of texts.

        A space before a word always begins a word of the pattern, unless white space
        stands before it and no word after it: such texts are cut by the pattern as a
        whole, the others space by space, so that each stretch is cut only once.
        """
        units = []
        for text in texts:
            if not text:
                units.append([])
            elif self.unusual(text):
                units.append(self.find(text))
            else:
                first, *rest = text.split(" ")
                units.append(([first] if first else []) + [" " + x for x in rest])
        if len(self.known) > ROOM:
            # The words met first are the common ones.
            self.known = dict(islice(self.known.items(), ROOM // 2))
        known = self.known
        new = set().union(*units) - known.keys()
        parts = {u: self._words(u) for u in new}
        self._learn({w for found in parts.values() for w in found if w not in known})
        for unit, words in parts.items():
            if unit not in known:
                known[unit] = b"".join(map(known.__getitem__, words))
        return [b"".join(map(known.__getitem__, found)) for found in units]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of sequences of ids."""
        token = self.tokens.__getitem__
        return [b"".join(map(token, x.tolist())) for x in ids]


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def _groups(sizes: list[int], most: int) -> Iterator[slice]:
    """Neighbouring rows of ``most`` in all, or one larger row."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def encoded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids, in order: doc_id, n_tokens, ids."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary, pattern)
        for batch in batches:
            sizes = [x or 0 for x in pc.utf8_length(batch[1]).to_pylist()]
            for part in _groups(sizes, CHARS):
                rows = batch.slice(part.start, part.stop - part.start)
                ids = [np.frombuffer(x, "<i4") for x in code.encode([x or "" for x in rows[1].to_pylist()])]
                n = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], n.cumsum()]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([rows[0], pa.array(n), lists.cast(arrow.field("ids").type)], schema=arrow)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decoded(rows: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``bytes``, what their ids stand for; null ids, and ids outside the vocabulary, give no bytes."""
    schema = T.StructType([*rows.schema.fields, T.StructField("bytes", T.BinaryType())])
    arrow, place = to_arrow_schema(schema), rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary, pattern)
        for batch in slices(batches):
            ids = [np.array([] if x.values is None else x.values.to_numpy(zero_copy_only=False), np.int32) for x in batch[place]]
            for part in _groups([len(x) for x in ids], TOKENS):
                data = code.decode(ids[part])
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(data, pa.binary())], schema=arrow)

    return rows.mapInArrow(run, schema)
