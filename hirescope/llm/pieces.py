"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary's pieces reads a text once. At each
position the pieces that end there come off the automaton's output links, each
relaxing the best score of the position; a character that no piece covers costs
its bytes, written with the byte pieces. Ties: the longer last piece.

No piece of such vocabularies holds a space mark after another character, so a text
falls into stretches (marks, then other characters) that are segmented once each.
A space mark that stands in the text itself is written in bytes, so decoding gives
back every text exactly.

Nulls: a null text is empty and has no pieces; a null id is kept. Repeated rows give
a row each; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.words import mapped

MARK = "▁"
#: Stretches a worker remembers before it starts afresh.
ROOM = 150_000
_STRETCH = re.compile(" *[^ ]+| +")


class Pieces:
    """A vocabulary's automaton, byte pieces and scores."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        self.scores = np.zeros(n)
        self.automaton = ahocorasick.Automaton()
        #: Characters that are pieces: bytes cost more than these do, wherever they stand.
        self.covered: set[str] = set()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.missing = min(model.get_score(i) for i in plain) - 10
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value], self.texts[i], self.scores[i] = i, bytes([value]), self.missing
        for i in plain:
            piece, score = model.id_to_piece(i), model.get_score(i)
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece holds a space mark after another character")
            self.texts[i], self.scores[i] = piece.replace(MARK, " ").encode(), score
            self.automaton.add_word(piece, (i, len(piece), score))
            if len(piece) == 1:
                self.covered.add(piece)
        self.automaton.make_automaton()
        segment = self.segment

        class Known(dict):
            def __missing__(self, stretch: str) -> bytes:
                if len(self) >= ROOM:
                    self.clear()
                value = segment(stretch)
                if len(stretch) <= 64:
                    self[stretch] = value
                return value

        self.known = Known()

    def segment(self, stretch: str) -> bytes:
        """32-bit ids of the best segmentation of a stretch (spaces stand for marks)."""
        stretch = stretch.replace(" ", MARK)
        n = len(stretch)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        ids: list[int] = []
        if self.covered.issuperset(stretch):
            for end, (piece, length, score) in self.automaton.iter(stretch):
                end += 1
                start = end - length
                total, least = best[start] + score, best[end]
                if total > least or (total == least and start < back[end][0]):
                    best[end] = total
                    back[end] = start, piece
            while n:
                n, piece = back[n]
                ids.append(piece)
            ids.reverse()
            return array("I", ids).tobytes()
        at = 0

        def bytes_up_to(end: int) -> None:
            for p in range(at, end):
                cost = best[p] + self.missing * len(stretch[p].encode("utf-8", "surrogatepass"))
                if cost > best[p + 1]:
                    best[p + 1], back[p + 1] = cost, (p, -1)

        for end, (piece, length, score) in self.automaton.iter(stretch):
            if at < end:
                bytes_up_to(end)
                at = end
            start = end + 1 - length
            total = best[start] + score
            if total > best[end + 1] or (total == best[end + 1] and start < back[end + 1][0]):
                best[end + 1], back[end + 1] = total, (start, piece)
        bytes_up_to(n)
        while n:
            start, piece = back[n]
            ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(stretch[start:n].encode("utf-8", "surrogatepass"))]
            n = start
        return array("I", reversed(ids)).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        own = array("I", [self.byte_ids[b] for b in MARK.encode()]).tobytes()
        parts = (" " + text).split(MARK)
        known = self.known.__getitem__
        return own.join(b"".join(map(known, _STRETCH.findall(p))) for p in parts)

    def decode(self, ids: bytes) -> str:
        texts = self.texts
        return b"".join([texts[i] for i in array("I", ids)])[1:].decode("utf-8", "surrogatepass")


_loaded: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array), score: the best segmentation of each text."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for batch in batches:
            ids = [np.frombuffer(v.encode(t or ""), np.int32) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "score": [float(v.scores[i].sum()) for i in ids]})

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType())])
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), encode, schema)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, score, text: the texts of ``ids``."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for batch in batches:
            ids = [np.asarray(i, np.int32).tobytes() for i in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_pieces": [len(i) // 4 for i in ids],
                                "ids_crc32": [zlib.crc32(i) for i in ids], "score": batch["score"],
                                "text": pd.Series([v.decode(i) for i in ids], dtype=object)})

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType())])
    return mapped(rows.select("doc_id", "ids", "score"), decode, schema)
