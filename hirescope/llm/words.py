"""Words and their hashes, remembered while a Python worker lives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words remembered by a worker before it starts afresh: bounds its memory.
ROOM = 100_000

#: Rows that a worker turns into Python objects at a time: texts may be long.
ROWS = 250
ARROW_ROWS = 1000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= ROOM:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Known()


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def finish(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit value over the others."""
    h = (h ^ (h >> np.uint64(32))) * _FOLD
    h = (h ^ (h >> np.uint64(32))) * _FOLD
    return h ^ (h >> np.uint64(32))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words; of the whole where there are fewer."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        out = finish(out + hashes[i: len(hashes) - size + 1 + i] + _MIX)
    return out


def set_up(spark: SparkSession) -> None:
    """A job's setting for long texts: few rows in an Arrow batch, so that neither side
    of a Python worker holds thousands of texts at once. Jobs call it, operators don't."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def mapped(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
           schema: T.StructType | str) -> DataFrame:
    """``mapInPandas`` over few rows at a time; whole numbers stay whole beside nulls."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(part.to_pandas(integer_object_nulls=True) for part in slices(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(run, schema)
