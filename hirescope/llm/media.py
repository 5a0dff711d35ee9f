"""Texts as audio: WAV storage, short-time Fourier transforms, fingerprints.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become the
8-bit samples of a mono WAV file. The file is read back by the ``wave`` module;
its spectral peaks (the strongest cell of each zone of frames and band of
frequencies) are paired with the next ones, and each pair is a fingerprint:
frequencies and time between, coded with the time of the first.

Nulls: a null text is empty, and empty texts are 64 zero bytes, whose flat
spectrum has its peaks in each band's first cell. A null id is kept. Long texts
are read in blocks of frames. Equal texts give equal results; repeated rows give
a row each; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.words import mapped

RATE, UNIT = 8000, 64
#: Samples in a frame and between frames; frames in a zone; bands of frequencies.
FRAME, HOP, ZONE, BANDS = 64, 32, 32, 4
#: Later peaks that a peak is paired with.
FAN = 3
_WINDOW = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)
_ZONES_AT_ONCE = 256


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload and the number of bytes before padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT)), len(data)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency of the strongest cell of each zone and band, by time.
    Ties: the earliest frame, then the lowest frequency."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    width = (FRAME // 2) // BANDS
    at, freq = [], []
    for i in range(0, len(frames), ZONE * _ZONES_AT_ONCE):
        block = (frames[i:i + ZONE * _ZONES_AT_ONCE].astype(np.float32) - 128) * _WINDOW
        power = np.round(np.abs(np.fft.rfft(block, axis=1)[:, 1:]), 3)
        short = -len(power) % ZONE
        power = np.pad(power, ((0, short), (0, 0)), constant_values=-1)
        best = power.reshape(-1, ZONE, BANDS, width).transpose(0, 2, 1, 3).reshape(-1, BANDS, ZONE * width).argmax(axis=2)
        zone = np.arange(len(best))[:, None] * ZONE
        at.append((i + zone + best // width).ravel())
        freq.append((1 + np.arange(BANDS) * width + best % width).ravel())
    t, f = np.concatenate(at), np.concatenate(freq)
    order = np.lexsort((f, t))
    return t[order], f[order]


def fingerprints(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (in frames) and hashes of the pairs of near peaks."""
    t, f = peaks(samples)
    times, hashes = [], []
    for step in range(1, FAN + 1):
        apart = np.minimum(t[step:] - t[:-step], 1023)
        times.append(t[:-step])
        hashes.append(f[:-step] << 16 | f[step:] << 10 | apart)
    times, hashes = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((hashes, times))
    return times[order].astype(np.int32), hashes[order].astype(np.int32)


_SCHEMA = [
    T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("hashes", T.ArrayType(T.IntegerType())),
]


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """The stored form's facts and fingerprints (``times``, ``hashes``) for each
    row; with ``keep_media`` the WAV file itself in ``media``."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                payload, n = padded(text)
                media = to_wav(payload)
                read = from_wav(media)
                times, hashes = fingerprints(np.frombuffer(read, np.uint8))
                mark = hashlib.sha256(times.tobytes() + hashes.tobytes()).hexdigest()
                rows.append((key, n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-UNIT:]), len(media),
                             hashlib.sha256(media).hexdigest(), f"{len(times)}:{mark}", times, hashes, *[media] * keep_media))
            yield pd.DataFrame(rows, columns=[f.name for f in schema], dtype=object).astype({"doc_id": batch["doc_id"].dtype})

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *_SCHEMA,
                           *[T.StructField("media", T.BinaryType())] * keep_media])
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), store, schema)
