"""Toxicity by a subsequence-kernel support vector machine.

The kernel of two words is the cosine of their gapped subsequences: every three
characters in order within ``SPAN`` places, weighted by ``DECAY`` to the power of the
places they take, the word's ends being characters too. Characters put in or left
out move a word a little, not away. Landmark words give Nystrom features; a linear
machine over them is, put back, one weight for each subsequence of the landmarks, so
scoring a word costs a look-up for each of its subsequences.

A text is as toxic as its worst words. A word is read as written, without what is not a
letter, and joined where it stands spelled out in single characters. Training takes a bounded sample of labelled texts
(``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN``): words that stand, or whose stem stands, in toxic
texts at least half of the time, and more often than chance gives, are the positives,
words of clean texts the negatives; the machine then takes in the clean words it finds
worst and is fitted again. A logistic curve turns the scores of a text's ``WORST`` worst
places and its length into a probability, which never falls as a place gets worse.

Nulls: a null text is empty, and an empty text scores as one without toxic words. A
null id is kept and never held out. Labels that are null are not used. Repeated rows
give a row each; an empty table gives none. With no toxic or no clean label to learn
from every score is the share of toxic labels, or 0. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.words import mapped, slices
from hirescope.session import written

SPAN, DECAY = 6, 0.7
#: Characters of a word that are read at once; longer words are read in stretches.
LONGEST = 24
LANDMARKS = 128
SAMPLE_TOXIC, SAMPLE_CLEAN = 2_000, 6_000
#: Characters in the stems that are counted.
STEMS = (4, 5, 6)
#: Words of each kind that the machine is fitted on.
FITTED = 4_000
THRESHOLD = 0.3
#: Places of a text that its probability is read from; and the number of facts on a text.
WORST = 4
FACTS = WORST + 1
#: Words whose score a worker remembers before it forgets the older ones, down to half.
ROOM = 200_000

_TRIPLES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_WEIGHTS = np.array([DECAY ** (b + 1) for b in range(2, SPAN)], np.float32)
#: Bits of a character in a code (the last plane of Unicode, of private characters, falls
#: on the first), and bits for the place of a weight.
_CHAR, _WEIGHT = np.uint64(20), np.uint64(2)
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Single characters, for a text with white space before it: a pattern that begins with
#: a set of characters is searched for faster than one that begins with a look-behind.
_SEPARATES = np.isin(np.arange(129), [ord(c) for c in " .*_-"])
_SPELLED = re.compile(r"\s\w(?:[ .*_-]\w){3,}(?!\S)")
_BLOOM = np.uint64(0x9E3779B97F4A7C15)


def _subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of words of about one length, their subsequences' codes (0: none), and
    weights scaled to a word's length 1, equal codes of a word summed."""
    lengths = np.fromiter(map(len, words), int, len(words))
    for low, high in ((0, 6), (6, 10), (10, 14), (14, LONGEST + 1)):
        rows = np.flatnonzero((lengths >= low) & (lengths < high))
        if not len(rows):
            continue
        size = high + 1
        c = np.array(["\x02" + words[i] + "\x03" for i in rows], dtype=f"U{size + SPAN}").view(np.uint32)
        c = c.reshape(len(rows), -1).astype(np.uint64) & np.uint64(0xFFFFF)
        # A weight goes with its code as the code's low bits, so plain sorting keeps them together.
        last = c << _WEIGHT
        middle = last << _CHAR
        first = (middle << _CHAR)[:, :size]
        both = np.concatenate([
            (first | middle[:, a:size + a] | last[:, b:size + b] | np.uint64(b - 2)) * (c[:, b:size + b] > 0)
            for a, b in _TRIPLES], axis=1)
        both.sort(axis=1)
        codes = both >> _WEIGHT
        weights = np.where(codes > 0, _WEIGHTS[both & np.uint64(3)], np.float32(0))
        flat = codes.ravel()
        fresh = np.ones(codes.shape, bool)
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
        starts = np.flatnonzero(fresh.ravel())
        total = np.add.reduceat(weights.ravel(), starts)
        row = starts // codes.shape[1]
        norm = np.sqrt(np.bincount(row, weights=total * total, minlength=len(rows)))
        yield rows[row], flat[starts], (total / np.maximum(norm, 1e-12)[row]).astype(np.float32)


def _stretches(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[i:i + LONGEST] for i in range(0, len(word) - step, step)]


def readings(word: str) -> list[str]:
    """The words a token may be: as written, and its letters alone."""
    if len(word) <= LONGEST and word.isalpha():
        return [word]
    letters = word if word.isalpha() else "".join(filter(str.isalpha, word))
    return [s for w in dict.fromkeys((word, letters)) if w for s in _stretches(w)]


def _may_spell(text: str) -> bool:
    """Whether separators stand at three places two apart, as in any spelled word."""
    s = _SEPARATES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]
    return len(s) > 4 and bool((s[:-4] & s[2:-2] & s[4:]).any())


def tokens(text: str | None) -> list[str]:
    """Stretches without white space, without punctuation at their ends."""
    if not text:
        return []
    text = text.lower()
    spelled = [re.sub(r"\W|_", "", m[0]) for m in _SPELLED.finditer(" " + text)] if _may_spell(text) else []
    return [t.strip(_EDGE) for t in text.split()] + spelled


class Machine:
    """Subsequences, their weights, the bias, and the logistic curve's numbers."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float):
        self.codes, self.weights, self.bias, self.curve = codes, weights, bias, np.zeros(FACTS + 1)
        self.name = uuid.uuid4().hex
        self.bloom = np.zeros(1 << 16, bool)
        self.bloom[(codes * _BLOOM) >> np.uint64(48)] = True

    def words(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for place, codes, value in _subsequences(words):
            maybe = np.flatnonzero(self.bloom[(codes * _BLOOM) >> np.uint64(48)])
            at = np.minimum(np.searchsorted(self.codes, codes[maybe]), len(self.codes) - 1)
            hit = self.codes[at] == codes[maybe]
            out += np.bincount(place[maybe[hit]], weights=self.weights[at[hit]] * value[maybe[hit]], minlength=len(words))
        return out

    def learn(self, known: dict[str, float], fresh: list[str]) -> None:
        """Enter the worst reading of each token."""
        for i in range(0, len(fresh), 4_000):
            part = fresh[i:i + 4_000]
            read = [readings(t) for t in part]
            flat = [w for r in read for w in r]
            scores = self.words(flat).tolist() if flat else []
            if len(flat) == len(part) and all(read):
                known.update(zip(part, scores, strict=True))
                continue
            rest = iter(scores)
            for token, r in zip(part, read, strict=True):
                known[token] = max((next(rest) for _ in r), default=self.bias)

    def texts(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """The scores of the ``WORST`` worst places of each text, and its length's
        logarithm."""
        out = np.full((len(texts), FACTS), self.bias)
        for i in range(0, len(texts), 200):
            parts = [tokens(t) for t in texts[i:i + 200]]
            self.learn(known, list(set().union(*parts) - known.keys()))
            for row, p in enumerate(parts, i):
                scores = np.fromiter(map(known.__getitem__, p), float, len(p))
                top = np.sort(np.partition(scores, -WORST)[-WORST:] if len(p) > WORST else scores)[::-1]
                out[row, :len(top)] = top
                out[row, WORST] = np.log1p(len(p))
            if len(known) > ROOM:
                for token in list(islice(known, len(known) - ROOM // 2)):
                    del known[token]
        return out

    def probability(self, facts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(facts @ self.curve[:-1] + self.curve[-1], -500, 500)))


def _features(words: list[str], codes: np.ndarray) -> np.ndarray:
    """Weights of the given subsequences (sorted) in each word."""
    out = np.zeros((len(words), len(codes)), np.float32)
    for place, own, value in _subsequences(words):
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        hit = codes[at] == own
        out[place[hit], at[hit]] = value[hit]
    return out


def _kernel(words: list[str], basis: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([_features(words[i:i + 500], codes) @ basis.T for i in range(0, len(words), 500)])


def _spread(words: list[str], n: int) -> list[str]:
    """So many of the words, each the farthest from those before (first come, first)."""
    words = words[:1500]
    codes = np.unique(np.concatenate([c for _, c, _ in _subsequences(words)]))
    chosen, near = [0], _kernel(words, _features(words[:1], codes), codes)[:, 0]
    while len(chosen) < min(n, len(words)):
        best = int(near.argmin())
        if near[best] > 0.98:
            break
        chosen.append(best)
        near = np.maximum(near, _kernel(words, _features([words[best]], codes), codes)[:, 0])
    return [words[i] for i in chosen]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps on the rows inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    weight = weight / weight.sum()
    for _ in range(40):
        inside = y * (x @ w) < 1
        xi, wi = x[inside], weight[inside]
        new = np.linalg.solve((xi * wi[:, None]).T @ xi + ridge, (xi * wi[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def machine(positive: list[str], negative: list[str]) -> Machine:
    """The machine that tells the positive words from the negative ones."""
    marks = _spread(positive, LANDMARKS * 3 // 4)
    codes = np.unique(np.concatenate([c for _, c, _ in _subsequences(marks)]))
    nearest = _kernel(negative, _features(marks, codes), codes).max(axis=1)
    marks += [negative[i] for i in np.argsort(-nearest, kind="stable")[:LANDMARKS - len(marks)]]
    marks = list(dict.fromkeys(marks))
    codes = np.unique(np.concatenate([c for _, c, _ in _subsequences(marks)]))
    basis = _features(marks, codes)
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    words = positive + negative
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    weight = np.concatenate([np.full(len(positive), 1 / len(positive)), np.full(len(negative), 1 / len(negative))])
    w, bias = _svm(_kernel(words, basis, codes) @ root, y, weight)
    return Machine(codes[1:] if codes[0] == 0 else codes, (basis.T @ (root @ w))[int(codes[0] == 0):], bias)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _word_counts(sample: DataFrame) -> DataFrame:
    """word, stem, toxic, clean: texts of either label that hold each reading or, where
    ``stem``, a word that begins so."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, stems = (Counter(), Counter()), (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                own = {w for t in set(tokens(text)) for w in readings(t)}
                words[int(toxic)].update(own)
                stems[int(toxic)].update({w[:n] for w in own for n in STEMS if len(w) > n})
            rows = [(w, kind, clean[w], toxic[w]) for kind, (clean, toxic) in ((False, words), (True, stems))
                    for w in clean.keys() | toxic.keys()]
            yield pd.DataFrame(rows, columns=["word", "stem", "clean", "toxic"])

    return mapped(sample, count, "word string, stem boolean, toxic long, clean long").groupBy("word", "stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _telling(counts: DataFrame, share: float) -> DataFrame:
    """The words and stems that at least half of the time stand in toxic texts, and that
    chance would hardly put there once in the whole list (Chernoff's bound)."""
    repeated = max(2, counts.filter("toxic + clean > 1").count())
    n, t = F.col("toxic") + F.col("clean"), F.col("toxic")
    part = t / n
    gain = t * F.log(part / share) + F.when(t < n, (n - t) * F.log((1 - part) / (1 - share))).otherwise(0.0)
    return counts.filter((part >= max(0.5, share)) & (gain >= float(np.log(repeated))))


def _first_positives(counts: DataFrame, share: float) -> list[str]:
    """Telling words, and words of toxic texts alone whose stem is telling; the most
    frequent first."""
    telling = _telling(counts, share)
    # Telling stems are few: the longest lists are a few thousand.
    stems = telling.filter("stem").orderBy(F.desc("toxic"), "word").limit(FITTED)
    stems = stems.select(F.col("word").alias("_stem"), F.col("toxic").alias("_toxic"))
    words = counts.filter("clean = 0 AND NOT stem")
    by_stem = words.withColumn("_stem", F.explode(F.array(*(F.substring("word", 1, n) for n in STEMS)))).join(
        F.broadcast(stems), "_stem").filter(F.length("word") > F.length("_stem")).select("word", "_toxic")
    own = telling.filter("NOT stem").select("word", F.col("toxic").alias("_toxic"))
    best = own.union(by_stem).groupBy("word").agg(F.max("_toxic").alias("n")).orderBy(
        F.desc("n"), F.xxhash64("word"), "word").limit(FITTED)
    return [r["word"] for r in best.collect()]


def trained(docs: DataFrame, labels: DataFrame) -> Machine | float:
    """A machine fitted on the labelled rows that are not held out; the share of toxic
    ones where one of the labels is missing. ``docs``: doc_id, text; ``labels``:
    doc_id, toxic."""
    own = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", "toxic").distinct()
    shuffled = [F.xxhash64("doc_id"), "doc_id"]
    some = own.filter("toxic = 1").orderBy(*shuffled).limit(SAMPLE_TOXIC).union(
        own.filter("toxic = 0").orderBy(*shuffled).limit(SAMPLE_CLEAN))
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN ids.
    sample = written(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "labelled").select("text", "toxic")
    n = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return float(bool(n.get(True)))
    counts = written(_word_counts(sample), "words")
    share = n[True] / (n[True] + n[False])
    positive = _first_positives(counts, share)
    clean = counts.filter("clean > 0 AND NOT stem").select("word")
    if positive:
        # At most FITTED words.
        clean = clean.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in positive], "word string")), "word", "left_anti")
    negative = [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(FITTED).collect()]
    if not positive or not negative:
        return share
    fitted = machine(positive, negative)
    for _ in range(2):
        negative = list(dict.fromkeys(_worst(clean, fitted) + negative))[:2 * FITTED]
        fitted = machine(positive, negative)
    rows = _facts(sample, fitted).collect()
    fitted.curve = _curve(np.array([r["facts"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return fitted


def _worst(clean: DataFrame, fitted: Machine) -> list[str]:
    """The clean words that the machine finds most toxic."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=fitted.words(batch["word"].tolist()) if len(batch) else [])

    top = mapped(clean, score, "word string, score double").orderBy(F.desc("score"), "word").limit(FITTED // 4)
    return [r["word"] for r in top.collect()]


#: Scores by token that this worker remembers, of the last machine it met.
_remembered: dict[str, dict[str, float]] = {}


def _known_to(fitted: Machine) -> dict[str, float]:
    if fitted.name not in _remembered:
        _remembered.clear()
    return _remembered.setdefault(fitted.name, {})


def _facts(rows: DataFrame, fitted: Machine) -> DataFrame:
    """``facts`` of each row in place of ``text``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(facts=list(fitted.texts(batch["text"].tolist(), _known_to(fitted))))

    fields = [f for f in rows.schema if f.name != "text"]
    return mapped(rows, read, T.StructType([*fields, T.StructField("facts", T.ArrayType(T.DoubleType()))]))


def _logistic(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression, lightly held back."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (toxic - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _curve(facts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the facts that never falls as a place gets
    worse: a place that would count against toxicity is left out, the worst such first.

    A text's first places are mostly alike in toxic texts, so the plain fit may set
    them against each other.
    """
    x = np.column_stack([facts, np.ones(len(facts))])
    used = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[used] = _logistic(x[:, used], toxic)
        if w[:WORST].min() >= 0:
            return w
        used[w[:WORST].argmin()] = False


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fitted = trained(rows, labels)
    if isinstance(fitted, float):
        out = rows.select("doc_id", F.lit(fitted).alias("score"))
    else:
        *factors, start = (float(x) for x in fitted.curve)
        linear = sum((F.col("facts")[i] * a for i, a in enumerate(factors)), F.lit(start))
        out = _facts(rows, fitted).select("doc_id", (1 / (1 + F.exp(-linear))).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not found toxic, whole. ``docs`` has ``doc_id``."""
    fitted = trained(docs.select("doc_id", F.col(text_col).alias("text")), labels)
    if isinstance(fitted, float):
        return docs

    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            facts = fitted.texts(batch.column(place).to_pylist(), _known_to(fitted))
            yield batch.filter(pa.array(fitted.probability(facts) < THRESHOLD))

    return docs.mapInArrow(clean, docs.schema)
