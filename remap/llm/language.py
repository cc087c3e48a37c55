"""Language ID: sparse multinomial logistic regression on character n-grams.

* A text becomes letters and single spaces, lower-cased; its features are hashed
  character 1- to 3-grams, weighted by term frequency times inverse document
  frequency.  Document frequencies are counted over all rows that may be learned.
* The model is trained with the follow-the-regularised-leader update under an
  elastic net (L1 and L2), on a bounded sample of labelled rows.
* A temperature fitted on a part of the sample that training did not see turns
  the model's outputs into calibrated probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remap.llm.texts import SLICE_BYTES, mix64

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SCALE = 100.0  # term frequencies are shares; this brings them near one
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def text_slices(texts: list[str], limit: int = SLICE_BYTES // 16) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` characters, and of one row at least."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


@dataclass
class Grams:
    """Hashed n-grams of several texts, in one array per order."""

    buckets: list[np.ndarray]
    valid: list[np.ndarray]
    offsets: np.ndarray  # where each text starts, and the end
    has_letter: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Grams:
        spaced = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(t) for t in spaced])
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        letter = _is_letter()[codes]
        # Keep letters, the first space of a run and each text's first space.
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[starts] = True
        kept = np.where(letter, codes, 32)[keep].astype(np.uint64)
        at = np.concatenate(([0], np.cumsum(keep)))
        offsets = np.concatenate((at[starts], at[-1:]))
        space = kept == 32
        double = space[:-1] & space[1:]  # only where two texts meet
        buckets, valid = [], []
        for n in ORDERS:
            count = max(0, len(kept) - n + 1)
            value = np.full(count, n, dtype=np.uint64)
            for i in range(n):
                value = value * np.uint64(0x9E3779B97F4A7C15) + kept[i : i + count]
            fine = ~space[:count] if n == 1 else np.ones(count, dtype=bool)
            for i in range(n - 1):
                fine &= ~double[i : i + count]
            buckets.append((mix64(value) >> np.uint64(48)).astype(np.int32))
            valid.append(fine)
        sums = np.add.reduceat(letter, starts) if len(starts) else np.zeros(0)
        return cls(buckets, valid, offsets, sums > 0)

    def counts(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of text ``i`` and how often each occurs."""
        a, b = self.offsets[i], self.offsets[i + 1]
        own = [x[a:b][v[a:b]] for x, v in zip(self.buckets, self.valid)]
        return np.unique(np.concatenate(own), return_counts=True)

    def averages(self, weights: np.ndarray) -> np.ndarray:
        """Mean of the weight rows over each text's n-grams (zero without any)."""
        texts, total = len(self.offsets) - 1, 0
        sums = np.zeros((texts, weights.shape[1]))
        for x, v in zip(self.buckets, self.valid):
            rows = np.zeros((self.offsets[-1], weights.shape[1] + 1))
            rows[: len(x), :-1] = weights[x]
            rows[: len(x), -1] = 1
            rows[: len(x)] *= v[:, None]
            part = np.add.reduceat(rows, self.offsets[:-1], axis=0)
            sums += part[:, :-1]
            total = total + part[:, -1]
        return sums / np.maximum(total, 1)[:, None]


@dataclass
class LanguageModel:
    """Weights already multiplied with the inverse document frequency."""

    languages: list[str]
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0

    def probabilities(self, grams: Grams) -> np.ndarray:
        return _softmax((grams.averages(self.weights) + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader for a multinomial logit, per coordinate."""

    def __init__(self, features: int, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.1):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        slope = _softmax(x @ w)
        slope[label] -= 1
        g = x[:, None] * slope
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def document_frequencies(df: DataFrame, text_col: str) -> np.ndarray:
    """In how many rows each bucket occurs, then the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in text_slices(texts):
                grams = Grams.of(texts[a:b])
                for i in range(b - a):
                    seen = np.zeros(BUCKETS + 1, dtype=bool)
                    for x, v in zip(grams.buckets, grams.valid):
                        s, e = grams.offsets[i], grams.offsets[i + 1]
                        seen[x[s:e][v[s:e]]] = True
                    seen[BUCKETS] = True
                    total += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "rows"])

    counted = df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket long, rows long")
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for bucket, rows in counted.groupBy("bucket").agg(F.sum("rows").alias("rows")).collect():
        out[bucket] = rows  # at most BUCKETS + 1 rows reach the driver
    return out


def _sample(df: DataFrame, text_col: str, lang_col: str, key: Column, per_language: int) -> pd.DataFrame:
    """N-gram counts of about ``per_language`` rows of each language, chosen by a hash of the key."""
    sizes = {lang: n for lang, n in df.groupBy(F.col(f"`{lang_col}`")).count().collect()}
    # A share in millionths per language; the hash spreads rows evenly over them.
    shares = reduce(
        lambda expr, item: expr.when(
            F.col(f"`{lang_col}`") == item[0], F.lit(min(1_000_000, 1_000_000 * per_language // item[1] + 1))
        ),
        sizes.items(),
        F.when(F.lit(False), F.lit(0)),
    )
    spread = F.coalesce(F.pmod(F.xxhash64(key.cast("string")), F.lit(1_000_000)), F.lit(0))
    chosen = df.where(spread < shares).select(
        F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), spread.alias("spread")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in text_slices(texts):
                grams = Grams.of(texts[a:b])
                each = [grams.counts(i) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[a:b], batch.column(2)[a:b],
                     pa.array([x.astype(np.int32).tobytes() for x, _ in each], pa.binary()),
                     pa.array([n.astype(np.int32).tobytes() for _, n in each], pa.binary())],
                    ["lang", "spread", "at", "n"],
                )

    rows = chosen.mapInArrow(count, "lang string, spread long, at binary, n binary").toPandas()
    order = np.argsort([hash_of(a, n) for a, n in zip(rows["at"], rows["n"])], kind="stable")
    return rows.iloc[order]


def hash_of(*parts: bytes) -> int:
    """An order of training rows that does not depend on how Spark split them."""
    return zlib.crc32(b"".join(bytes(p) for p in parts))


def train(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    per_language: int = 1500, epochs: int = 3, calibration: float = 0.2,
) -> LanguageModel:
    """Learn from the rows of ``df`` with a language; null texts count as empty.

    The classifier is fitted on about ``per_language`` rows of each language (the
    bound of the sample); document frequencies cover every row.  With no labelled
    row the model knows no language and calls every text unknown.
    """
    known = df.where(F.col(f"`{lang_col}`").isNotNull())
    rows = _sample(known, text_col, lang_col, F.col(f"`{id_col}`"), per_language)
    languages = sorted(rows["lang"].unique())
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 1)), np.zeros(1))
    found = document_frequencies(known, text_col)
    idf = np.log((1 + found[-1]) / (1 + found[:-1])) + 1
    model = Ftrl(BUCKETS + 1, len(languages))  # the last feature is the bias
    samples, held = [], []
    for i, (lang, at, n) in enumerate(zip(rows["lang"], rows["at"], rows["n"])):
        at, n = np.frombuffer(at, np.int32), np.frombuffer(n, np.int32)
        if len(at):
            x = np.append(SCALE * n / n.sum() * idf[at], 1.0)
            item = (np.append(at, BUCKETS), x, languages.index(lang))
            (held if i % round(1 / calibration) == 0 and len(rows) >= 50 else samples).append(item)
    for _ in range(epochs):
        for at, x, label in samples:
            model.learn(at, x, label)
    w = model.weights()
    temperature = 1.0
    if held:
        z = np.stack([x @ w[at] for at, x, _ in held])
        y = np.array([label for *_, label in held])
        grid = np.geomspace(0.05, 20, 120)
        # The last term keeps the temperature near one where the held rows say nothing.
        loss = [
            -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() + 2e-3 * np.log(t) ** 2 for t in grid
        ]
        temperature = float(grid[int(np.argmin(loss))])
    return LanguageModel(languages, SCALE * idf[:, None] * w[:-1], w[-1], temperature)


def identify(df: DataFrame, model: LanguageModel, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` (the calibrated probability).

    A null text, or one without a letter, is ``und`` with score 0.  The language of a
    text depends on nothing but the text.  A column of ``keep`` with an output's name
    is replaced.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            for a, b in text_slices(texts):
                grams = Grams.of(texts[a:b])
                if model.languages:
                    p = model.probabilities(grams)
                    best = p.argmax(axis=1)
                    lang = [model.languages[j] if ok else UNKNOWN for j, ok in zip(best, grams.has_letter)]
                    score = np.where(grams.has_letter, p.max(axis=1), 0.0)
                else:
                    lang, score = [UNKNOWN] * (b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(c[a:b] for c in batch.columns[: len(keep)]), pa.array(lang, pa.string()), pa.array(score)],
                    [f"k{i}" for i in range(len(keep))] + ["lang_pred", "score"],
                )

    cols = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    types = [f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = df.select(*cols, F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, ", ".join([*types, "lang_pred string", "score double"])
    )
    return out.toDF(*keep, "lang_pred", "score")


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % parts == part, F.lit(False))
