"""Toxicity: a linear-chain conditional random field over the words of a text.

Training needs labelled tokens, and only whole documents carry labels.  A token
of a toxic document is labelled toxic where one of its features (the word, or
its first bytes) occurs in toxic documents far more often than chance allows (a
likelihood-ratio test).  The field is then trained on the labelled tokens by
gradient ascent on its likelihood.

Scoring runs forward-backward over every token of every text.  The marginals
give the offending offsets (runs of tokens above one half) and, through a
calibrated logistic of the largest marginal and the number of toxic tokens, the
score of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remap.llm.texts import LOWER, buffers, mix64, slices, word_bounds, word_hashes
from remap.session import materialize

PREFIXES = (4, 5, 6)  # bytes
COLUMNS = 1 + len(PREFIXES)
SEGMENT = 512  # training sequences are runs of at most so many tokens
STEP_TOKENS = 1 << 18  # tokens whose lanes the driver holds at once
_SLICE = 4 << 20


def token_features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the features of each token; 0 where a token has none of a kind."""
    out = np.zeros((len(starts), COLUMNS), dtype=np.uint64)
    if not len(starts):
        return out
    out[:, 0] = word_hashes(low, starts, ends)
    lengths = ends - starts
    value = np.zeros(len(starts), dtype=np.uint64)
    for k in range(max(PREFIXES)):
        at = np.minimum(starts + k, len(low) - 1)
        value = value * np.uint64(0x100000001B3) + low[at].astype(np.uint64) + np.uint64(1)
        if k + 1 in PREFIXES:
            column = 1 + PREFIXES.index(k + 1)
            out[:, column] = np.where(lengths > k, mix64(value + np.uint64(k)), 0)
    return out


@dataclass
class Lanes:
    """Token sequences laid end to end in columns of like height, to be stepped together."""

    at: np.ndarray  # cell of each token, row by row
    shape: tuple[int, int]
    first: np.ndarray  # cells that start a sequence (unused cells too)
    last: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray, width: int = 256) -> Lanes:
        lengths = np.asarray(lengths, dtype=np.int64)
        height = max(int(lengths.max(initial=0)), -(-int(lengths.sum()) // width), 1)
        lane, top, lanes, tops = 0, 0, [], []
        for n in lengths.tolist():
            if top + n > height:
                lane, top = lane + 1, 0
            lanes.append(lane)
            tops.append(top)
            top += n
        shape = (height, lane + 1)
        first = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        at = (np.repeat(tops, lengths) + within).astype(np.int64) * shape[1] + np.repeat(lanes, lengths).astype(np.int64)
        starts, ends = np.ones(shape, bool), np.ones(shape, bool)
        starts.flat[at] = within == 0
        ends.flat[at] = within == np.repeat(lengths, lengths) - 1
        return cls(at, shape, starts, ends)


@dataclass
class ChainField:
    """Two-state chain.  ``moves`` are the weights of 0->1, 1->0 and 1->1; 0->0 weighs 0."""

    keys: np.ndarray  # known features, ascending
    theta: np.ndarray
    bias: float
    moves: np.ndarray
    blend: np.ndarray  # logistic of a document: constant, largest marginal, toxic tokens

    def rows(self, features: np.ndarray) -> np.ndarray:
        """Index of each feature; the number of known features where unknown."""
        if not len(self.keys):
            return np.zeros(features.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        return np.where(self.keys[at] == features, at, len(self.keys))

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        """``rows`` from :meth:`rows`, one row of feature numbers per token."""
        token, column = np.nonzero(rows < len(self.keys))
        return self.weigh(token, rows[token, column], len(rows))

    def weigh(self, token: np.ndarray, feature: np.ndarray, tokens: int) -> np.ndarray:
        """Emission of every token from its known features only."""
        return self.bias + np.bincount(token, self.theta[feature], minlength=tokens)

    def forward_backward(self, s: np.ndarray, lanes: Lanes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward odds, backward odds and exp of the emissions, each as a matrix of lanes."""
        t01, t10, t11 = np.exp(self.moves)
        e = np.ones(lanes.shape)
        e.flat[lanes.at] = np.exp(np.clip(s, -25, 25))
        f, b = np.empty(lanes.shape), np.empty(lanes.shape)
        past = np.ones(lanes.shape[1])
        for i in range(lanes.shape[0]):
            moved = (t01 + past * t11) / (1 + past * t10)
            past = f[i] = e[i] * np.where(lanes.first[i], 1.0, moved)
        ahead = np.ones(lanes.shape[1])
        for i in range(lanes.shape[0] - 1, -1, -1):
            b[i] = np.where(lanes.last[i], 1.0, (t10 + ahead * t11) / (1 + ahead * t01))
            ahead = e[i] * b[i]
        return f, b, e

    def marginals(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of the toxic state, per token."""
        return self.emission_marginals(self.emissions(self.rows(features)), lengths)

    def emission_marginals(self, s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.zeros(0)
        lanes = Lanes.of(lengths)
        f, b, _ = self.forward_backward(s, lanes)
        odds = (f * b).flat[lanes.at]
        return odds / (1 + odds)

    def scores(self, p: np.ndarray, at_word: np.ndarray) -> np.ndarray:
        """Score per document from its token marginals."""
        return _sigmoid(_summary(p, at_word) @ self.blend)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _summary(p: np.ndarray, at_word: np.ndarray) -> np.ndarray:
    """Constant, largest marginal, log of one plus the number of toxic tokens."""
    out = np.zeros((len(at_word) - 1, 3))
    out[:, 0] = 1
    some = np.flatnonzero(np.diff(at_word))
    if len(some):
        out[some, 1] = np.maximum.reduceat(p, at_word[some])
        out[some, 2] = np.log1p(np.add.reduceat(p >= 0.5, at_word[some]))
    return out


def _sparse(features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features, and token and number of each occurrence.

    A feature met less than three times tells nothing; such are dropped by a count of
    hash buckets (which is never too low) before the sort, to keep the driver's memory low.
    """
    flat = features.ravel()
    bucket = (flat >> np.uint64(42)).astype(np.int32)
    often = np.bincount(bucket, minlength=1 << 22) >= 3
    at = np.flatnonzero(often[bucket] & (flat != 0))
    del bucket
    keys, number = np.unique(flat[at], return_inverse=True)
    return keys, (at // COLUMNS).astype(np.int32), number.astype(np.int32)


def _count(df: DataFrame) -> DataFrame:
    """(feature, n, hits): documents and toxic documents with each feature, over all rows of (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            toxic = batch.column(1).to_numpy()
            for a, z in slices(offsets, _SLICE):
                low = LOWER[data[offsets[a] : offsets[z]]]
                starts, ends, at_word = word_bounds(low, offsets[a : z + 1] - offsets[a])
                flat = token_features(low, starts, ends).ravel()
                doc = np.repeat(np.arange(a, z), np.diff(at_word) * COLUMNS)
                order = np.argsort(flat, kind="stable")  # a feature's documents stay in order
                flat, doc = flat[order], doc[order]
                once = flat != 0
                once[1:] &= (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
                flat, hit = flat[once], toxic[doc[once]]
                keys, first = np.unique(flat, return_index=True)
                n = np.diff(np.append(first, len(flat)))
                hits = np.diff(np.concatenate(([0], np.cumsum(hit)))[np.append(first, len(flat))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(hits.astype(np.int64))],
                    ["feature", "n", "hits"],
                )

    counts = df.select("text", "toxic").mapInArrow(run, "feature long, n long, hits long")
    return counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def _labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (sample_id, text) with the label of their id, an id labelled both ways as toxic.

    Both sides grow with the corpus, so neither is ever broadcast.
    """
    labels = known.groupBy(F.col("id").alias("sample_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.join(labels.hint("merge"), "sample_id")


def _telling(total: int, positive: int) -> Column:
    """Whether a feature of ``_count`` goes with toxicity: past the likelihood-ratio test, and by a margin.

    With enough rows any difference passes the test, so the toxic share of the documents
    with the feature must also be twice the share of all (or halfway to 1, where less).
    """
    n, hits, share = F.col("n"), F.col("hits"), positive / total
    ratio = F.lit(0.0)
    for seen, size, part in (
        (hits, n, share), (n - hits, n, 1 - share),
        (positive - hits, total - n, share), (total - n - (positive - hits), total - n, 1 - share),
    ):
        ratio += F.when(seen > 0, 2 * seen * F.log(seen / (size * part))).otherwise(0.0)
    return (ratio > 25) & (hits >= n * min(2 * share, (1 + share) / 2))


def _longs(df: DataFrame) -> np.ndarray:
    """The features of ``df``, ascending."""
    return np.sort(df.select("feature").toPandas()["feature"].to_numpy(dtype=np.int64).view(np.uint64))


def _collect(df: DataFrame, model: ChainField) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token and number of each known feature, tokens per document and label of the sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for a, z in slices(offsets, _SLICE):
                low = LOWER[data[offsets[a] : offsets[z]]]
                starts, ends, at_word = word_bounds(low, offsets[a : z + 1] - offsets[a])
                found = token_features(low, starts, ends)
                rows = model.rows(found)
                sparse = []
                for i, j in zip(at_word, at_word[1:]):
                    token, column = np.nonzero(rows[i:j] < len(model.keys))
                    sparse.append((token.astype(np.int32).tobytes(), rows[i:j][token, column].astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([found[i : min(j, i + 64)].tobytes() for i, j in zip(at_word, at_word[1:])], pa.binary()),
                     pa.array([t for t, _ in sparse], pa.binary()), pa.array([f for _, f in sparse], pa.binary()),
                     pa.array(np.diff(at_word).astype(np.int64)), batch.column(1)[a:z]],
                    ["head", "token", "feature", "n", "toxic"],
                )

    schema = "head binary, token binary, feature binary, n long, toxic int"
    # One order whatever Spark returned; documents that agree so far are as good as equal.
    table = df.select("text", F.col("toxic").cast("int")).mapInArrow(run, schema).toPandas().sort_values("head", kind="stable")
    lengths, toxic = table["n"].to_numpy(dtype=np.int64), table["toxic"].to_numpy(dtype=np.int64)
    token = [np.frombuffer(t, np.int32) + np.int32(at) for t, at in zip(table["token"], np.cumsum(lengths) - lengths)]
    feature = [np.frombuffer(f, np.int32) for f in table["feature"]]
    none = [np.zeros(0, np.int32)]
    return np.concatenate(token + none), np.concatenate(feature + none), lengths, toxic


def train(
    documents: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
    toxic_rows: int = 1500, clean_rows: int = 3000, rounds: int = 40,
) -> ChainField:
    """Fit the field on at most ``toxic_rows`` and ``clean_rows`` labelled documents.

    Which features tell of toxicity is counted over all labelled documents; only those
    and the 1000 commonest reach the driver.  The weight of a telling feature is its own,
    learned from the sample, and one that all share, so one that the sample lacks counts too.

    ``labels`` has ``id_col`` and ``toxic`` (0 or 1; rows with a null count as
    unlabelled, an id labelled both ways as toxic).  The documents of the sample are
    those with the smallest hash of their id.  Without a toxic and a clean document
    every score is 0.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    by_hash = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    chosen: dict = {}
    for value, bound in ((0, clean_rows), (1, toxic_rows)):
        chosen |= {r[0]: value for r in known.where(F.col("toxic") == value).select("id").orderBy(*by_hash).limit(bound).collect()}
    if len(set(chosen.values())) < 2:
        return ChainField(np.zeros(0, np.uint64), np.zeros(0), -20.0, np.zeros(3), np.array([-40.0, 0, 0]))
    spark = documents.sparkSession
    id_type = documents.schema[id_col].dataType.simpleString()
    # The broadcast side has at most toxic_rows + clean_rows rows.
    ids = spark.createDataFrame(list(chosen.items()), f"sample_id {id_type}, toxic int")
    rows = documents.select(F.col(f"`{id_col}`").alias("sample_id"), F.col(f"`{text_col}`").alias("text"))
    untrained = ChainField(np.zeros(0, np.uint64), np.zeros(0), -20.0, np.zeros(3), np.array([-40.0, 0, 0]))
    counted = _labelled(rows, known)
    total, positive = counted.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < total:
        return untrained
    counts = materialize(_count(counted), "features")
    telling_keys = _longs(counts.where(_telling(total, positive)))
    common = _longs(counts.where("n >= 5").orderBy(F.desc("n"), "feature").limit(1000))
    keys = np.union1d(telling_keys, common)
    model = ChainField(keys, np.zeros(len(keys)), -3.0, np.array([-1.0, 0.0, 0.0]), np.zeros(3))
    token, feature, lengths, toxic = _collect(rows.join(F.broadcast(ids), "sample_id"), model)
    if len(set(toxic.tolist())) < 2:
        return untrained

    telling = np.isin(keys, telling_keys)
    y = np.zeros(int(lengths.sum()), bool)
    y[token[telling[feature]]] = True
    y &= np.repeat(toxic == 1, lengths)
    _fit_chain(model, token, feature, y, lengths, rounds, telling)
    _fit_blend(model, token, feature, lengths, toxic, known)
    kept = np.abs(model.theta) > 0.05
    model.keys, model.theta = model.keys[kept], model.theta[kept]
    return model


def _steps(lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs of sequences of at most STEP_TOKENS tokens, or of one: first and end sequence, first and end token."""
    bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    for i, j in slices(bounds, STEP_TOKENS):
        yield i, j, int(bounds[i]), int(bounds[j])


def _fit_chain(
    model: ChainField, token: np.ndarray, feature: np.ndarray, y: np.ndarray, lengths: np.ndarray, rounds: int,
    telling: np.ndarray | None = None,
) -> None:
    """Gradient ascent (Adam) on the likelihood of the token labels ``y``.

    ``token`` ascends.  The features of the mask ``telling`` share a weight beside their
    own, added to theirs at the end.  The gradient is a sum over sequences, taken a step
    of them at a time: the driver's memory is the known features and one step's lanes.
    """
    parts = np.concatenate([np.zeros(0, np.int64)] + [
        np.append(np.full(n // SEGMENT, SEGMENT), [n % SEGMENT] * (n % SEGMENT > 0)).astype(np.int64) for n in lengths.tolist()
    ])
    steps, seen = [], np.zeros(3)
    for i, j, a, z in _steps(parts):
        lanes = Lanes.of(parts[i:j], width=max(256, (z - a) // SEGMENT))
        inner = np.ones(z - a, bool)  # tokens with a next token in their sequence
        inner[np.cumsum(parts[i:j]) - 1] = False
        steps.append((a, z, *np.searchsorted(token, (a, z)).tolist(), lanes, inner))
        here, ahead = np.flatnonzero(inner), y[a:z].astype(float)
        here, ahead = ahead[here], ahead[here + 1]
        seen += [((1 - here) * ahead).sum(), (here * (1 - ahead)).sum(), (here * ahead).sum()]
    if telling is None:
        telling = np.zeros(len(model.theta), bool)
    size = len(model.theta)
    w = np.concatenate((model.theta, [0.0, model.bias], model.moves))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        model.theta, model.bias, model.moves = w[:size] + w[size] * telling, w[size + 1], w[size + 2 :]
        t01, t10, t11 = np.exp(model.moves)
        slope, bias, moved = np.zeros(size), 0.0, np.zeros(3)
        for a, z, lo, hi, lanes, inner in steps:
            at, known = token[lo:hi] - a, feature[lo:hi]
            f, b, e = model.forward_backward(model.weigh(at, known, z - a), lanes)
            f, b, e = (x.flat[lanes.at] for x in (f, b, e))
            off = y[a:z] - f * b / (1 + f * b)
            slope += np.bincount(known, off[at], minlength=size)
            bias += off.sum()
            inside = np.flatnonzero(inner)
            here, ahead = f[inside], (e * b)[inside + 1]
            weight = t01 * ahead, t10 * here, t11 * here * ahead
            total = 1 + weight[0] + weight[1] + weight[2]
            moved += [float((x / total).sum()) for x in weight]
        g = np.concatenate((slope, [slope[telling].sum(), bias], seen - moved)) - 0.02 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.theta, model.bias, model.moves = w[:size] + w[size] * telling, float(w[size + 1]), w[size + 2 :]


def _fit_blend(
    model: ChainField, token: np.ndarray, feature: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, known: DataFrame
) -> None:
    """Logistic of the document summary by Newton steps, weighted to the label shares of all rows."""
    shares = {r[0]: r[1] for r in known.groupBy(F.col("toxic").cast("int")).count().collect()}
    x = np.zeros((len(lengths), 3))
    for i, j, a, z in _steps(lengths):
        lo, hi = np.searchsorted(token, (a, z))
        p = model.emission_marginals(model.weigh(token[lo:hi] - a, feature[lo:hi], z - a), lengths[i:j])
        x[i:j] = _summary(p, np.concatenate(([0], np.cumsum(lengths[i:j]))))
    weight = np.where(toxic == 1, shares[1] / max(1, (toxic == 1).sum()), shares[0] / max(1, (toxic == 0).sum()))
    weight = weight / weight.mean()
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(30):
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (toxic - p)) - ridge @ w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.clip(np.linalg.solve(bend, slope), -4, 4)
    model.blend = w


def score(df: DataFrame, model: ChainField, text_col: str, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The columns ``keep`` with score, predicted (1 from ``threshold`` on) and spans.

    ``spans`` lists the offending runs as character offsets (end exclusive) with their
    largest marginal.  A null or empty text has the score of a text without tokens and
    no span.  Equal texts have equal scores.  A column of ``keep`` with an output's
    name is replaced.
    """
    keep = [c for c in keep if c not in ("score", "predicted", "spans")]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(len(keep)))
            for a, z in slices(offsets, _SLICE):
                raw = data[offsets[a] : offsets[z]]
                low = LOWER[raw]
                starts, ends, at_word = word_bounds(low, offsets[a : z + 1] - offsets[a])
                p = model.marginals(token_features(low, starts, ends), np.diff(at_word))
                found = model.scores(p, at_word)
                spans = _spans(p, at_word, starts, ends, raw, offsets[a : z + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [*(c[a:z] for c in batch.columns[: len(keep)]), pa.array(found),
                     pa.array((found >= threshold).astype(np.int32)), pa.array(spans, span)],
                    [f"k{i}" for i in range(len(keep))] + ["score", "predicted", "spans"],
                )

    cols = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    types = [f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    schema = ", ".join([
        *types, "score double", "predicted int", "spans array<struct<start:int,end:int,marginal:double>>",
    ])
    out = df.select(*cols, F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
    return out.toDF(*keep, "score", "predicted", "spans")


def _spans(p, at_word, starts, ends, raw, offsets) -> list[list[dict]]:
    """Runs of tokens above one half, per document, as character offsets."""
    out: list[list[dict]] = [[] for _ in range(len(at_word) - 1)]
    toxic = np.flatnonzero(p >= 0.5)
    if not len(toxic):
        return out
    doc = np.searchsorted(at_word, toxic, side="right") - 1
    fresh = np.ones(len(toxic), bool)
    fresh[1:] = (np.diff(toxic) > 1) | (np.diff(doc) > 0)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(toxic)) - 1
    peak = np.maximum.reduceat(p[toxic], first)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    base = chars[offsets[doc[first]]]
    begin, end = chars[starts[toxic[first]]] - base, chars[ends[toxic[last]]] - base
    for d, s, e, m in zip(doc[first], begin, end, peak):
        out[d].append({"start": int(s), "end": int(e), "marginal": float(m)})
    return out
