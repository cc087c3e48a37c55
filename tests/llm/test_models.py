"""Toxicity and language ID: exact inference, held-out quality, unusual rows."""

from __future__ import annotations

import itertools
import os
import tracemalloc

import numpy as np
import pytest

from remap.llm import language, toxicity
from remap.llm.queries import op1_toxicity, op3_language_id
from tests.llm.odd import empty_documents, odd_documents, prose

SF_DIR = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(1, 1 << 60, 6).astype(np.uint64))
    model = toxicity.ChainField(keys, rng.normal(size=6), -0.3, np.array([-0.7, 0.4, 0.9]), np.zeros(3))
    lengths = np.array([3, 0, 1, 6])
    features = np.zeros((lengths.sum(), toxicity.COLUMNS), dtype=np.uint64)
    features[:, 0] = rng.choice(np.append(keys, 5), len(features))
    got = model.marginals(features, lengths)
    s, at = model.emissions(model.rows(features)), 0
    move = np.array([[0, model.moves[0]], [model.moves[1], model.moves[2]]])
    for n in lengths:
        total, on = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(s[at + i] * y[i] for i in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total += weight
            on += weight * np.array(y)
        assert np.allclose(got[at : at + n], on / total)
        at += n


def test_gradient_fits_labels():
    """Training moves the marginals of telling tokens up and leaves the rest low."""
    keys = np.array([7, 9], dtype=np.uint64)
    model = toxicity.ChainField(keys, np.zeros(2), -3.0, np.array([-1.0, 0, 0]), np.zeros(3))
    features = np.zeros((400, toxicity.COLUMNS), dtype=np.uint64)
    features[::10, 0], features[5::10, 0] = 7, 9
    keys, token, number = toxicity._sparse(features)
    assert keys.tolist() == [7, 9] and len(token) == 80
    lengths = np.full(20, 20)
    toxicity._fit_chain(model, token, number, (features[:, 0] == 7).astype(float), lengths, 60)
    p = model.marginals(features, lengths)
    assert p[::10].min() > 0.9 and p[features[:, 0] != 7].max() < 0.1


def test_training_holds_one_step_of_the_sample():
    """The driver's memory beyond the known features does not grow with the sample."""
    rng = np.random.default_rng(2)
    telling = np.arange(50) < 3
    peaks, fitted = [], []
    for docs in (1000, 4000):
        lengths = np.full(docs, 400)
        token = np.arange(0, docs * 400, 4, dtype=np.int32)
        feature = rng.integers(0, 50, len(token)).astype(np.int32)
        y = np.zeros(docs * 400, bool)
        y[token[telling[feature]]] = True
        model = toxicity.ChainField(np.arange(50, dtype=np.uint64), np.zeros(50), -3.0, np.array([-1.0, 0, 0]), np.zeros(3))
        tracemalloc.start()
        toxicity._fit_chain(model, token, feature, y, lengths, 3, telling)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        fitted.append(model.theta)
    assert peaks[1] < peaks[0] + 20 * 1_200_000  # bytes for each more token: its lane cell, not its floats
    assert all(t[telling].min() > t[~telling].max() for t in fitted)


def test_steps_leave_training_as_it_is(monkeypatch):
    rng = np.random.default_rng(3)
    lengths = np.array([700, 0, 3, 512, 1300, 1])
    token = np.sort(rng.integers(0, lengths.sum(), 3000)).astype(np.int32)
    feature = rng.integers(0, 40, 3000).astype(np.int32)
    y = rng.random(int(lengths.sum())) < 0.2
    fitted = []
    for tokens in (1 << 18, 600):
        monkeypatch.setattr(toxicity, "STEP_TOKENS", tokens)
        model = toxicity.ChainField(np.arange(40, dtype=np.uint64), np.zeros(40), -3.0, np.array([-1.0, 0, 0]), np.zeros(3))
        toxicity._fit_chain(model, token, feature, y, lengths, 20, np.arange(40) % 9 == 0)
        fitted.append(np.concatenate((model.theta, [model.bias], model.moves)))
    assert np.allclose(*fitted, rtol=0, atol=1e-9)


def test_labels_are_never_broadcast(spark):
    """Else the texts are shuffled from some size of the labels on, and the disk grows with a jump."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "sample_id long, text string")
    known = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (77, 1)], "id long, toxic int")
    joined = toxicity._labelled(rows, known)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r["sample_id"], r["toxic"]) for r in joined.collect()) == [(1, 0), (2, 1)]


def test_spans_are_character_offsets():
    text = "Ünd so ïdiot ïdiot. Fin"
    low = toxicity.LOWER[np.frombuffer(text.encode(), np.uint8)]
    offsets = np.array([0, len(low)])
    starts, ends, at = toxicity.word_bounds(low, offsets)
    spans = toxicity._spans(np.array([0.1, 0.2, 0.9, 0.8, 0.1]), at, starts, ends, np.frombuffer(text.encode(), np.uint8), offsets)
    assert [text[s["start"] : s["end"]] for s in spans[0]] == ["ïdiot ïdiot"]


@data
def test_toxicity_on_held_out_rows(spark):
    found = op1_toxicity(spark, SF_DIR).toPandas()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id").query("held_out")
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    assert both[both.toxic == 1].predicted.mean() > 0.6 and both[both.toxic == 0].predicted.mean() < 0.02


def test_toxicity_of_unusual_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0), (2, 0), (10, 1), (11, 1), (11, 0), (None, 1), (99, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model, "text", ["doc_id", "score", "key"]).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["key"] == "clash" for r in found)
    by_id = {r["doc_id"]: r["score"] for r in found}
    assert by_id[4] == by_id[5] == by_id[6] and by_id[1] == by_id[2] == by_id[15]
    empty = empty_documents(spark)
    assert toxicity.score(empty, toxicity.train(empty, labels.where("false")), "text", ["doc_id"]).count() == 0


def test_a_word_that_the_sample_hardly_meets_is_learned(spark):
    """Counts behind the token labels cover all labelled rows, not the sample alone."""
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 10 == 0
        bad = ("zorgblat" if i % 130 == 0 else "frobnixes") if toxic else ""
        docs.append((i, f"{prose(i, 20)} {bad} {prose(5000 + i, 20)}"))
        labels.append((i, int(toxic)))
    docs += [(9000, f"{prose(9000, 15)} zorgblat {prose(9001, 15)}"), (9001, prose(9002, 30))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"), toxic_rows=30, clean_rows=60)
    found = {r["doc_id"]: r for r in toxicity.score(df.where("doc_id >= 9000"), model, "text", ["doc_id"]).collect()}
    (span,) = found[9000]["spans"]
    assert docs[1500][1][span["start"] : span["end"]] == "zorgblat" and found[9000]["predicted"] == 1
    assert not found[9001]["spans"] and found[9001]["predicted"] == 0


@data
def test_language_on_held_out_rows(spark):
    found = op3_language_id(spark, SF_DIR).toPandas()
    langs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(langs, on="doc_id").query("held_out")
    assert (both.lang == both.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()


def test_language_of_unusual_rows(spark):
    docs = odd_documents(spark)
    model = language.train(docs)
    found = {r["doc_id"]: r for r in language.identify(docs, model, "text", ["doc_id", "score", "key"]).collect()}
    assert set(model.languages) == {"en", "fr", "de", "es"}
    for i in (4, 5, 6, 7):
        assert found[i]["lang_pred"] == "und" and found[i]["score"] == 0
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == found[15]["lang_pred"] in model.languages
    nothing = language.train(docs.where("false"))
    assert {r["lang_pred"] for r in language.identify(docs, nothing, "text", ["doc_id"]).collect()} == {"und"}
    assert language.identify(docs.where("false"), model, "text", ["doc_id"]).count() == 0


def test_a_text_is_judged_by_itself():
    """Probabilities do not depend on the other texts of the batch."""
    rng = np.random.default_rng(1)
    model = language.LanguageModel(["a", "b"], rng.normal(size=(language.BUCKETS, 2)), np.zeros(2))
    texts = [prose(i, 30) for i in range(5)] + ["", "é", "ß 1 x"]
    together = model.probabilities(language.Grams.of(texts))
    alone = np.concatenate([model.probabilities(language.Grams.of([t])) for t in texts])
    assert (together == alone).all()


def test_document_frequencies(spark):
    df = spark.createDataFrame([("ab",), ("ab ab",), (None,), ("c",)], "text string")
    found = language.document_frequencies(df, "text")
    grams = language.Grams.of(["ab"])
    assert found[-1] == 4 and all(found[b] >= 2 for b in grams.counts(0)[0])
