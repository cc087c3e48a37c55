"""Tokens, packing, matrices and digests: exact round trips."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from remap.llm import digest
from remap.llm.token_matrix import Layout, best_fit_decreasing, pack_matrix, write_matrix
from remap.llm.tokens import Encoder, tokenizer_spec
from remap.llm.vector_packing import Limits, pack_documents, pack_examples, pack_whole
from tests.llm.odd import empty_documents, odd_documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = tokenizer_spec(PATH)
PLAIN = Tokenizer.from_str(SPEC)


def ids_of(text: str | None) -> list[int]:
    return PLAIN.encode(text or "", add_special_tokens=False).ids


ENCODER = Encoder(SPEC)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab's \n\t é½Ⅷ2_.,-🙂<|>")), max_size=40))
def test_chunks_give_the_ids_of_the_whole_text(text):
    assert ENCODER.encode([text, "x <|endoftext|>" + text])[0].tolist() == ids_of(text)
    assert ENCODER.encode(["x <|endoftext|>" + text])[0].tolist() == ids_of("x <|endoftext|>" + text)


@pytest.mark.parametrize("bound", [20, 60, 200])
def test_cache_forgets_beyond_its_bound(bound):
    own = Encoder(SPEC)
    own.bound = bound
    for i in range(30):
        text = prose(i % 7, 30) + ", " + prose(i, 20) + "."
        assert own.encode([text, prose(3, 9)])[0].tolist() == ids_of(text)
        assert len(own.sizes) < bound + 250


def check_pieces(rows, docs: list[tuple], limits: Limits, end: int = 0):
    """Every id once and in order, offsets without a gap, no limit passed, no padding."""
    want = sorted(tuple(ids_of(t) + [end]) for _, t in docs)
    parts: dict = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    got = []
    for (_, n), own in parts.items():
        own.sort(key=lambda r: (r["start"], r["sequence_id"], r["offset"]))
        while own:  # repeated rows leave several sets of pieces
            at, ids = 0, []
            while at < n:
                r = next(x for x in own if x["start"] == at)
                own.remove(r)
                ids += np.frombuffer(r["ids"], "<u4").tolist()
                at += r["length"]
            got.append(tuple(ids))
    assert sorted(got) == want
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        total = sum(r["length"] for r in own)
        assert total <= limits.tokens and len(own) <= limits.segments
        assert sum(r["length"] - (r["start"] == 0) for r in own) <= limits.loss_tokens
        assert total == limits.tokens or total & (total - 1) == 0


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 50)])
def test_packed_documents(spark, limits):
    docs = [(i, prose(i, n)) for i, n in enumerate([1, 400, 3, 90, 7, 2500, 20, 20, 20])] + [(20, None), (21, ""), (22, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = pack_documents(df, SPEC, limits=limits, with_ids=True).collect()
    check_pieces(rows, docs, limits)


def test_packing_of_unusual_rows(spark):
    df = odd_documents(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    check_pieces(pack_documents(df, SPEC, with_ids=True).collect(), docs, Limits())
    assert pack_documents(empty_documents(spark), SPEC).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 120), st.integers(0, 3), st.integers(0, 60)), max_size=60))
def test_whole_items_within_all_limits(items):
    demand, limits = np.array(items, dtype=np.int64).reshape(-1, 3), np.array([100, 4, 50])
    bins = pack_whole(demand, limits)
    assert sorted(i for b in bins for i in b) == list(range(len(items)))
    for b in bins:
        assert (demand[b].sum(axis=0) <= limits).all() or len(b) == 1


def test_packed_examples(spark):
    rows = [(i, 10 * (i % 9), 1, 5, "c") for i in range(50)] + [(None, None, None, None, "c"), (60, 500, 1, 1, "c"), (60, 500, 1, 1, "c")]
    df = spark.createDataFrame(rows, "ex long, tokens int, segments int, loss int, bin_id string")
    got = pack_examples(df, "ex", ["tokens", "segments", "loss"], [100, 4, 20]).collect()
    assert len(got) == len(rows) and [r["oversize"] for r in got if r["ex"] == 60] == [True, True]
    assert pack_examples(df.where("false"), "ex", ["tokens"], [9]).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_decreasing(sizes):
    got = best_fit_decreasing(sizes, 50)
    rooms, want = [], []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [r for r in rooms if r >= sizes[i]]
        want.append(min(fits) if fits else None)
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 50) - sizes[i])
    assert sorted(i for r in got for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 50 for r in got)
    assert len(got) == sum(w is None for w in want)  # as many rows as a plain search for the best fit


def check_matrix(rows, docs: list[tuple], layout: Layout):
    parts: dict = {}
    for r in rows:
        ids, positions = (np.frombuffer(r[c], layout.dtype) for c in ("ids", "positions"))
        cu = r["cu_seqlens"]
        assert len(ids) == len(positions) == layout.length and cu[0] == 0 and cu[-1] == r["n_tokens"]
        assert (ids[cu[-1] :] == layout.pad_id).all() and (positions[cu[-1] :] == 0).all()
        for d, start, n, a, z in zip(r["doc_ids"], r["doc_starts"], r["doc_tokens"], cu, cu[1:]):
            assert (positions[a:z] == np.arange(z - a)).all() and z > a
            parts.setdefault((d, n), []).append((start, ids[a:z].tolist()))
    got = []
    for (_, n), own in parts.items():
        while own:
            at, ids = 0, []
            while at < n:
                part = next(x for x in own if x[0] == at)
                own.remove(part)
                ids += part[1]
                at += len(part[1])
            got.append(tuple(ids))
    assert sorted(got) == sorted(tuple(ids_of(t) + [layout.end_id]) for _, t in docs)


def test_matrix_round_trip(spark, tmp_path):
    df = odd_documents(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    for layout in (Layout(), Layout(length=32)):
        matrix = pack_matrix(df, SPEC, layout=layout)
        path = str(tmp_path / str(layout.length))
        write_matrix(matrix, path)
        rows = spark.read.parquet(path).collect()
        assert len({r["row_id"] for r in rows}) == len(rows)
        check_matrix(rows, docs, layout)
    assert pack_matrix(empty_documents(spark), SPEC).count() == 0


def test_entropy_of_every_window():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 5, 300).astype(np.uint8)
    w = digest.WIDTH
    for i, got in enumerate(digest.entropy_bins(data)):
        n = np.bincount(data[i : i + w])
        p = n[n > 0] / w
        assert abs(got - -(p * np.log2(p)).sum() / np.log2(w) * 255) < 1.01


def test_a_digest_depends_on_its_text_only():
    ranks = np.random.default_rng(2).permutation(256)
    texts = [prose(i, 40) for i in range(6)] + ["", "a", "aaaa" * 50, "é" * 9, prose(9, 3000)]
    together = digest.digests(texts, ranks)
    for text, found in zip(texts, together):
        assert (digest.digests([text], ranks)[0] == found).all()
        assert (digest.from_text(digest.as_text(found)) == found).all() and digest.likeness(found, found) == 1
    assert len(together[-1]) > 1 and digest.likeness(together[0], together[1]) < 0.1
    assert digest.likeness(together[6], together[0]) == 0


def test_next_and_edited_texts(spark):
    docs = [(i * 3, prose(i, 10 + i)) for i in range(40)] + [(500, None), (501, "abc"), (502, ""), (503, prose(1, 60)), (504, prose(1, 60))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).selectExpr("*", "'c' AS bucket", "'c' AS ahead")
    got = {r["doc_id"]: r for r in digest.compare_with_next(df).collect()}
    assert len(got) == len(docs)
    for (i, a), (_, b) in zip(docs, docs[1:] + docs[:1]):
        a, b = a or "", b or ""
        part = len(a) // 4
        text = a[: len(a) - part] + b[:part]
        r = got[i]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert got[503]["near_next"] == 1 and got[503]["fingerprint"] == got[504]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 60]
    assert np.mean([r["near_edited"] for r in long]) > 0.5


def test_digests_of_unusual_rows(spark):
    df = odd_documents(spark)
    got = digest.compare_with_next(df).collect()
    assert len(got) == df.count()
    by_id = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by_id[1] == by_id[2] == by_id[15] == by_id[None] and by_id[4] == by_id[5] == ""
    assert digest.fingerprint(df).count() == df.count()
    assert digest.compare_with_next(empty_documents(spark)).count() == 0
    one = digest.compare_with_next(df.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0
    assert digest.compare_with_next(df.where("doc_id IS NULL")).count() == 1
