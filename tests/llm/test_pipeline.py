"""The pipeline: each stage on its own input against brute force, and the whole on given data."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline as pipeline
from remap import session
from tests.llm.odd import empty_documents, jaccard, odd_documents, prose, shingles, words
from tests.llm.test_joins import lines_by_brute_force, overlaps
from tests.llm.test_packing import check_pieces, ids_of
from remap.llm.vector_packing import Limits
from remap.session import materialize

SF_DIR = "/root/testdata/sf0.001"


def test_stages_are_listed():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_each_stage_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF_DIR), name)
        after = docs.collect()
        if name == "packing":
            assert sum(r["length"] for r in after) == sum(len(ids_of(r["text"])) + 1 for r in before.values())
            continue
        assert docs.columns == pipeline.COLUMNS
        kept = {r["doc_id"]: r for r in after}
        assert len(kept) == len(after) and set(kept) <= set(before)
        if name == "language_id":
            assert {d for d, r in before.items() if any(c.isalpha() for c in r["text"])} == set(kept)
        if name == "line_dedup":
            want = lines_by_brute_force([(d, r["text"]) for d, r in before.items()], 2, 30)
            for d, r in before.items():
                lines = r["text"].split("\n")
                rest = [x for i, x in enumerate(lines) if (d, i) not in want or want[d, i][:2] == (d, i)]
                if rest != lines and not "".join(rest).strip():
                    assert d not in kept
                else:
                    assert kept[d]["text"] == "\n".join(rest) and kept[d]["n_chars"] == len(kept[d]["text"])
        if name == "jaccard_join":
            sets = {d: shingles(r["text"]) for d, r in before.items()}
            near = {d: [e for e in sets if e < d and (words(before[e]["text"]) == words(r["text"]) or jaccard(sets[d], sets[e]) >= 0.8)]
                    for d, r in before.items()}
            assert set(before) - set(kept) == {d for d, n in near.items() if n}
        if name == "decontamination":
            assert set(before) - set(kept) == {d for d, r in before.items() if overlaps(r["text"], items)[-1]}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_stages_on_unusual_rows(spark):
    docs = odd_documents(spark)
    for _, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF_DIR)
        assert got.columns == pipeline.COLUMNS and got.count() > 0
        assert stage(spark, empty_documents(spark), SF_DIR).count() == 0
    rows = docs.collect()
    assert pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= len(rows)


def test_near_copies_leave_one(spark):
    base = prose(1, 80)
    docs = [(i, base.replace(base.split()[40], f"w{i}"), "en", "s", 1) for i in range(6)] + [(9, prose(2, 80), "en", "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in pipeline.drop_near_copies(spark, df, SF_DIR).collect()} == {0, 9}


def test_packing_stage_is_lossless(spark):
    df = odd_documents(spark)
    rows = pipeline.pack_documents(df, pipeline.tokenizer_spec(pipeline.public_tokenizers.path("byte_bpe_50k.json")), with_ids=True).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in df.collect()], Limits())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_the_whole_run_leaves_only_its_result(spark):
    work = f"{session.work_dir(spark).removeprefix('file:')}/remap"
    before = set(os.listdir(work)) if os.path.isdir(work) else set()
    rows = pipeline.run(spark, SF_DIR)
    assert rows.count() > 0 and rows.columns[0] == "doc_id"
    assert {p.split("-")[:2][1] for p in set(os.listdir(work)) - before if p.startswith("stage")} == {"packing"}
    assert all(p.startswith("stage-packing") for p in set(os.listdir(work)) - before)
