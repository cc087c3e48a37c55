"""Line dedup, n-gram Jaccard join, decontamination, components: against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from remap.llm import decontamination, jaccard_join
from remap.llm.components import components
from remap.llm.decontamination import find_overlaps, merge, winnow
from remap.llm.jaccard_join import banding, join_near
from remap.llm.line_dedup import dedup_lines, offers, within_edits, without_repeats
from tests.llm.odd import empty_documents, jaccard, odd_documents, prose, shingles, words


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def altered(rng: random.Random, s: str, edits: int) -> str:
    t = list(s)
    for _ in range(edits):
        at = rng.randrange(len(t))
        t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
    return "".join(t)


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_edit_distance_and_offers(edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("abé ", k=rng.randint(8, 60)))
        pairs.append((a, altered(rng, a, rng.randint(0, edits + 2))))
    pairs = [(a, b) for a, b in pairs if len(b) > edits]
    near = [distance(a, b) <= edits for a, b in pairs]
    assert within_edits([a for a, _ in pairs], [b for _, b in pairs], edits).tolist() == near
    for (a, b), ok in zip(pairs, near):
        if ok and a != b:  # some probe of one meets a segment of the other
            keys = ([set(), set()], [set(), set()])
            for rows, found, own in offers([a, b], edits, edits + 1):
                for r, k in zip(rows.tolist(), found.tolist()):
                    keys[0][r].add(k)
                    if own:
                        keys[1][r].add(k)
            assert keys[0][0] & keys[1][1] or keys[0][1] & keys[1][0]


def lines_by_brute_force(docs: list[tuple], edits: int, least: int) -> dict:
    lines = [(d, i, s) for d, t in docs for i, s in enumerate((t or "").split("\n")) if len(s) >= least]
    texts = sorted({s for *_, s in lines})
    letters = {s: Counter(s) for s in texts}

    def near(s: str, t: str) -> bool:
        """An edit changes two letter counts at most, so most pairs need no full comparison."""
        if s == t or abs(len(s) - len(t)) > edits:
            return False
        odd = (letters[s] - letters[t]).total() + (letters[t] - letters[s]).total()
        return odd <= 2 * edits and distance(s, t) <= edits

    by_length: dict[int, list[str]] = {}
    for s in texts:
        by_length.setdefault(len(s), []).append(s)
    links = {s: {t for n in range(len(s) - edits, len(s) + edits + 1) for t in by_length.get(n, ()) if near(s, t)} for s in texts}
    out = {}
    for d, i, s in lines:
        group, todo = {s}, [s]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        first = min((x, k) for x, k, t in lines if t in group)
        out[d, i] = (*first, sum(t == s for *_, t in lines), len(links[s]))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    kinds = [prose(i, 8)[:60].ljust(32, "z") for i in range(12)]
    docs = []
    for d in range(30):
        own = [altered(rng, rng.choice(kinds), rng.choice([0, 0, 1, 2, 3])) for _ in range(4)]
        docs.append((d, "\n".join(own + ["short", ""])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = lines_by_brute_force(docs, 2, 30)
    got = dedup_lines(df).collect()
    assert {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_copies"], r["n_links"]) for r in got} == want
    assert all(r["is_first"] == ((r["doc_id"], r["line_no"]) == (r["class_doc"], r["class_line"])) for r in got)
    kept = {r["doc_id"]: r["text"] for r in without_repeats(df, dedup_lines(df)).collect()}
    for d, text in docs:
        rest = [s for i, s in enumerate(text.split("\n")) if (d, i) not in want or want[d, i][:2] == (d, i)]
        assert kept.get(d) == ("\n".join(rest) if "".join(rest).strip() else None)


def test_a_pair_that_meets_from_both_sides_is_one_link(spark):
    """Of equal length, with the middle shifted by one: each line's probe meets the other's segment."""
    base = "".join(random.Random(8).choices("abcdefghijklmnop ", k=60))
    docs = [(1, base[:5] + "Q" + base[5:]), (2, base[:55] + "Z" + base[55:])]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = lines_by_brute_force(docs, 2, 30)
    assert {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_copies"], r["n_links"]) for r in got} == want
    assert [n for *_, n in want.values()] == [1, 1]


def test_lines_of_unusual_rows(spark):
    docs = odd_documents(spark)
    found = dedup_lines(docs).collect()
    assert all(r["is_first"] == ((r["doc_id"], r["line_no"]) == (r["class_doc"], r["class_line"])) for r in found)
    shared = [r for r in found if r["doc_id"] == 11 and r["line_no"] == 1]
    assert (shared[0]["class_doc"], shared[0]["n_copies"]) == (10, 2)
    kept = without_repeats(docs, dedup_lines(docs))
    assert kept.columns == docs.columns
    assert {4, 5, 6, 8, 9, 10} <= {r["doc_id"] for r in kept.collect()}
    assert dedup_lines(empty_documents(spark)).count() == 0


def test_banding_meets_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.9), (0.95, 0.99)):
        bands, rows = banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall


def near_by_brute_force(docs: list[tuple]) -> dict:
    kinds: dict[tuple, list[int]] = {}
    for d, t in docs:
        if words(t) and d is not None:
            kinds.setdefault(tuple(words(t)), []).append(d)
    reps = {k: min(v) for k, v in kinds.items()}
    sets = {k: shingles(" ".join(k)) for k in kinds}
    links = {k: [j for j in kinds if j != k and jaccard(sets[k], sets[j]) >= 0.8] for k in kinds}
    out = {}
    for d, t in docs:
        k = tuple(words(t))
        if d is None:
            out[d] = (None, None, 1, 0)
        elif k not in kinds:
            out[d] = (d, d, 1, 0)
        else:
            group, todo = {k}, [k]
            while todo:
                new = set(links[todo.pop()]) - group
                group |= new
                todo += new
            out[d] = (min(reps[g] for g in group), reps[k], len(kinds[k]), len(links[k]))
    return out


def family(seed: int, n: int) -> list[str]:
    """Near copies of one text, many of them alike in all but a word or two."""
    rng, base = random.Random(seed), prose(seed, 120).split()
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(["alpha", "beta", "gamma", "delta"])
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("unit", [1 << 20, 600])
def test_near_copies_against_brute_force(spark, monkeypatch, unit):
    """Both with whole groups and with groups dealt into many blocks."""
    monkeypatch.setattr(jaccard_join, "UNIT_GRAMS", unit)
    texts = family(1, 60) + family(2, 15) + [prose(i, 50) for i in range(20)] + ["a b c", "A, b; c!", "a b", "", None, "...", "a b c d e"]
    docs = list(enumerate(texts))
    got = join_near(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == near_by_brute_force(docs)


def test_blocks_without_a_partner_count_no_pair_again(spark, monkeypatch):
    """Long near copies alone in their group, dealt into several blocks, some of which are empty."""
    monkeypatch.setattr(jaccard_join, "UNIT_GRAMS", 60)
    docs = list(enumerate(t for seed in range(20, 36) for t in family(seed, 2)))
    got = join_near(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == near_by_brute_force(docs)


def test_a_unit_of_two_blocks_pairs_across_only():
    sets, bands = [np.arange(9, dtype=np.uint64)] * 3, np.ones((3, 2), np.uint64)
    rep = np.arange(3)
    for blocks, lo, hi, want in (([0, 0, 0], 0, 1, [0, 0, 0]), ([1, 1, 1], 0, 1, [0, 0, 0]), ([0, 1, 0], 0, 1, [1, 2, 1]), ([1, 1, 1], 1, 1, [2, 2, 2])):
        assert jaccard_join.verify(rep, np.array(blocks), lo, hi, sets, bands, 0, 0.8)[0].tolist() == want


def test_near_copies_of_unusual_rows(spark):
    docs = odd_documents(spark)
    got = join_near(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["class_id"] == by_id[2]["class_id"] == by_id[3]["class_id"] == by_id[15]["class_id"] == 1
    assert by_id[3]["copy_of"] == 3 and by_id[3]["n_links"] == 1 and by_id[1]["n_copies"] == 4
    assert by_id[None]["class_id"] is None and by_id[None]["n_links"] == 0
    assert by_id[4]["class_id"] == 4 and by_id[5]["class_id"] == 5
    assert join_near(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 460)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    want = {n: find(n) for e in edges for n in e if e[0] != e[1]}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def overlaps(text: str | None, items: list[tuple]) -> tuple:
    w, hit, ids = words(text), set(), set()
    places: dict[tuple, list[int]] = {}
    for size in {min(10, len(words(t))) for _, t in items} - {0}:
        for j in range(len(w) - size + 1):
            places.setdefault(tuple(w[j : j + size]), []).append(j)
    for item, t in items:
        v = words(t)
        size = min(10, len(v))
        for i in range(len(v) - size + 1 if v else 0):
            for j in places.get(tuple(v[i : i + size]), ()):
                hit |= set(range(j, j + size))
                ids |= {str(item)} - {"None"}
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_overlaps_against_brute_force(spark, monkeypatch, block):
    """With the items in one block and in many."""
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", block)
    rng = random.Random(3)
    items = [(i, prose(50 + i, n)) for i, n in enumerate((30, 12, 10, 9, 4, 1, 40))]
    items += [(7, None), (8, "..."), (9, items[0][1]), (None, prose(80, 15)), (0, prose(81, 20)), (10, "the the the " * 8)]
    docs = []
    for d in range(60):
        w = prose(200 + d, 40).split()
        for _ in range(rng.randint(0, 2)):
            v = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(v) - 1))
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in v[a : a + rng.choice([8, 9, 10, 11, 25])]]
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "the " * 50), (102, "the " * 50), (None, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' AS items", "'c' AS found", "'c' AS id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'c' AS id")
    got = find_overlaps(df, bench, ["doc_id", "found", "items"]).collect()
    assert len(got) == len(docs) and all(r["found"] == "c" for r in got)
    want = sorted(str((d, *overlaps(t, items))) for d, t in docs)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])) for r in got) == want
    assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)


def test_overlaps_of_unusual_rows(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, prose(1, 60))], "item_id long, text string")
    got = {r["doc_id"]: r for r in find_overlaps(docs, bench, ["doc_id", "key"]).collect()}
    assert {d for d, r in got.items() if r["contaminated"]} == {1, 2, 3, 15, None}
    assert find_overlaps(docs, bench.where("false"), ["doc_id"]).where("contaminated").count() == 0
    assert find_overlaps(empty_documents(spark), bench, ["doc_id"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=6, max_size=60), st.integers(0, 20))
def test_winnowing_guarantee(hashes, cut):
    """A shared run of w hashes has a picked position in common."""
    h = np.array(hashes, dtype=np.uint64)
    other = np.concatenate((np.array([9, 8, 7][: cut % 4], np.uint64), h[cut : cut + 6], np.array([5], np.uint64)))
    if len(h[cut : cut + 6]) == 6:
        a = winnow(h, np.array([0, len(h) + 4]), 6, 5)
        b = winnow(other, np.array([0, len(other) + 4]), 6, 5)
        assert set(a.tolist()) & {int(x) - cut % 4 + cut for x in b}


def test_merged_spans():
    assert merge(np.array([[5, 9], [0, 3], [2, 4], [9, 12]])).tolist() == [[0, 4], [5, 12]]
