"""Collocations against a plain count of every phrase, with small limits so the bound cuts."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from remap.llm.collocations import mine_collocations


def brute(rows, top, least, longest=5):
    out = []
    for lang in sorted({(l or "und") for l, _ in rows}):
        f, n = Counter(), 0
        for l, text in rows:
            if (l or "und") != lang:
                continue
            low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
                ws = re.findall(r"[^\x20\x09]+", piece)
                n += len(ws)
                for k in range(1, longest + 1):
                    for i in range(len(ws) - k + 1):
                        f[tuple(ws[i : i + k])] += 1
        cands = [p for p, c in f.items() if 2 <= len(p) and c >= least]
        rows_ = []
        for p in cands:
            a = f[p]
            s, j = min((1000 * a * n // (f[p[:j]] * f[p[j:]]), j) for j in range(1, len(p)))
            longer = any(len(q) > len(p) and f[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q)))
                         for q in cands)
            if not longer:
                rows_.append((s, a, " ".join(p), f[p[:j]], f[p[j:]]))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, ph, a, l, r, n, s) for i, (s, a, ph, l, r) in enumerate(rows_[:top])]
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["the", "of", "new", "york", "big", "Red", "car", "é", "ß", "x\ty", "un", "deux"]
    rows = []
    for d in range(120):
        words = [rnd.choice(vocab[: rnd.randint(3, len(vocab))]) for _ in range(rnd.randint(0, 40))]
        if d % 7 == 0:
            words += ["new", "york", "city"] * 3
        text = " ".join(w + rnd.choice(["", "", "", ",", ".", "\n", "  "]) for w in words)
        rows.append((rnd.choice(["en", "fr", None]), text if d % 11 else None))
    return rows + rows[:5]  # repeated rows count twice


@pytest.mark.parametrize("top,least,frontier", [(5, 3, 1), (20, 2, 1), (3, 10, 4)])
def test_equals_plain_counts(spark, top, least, frontier):
    rows = corpus(top + least)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = mine_collocations(docs, top=top, least=least, frontier=frontier).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, top, least))
    assert got


def test_ties_and_long_text(spark):
    text = " ".join(["alpha beta gamma"] * 3000 + ["delta epsilon"] * 3000)  # 15,000 words, one piece
    rows = [("en", text), ("en", None), (None, "")]
    got = mine_collocations(spark.createDataFrame(rows, "lang string, text string"), top=4, least=100).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 100))


def test_empty(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert mine_collocations(empty).count() == 0


def test_without_broadcasts_the_same(spark, monkeypatch):
    import remap.llm.collocations as colloc

    monkeypatch.setattr(colloc, "BROADCAST_BYTES", 0)  # words measure larger: text path, no pruning
    rows = corpus(9)
    got = mine_collocations(spark.createDataFrame(rows, "lang string, text string"), top=5, least=3, frontier=1)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 5, 3))


@pytest.mark.parametrize("limit", [600, 1200, 2000, 6000])
def test_phrases_beyond_the_broadcast_limit_the_same(spark, monkeypatch, limit):
    import remap.llm.collocations as colloc

    monkeypatch.setattr(colloc, "BROADCAST_BYTES", limit)  # words fit, keys of pairs, triples .. do not
    rows = corpus(9)
    got = mine_collocations(spark.createDataFrame(rows, "lang string, text string"), top=50, least=2, frontier=1)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 50, 2))


def test_sums_of_many_small_blocks(spark, monkeypatch):
    import remap.llm.collocations as colloc

    monkeypatch.setattr(colloc, "HELD_KEYS", 16)  # blocks are sent and summed again and again
    rows = corpus(4)
    got = mine_collocations(spark.createDataFrame(rows, "lang string, text string"), top=50, least=2, frontier=1)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 50, 2))


def test_words_cut_on_bytes_as_on_characters(monkeypatch):
    import pyarrow as pa

    import remap.llm.collocations as colloc

    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aZé漢  \x00\x1c \t.,;:!?\n\x0b\x0c\r") for _ in range(rnd.randint(0, 30)))
             for _ in range(300)] + [None, "", " ", ".", "a"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = [re.findall(r"[^\x20\x09]+", p) for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(lower))]
    words, cut = colloc._tokens(pa.array([t for t in texts if t is not None], pa.string()))
    found, ends = words.to_pylist(), [i for i, c in enumerate(cut) if c and i]
    assert [found[a:b] for a, b in zip([0, *ends], [*ends, len(found)]) if b > a] == [p for p in pieces if p]
    monkeypatch.setattr(colloc, "TEXT_BYTES", 40)
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array(texts, pa.string())], names=["lang", "text"])
    counted = Counter()
    for part in colloc._word_counts(iter([batch])):
        for row in part.to_pylist():
            counted[row["phrase"]] += row["f"]
    assert counted == Counter(w for p in pieces for w in p) + Counter({"": len(found)})


def test_writes_no_rare_words(spark):
    """The texts are written once more as numbers of frequent words only, whatever else they hold."""
    import os

    from remap.session import recording

    rnd = random.Random(3)
    rows = [("en", " ".join("new york " + "%032x" % rnd.getrandbits(128) for _ in range(100))) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    with recording() as paths:
        got = mine_collocations(docs, top=4, least=100).collect()
    assert [tuple(r)[:4] for r in got] == [("en", 1, "new york", 20000)]
    size = sum(os.path.getsize(f"{p}/{f}") for p in paths for f in os.listdir(p))
    assert size < 0.2 * sum(len(t) for _, t in rows)
