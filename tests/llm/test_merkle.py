"""Merkle manifest against a plain tree built from the contract."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from remap.llm.merkle import manifest
from remap.llm.queries import op12_merkle


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text) -> str:
    doc_id, source, lang, n_chars, _ = row
    return H("".join(enc(v) for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Levels of a ternary tree, from the nodes up to one."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        levels.append([H("".join(cur[i : i + 3])) for i in range(0, len(cur), 3)])
    return levels


def path(levels, at):
    way = []
    for cur in levels[:-1]:
        start = at - at % 3
        way.append(("".join(cur[start:at]), "".join(cur[at + 1 : start + 3])))
        at //= 3
    return way


def tampered(row):
    doc_id, *_, text = row
    if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
        return text.replace("\n", "")
    return text


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    per, out = {}, []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        per[s] = (mine, tree([leaf(r, r[4]) for r in mine]))
    top = tree([per[s][1][-1][0] for s in sources])
    root = top[-1][0]
    for k, s in enumerate(sources):
        mine, levels = per[s]
        for i, r in enumerate(mine):
            full = path(levels, i) + path(top, k)
            x = leaf(r, tampered(r))
            for left, right in full:
                x = H(left + x + right)
            out.append((r[0], leaf(r, r[4]), levels[-1][0], root, H("".join(a + b for a, b in full)), x, x == root))
    return sorted(out, key=str)


def rows_of(n_big):
    rows = [(i, "big", "en", i * 3, f"line {i}\nnext {i}" if i % 5 else None) for i in range(n_big)]
    rows += [(7, None, None, None, "a\nb"), (3, None, "fr", 1, "é\n"), (None, None, "de", 2, "x")]
    rows += [(100, "lone", "en", 1, "only one\n"), (5, "big", "en", 15, "line 5\nnext 5")]  # a repeated row
    rows += [(200 + i, "ß-source", "de", i, "\n" * i) for i in range(4)]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels,n_big", [(1, 40), (2, 100), (7, 30)])
def test_equals_a_plain_tree(spark, levels, n_big):
    rows = rows_of(n_big)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("source_x", F.lit(1))
    touched = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = manifest(docs, F.when(touched, F.translate("text", "\n", "")).otherwise(F.col("text")), levels=levels)
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == brute(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_row_and_empty(spark):
    one = spark.createDataFrame([(1, "s", "en", 3, "abc")], SCHEMA)
    (row,) = manifest(one).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == H("")
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_given_table(spark):
    got = op12_merkle(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "source", "lang", "n_chars", "text").collect()
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([tuple(r) for r in rows])
