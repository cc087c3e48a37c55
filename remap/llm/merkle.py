"""Merkle manifest of a table: ternary hash trees per source, then over the sources.

Cogrouped subtree exchange.  Leaves are hashed with Spark expressions and numbered
per source in doc_id order without a one-task window.  A *superblock* is an aligned
run of ``3**LEVELS`` nodes: a complete subtree.  ``applyInPandas`` reduces each
superblock to its root; the roots, a ``3**LEVELS``-th of the nodes, are reduced again
the same way until every source has one node, its subroot; the subroots, ordered by
source, give the root likewise.  Each reduction above the leaves also returns, per
node, its path: the siblings at each level up to its top.  Finally the leaves of a
superblock are cogrouped with the one row of their *outer nodes* (the siblings from
the superblock root up to the root): there the local reduction is finished, the
local and outer paths are joined into the proof, and a changed leaf is folded up to
the root.  No group is larger than a superblock, whatever a source holds.

Hash ``H``: lowercase hex SHA-256 of the concatenated inputs, digests given as hex.
A leaf is ``H`` of doc_id, source, lang, n_chars, text, each ``-`` if null, else its
UTF-8 byte count, ``:``, its value.  Per level, every 3 consecutive nodes (the last
run fewer, even one) become the ``H`` of their digests, while more than one remain.

Defined results: one output row per input row; rows equal in doc_id order by leaf,
and equal rows have equal proofs; a null source is a source of its own, first in
order; a null doc_id comes first in its source and is never tampered; an empty table
gives an empty result; only the five named columns are read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remap.operators.numbering import number_rows
from remap.session import materialize

FANOUT = 3
LEVELS = 7  # a superblock holds 3**7 = 2187 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "g long, idx long, h string"
_PATHS = "g long, idx long, block long, top string, lefts array<string>, rights array<string>"
_OUT = ("doc_id string, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean")


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(col: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = col.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(cols: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def levels_needed(count: int, levels: int = LEVELS) -> int:
    """Levels a superblock climbs: all ``levels`` while the group has more nodes, else until one is left."""
    if count > FANOUT**levels:
        return levels
    needed = 0
    while count > 1:
        count, needed = -(-count // FANOUT), needed + 1
    return needed


def climb(hashes: list[str], levels: int, paths: bool) -> tuple[str, list[list[tuple[str, str]]]]:
    """Top of ``levels`` reductions of consecutive ``hashes``, and each one's siblings per level."""
    cur, where = list(hashes), list(range(len(hashes)))
    way: list[list[tuple[str, str]]] = [[] for _ in hashes] if paths else []
    for _ in range(levels):
        if paths:
            for i, at in enumerate(where):
                start = at - at % FANOUT
                way[i].append(("".join(cur[start:at]), "".join(cur[at + 1 : start + FANOUT])))
            where = [at // FANOUT for at in where]
        cur = [_h("".join(cur[j : j + FANOUT])) for j in range(0, len(cur), FANOUT)]
    return cur[0], way


def _block_roots(levels: int):
    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        top, _ = climb(list(pdf["h"]), levels_needed(int(pdf["c"].iloc[0]), levels), False)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "idx": [pdf["idx"].iloc[0] // FANOUT**levels], "h": [top]})
    return roots


def _block_paths(levels: int):
    def paths(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        top, way = climb(list(pdf["h"]), levels_needed(int(pdf["c"].iloc[0]), levels), True)
        return pd.DataFrame({
            "g": pdf["g"].to_numpy(), "idx": pdf["idx"].to_numpy(), "block": pdf["idx"].to_numpy() // FANOUT**levels,
            "top": top, "lefts": [[l for l, _ in w] for w in way], "rights": [[r for _, r in w] for w in way]})
    return paths


def _up(counts: DataFrame, block: int) -> DataFrame:
    """Counts of the next round: one node per superblock, or one for a finished group."""
    return counts.select("g", F.when(F.col("c") > block, F.ceil(F.col("c") / block)).otherwise(1).cast("long").alias("c"))


def paths_up(nodes: DataFrame, counts: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Tops (g, h) of groups of nodes (g, idx, h), and each node's path (g, idx, lefts, rights) to it."""
    BLOCK = FANOUT**levels  # noqa: N806
    blocks = nodes.join(counts, "g").groupBy("g", (F.col("idx") / BLOCK).cast("long").alias("__b")).applyInPandas(
        _block_paths(levels), _PATHS)
    blocks = materialize(blocks.join(counts, "g"), "merkle-paths")
    done = blocks.where(F.col("c") <= BLOCK)
    tops = done.select("g", F.col("top").alias("h")).dropDuplicates(["g"])
    if blocks.where(F.col("c") > BLOCK).limit(1).count() == 0:
        return tops, blocks.select("g", "idx", "lefts", "rights")
    going = blocks.where(F.col("c") > BLOCK)
    parents = going.select("g", F.col("block").alias("idx"), F.col("top").alias("h")).dropDuplicates(["g", "idx"])
    upper_tops, upper = paths_up(parents, _up(counts.where(F.col("c") > BLOCK), BLOCK), levels)
    upper = upper.select("g", F.col("idx").alias("block"), F.col("lefts").alias("ul"), F.col("rights").alias("ur"))
    joined = going.join(upper, ["g", "block"]).select(
        "g", "idx", F.concat("lefts", "ul").alias("lefts"), F.concat("rights", "ur").alias("rights"))
    # written once: small (a superblock's share of the nodes), and their lineage is not joined twice
    return (materialize(tops.unionByName(upper_tops), "merkle-tops"),
            materialize(done.select("g", "idx", "lefts", "rights").unionByName(joined), "merkle-paths-up"))


def _finish(levels: int):
    return lambda leaves, outer: _fold(leaves, outer, levels)


def _fold(leaves: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    if leaves.empty:
        return pd.DataFrame({c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")})
    leaves = leaves.sort_values("idx", kind="stable")
    o = outer.iloc[0]
    _, way = climb(list(leaves["leaf"]), levels_needed(int(o["c"]), levels), True)
    tail = list(zip(o["lefts"], o["rights"]))
    proofs, folded = [], []
    for tampered, local in zip(leaves["tampered"], way):
        full = local + tail
        proofs.append(_h("".join(l + r for l, r in full)))
        for l, r in full:
            tampered = _h(l + tampered + r)
        folded.append(tampered)
    return pd.DataFrame({
        "doc_id": leaves["doc_id"].to_numpy(), "leaf": leaves["leaf"].to_numpy(), "subroot": o["subroot"],
        "root": o["root"], "proof_sha256": proofs, "folded_root": folded,
        "verified": [f == o["root"] for f in folded]})


def manifest(docs: DataFrame, tamper: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root, proof and the fold of a tampered leaf for every row of ``docs``.

    ``docs`` needs the columns of :data:`FIELDS`.  ``tamper`` is the text the check
    folds instead (None: the text itself); it is hashed like the original leaf.
    ``levels`` sets the superblock, ``3**levels`` nodes.
    """
    BLOCK = FANOUT**levels  # noqa: N806
    cols = [F.col(c) for c in FIELDS]
    changed = [F.col(c) for c in FIELDS[:-1]] + [tamper if tamper is not None else F.col("text")]
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("__src"),
        leaf_hash(cols).alias("leaf"), leaf_hash(changed).alias("tampered"))
    sources = hashed.groupBy("__src").agg(F.count(F.lit(1)).alias("c"))
    sources = number_rows(sources, [F.col("__src").asc_nulls_first()], output="__pos")
    sources = materialize(sources.select("__src", (F.col("__pos") - 1).alias("g"), "c"), "merkle-sources")
    leaves = hashed.join(sources, hashed["__src"].eqNullSafe(sources["__src"])).select(
        "doc_id", "g", "leaf", "tampered")
    leaves = number_rows(leaves, [F.col("doc_id").asc_nulls_first(), F.col("leaf")], within=["g"], output="__pos")
    leaves = leaves.withColumn("idx", F.col("__pos") - 1).drop("__pos")
    counts = sources.select("g", "c")

    # Round 0: superblock roots only; the leaves' own paths are made in the cogroup below.
    roots = leaves.select("g", "idx", F.col("leaf").alias("h")).join(counts, "g").groupBy(
        "g", (F.col("idx") / BLOCK).cast("long").alias("__b")).applyInPandas(_block_roots(levels), _NODES)
    roots = materialize(roots, "merkle-roots")
    big = counts.where(F.col("c") > BLOCK)
    subroots = roots.join(counts.where(F.col("c") <= BLOCK), "g").select("g", "h")
    block_paths = None
    if big.limit(1).count():
        upper_tops, block_paths = paths_up(roots.join(big.select("g"), "g"), _up(big, BLOCK), levels)
        subroots = subroots.unionByName(upper_tops)
    top_nodes = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), "h")
    n_sources = counts.agg(F.count(F.lit(1)).alias("c")).select(F.lit(0).cast("long").alias("g"), "c")
    root, source_paths = paths_up(top_nodes, n_sources, levels)
    per_source = source_paths.select(F.col("idx").alias("g"), F.col("lefts").alias("sl"), F.col("rights").alias("sr")).join(
        subroots.withColumnRenamed("h", "subroot"), "g").withColumn("__k", F.lit(0).cast("long")).join(
        root.select(F.col("g").alias("__k"), F.col("h").alias("root")), "__k").drop("__k")
    per_source = materialize(per_source.join(counts, "g"), "merkle-sources-up")

    empty = F.array().cast("array<string>")
    blocks = leaves.select("g", (F.col("idx") / BLOCK).cast("long").alias("block")).distinct()
    if block_paths is not None:
        blocks = blocks.join(block_paths.withColumnRenamed("idx", "block"), ["g", "block"], "left")
    else:
        blocks = blocks.withColumns({"lefts": empty, "rights": empty})
    outer = blocks.join(per_source, "g").select(
        "g", "block", F.concat(F.coalesce("lefts", empty), "sl").alias("lefts"),
        F.concat(F.coalesce("rights", empty), "sr").alias("rights"), "subroot", "root", "c")
    outer = materialize(outer, "merkle-outer")  # one row per superblock
    # ids go through pandas as text: a null among them would turn the column into floats
    grouped = leaves.withColumns({"block": (F.col("idx") / BLOCK).cast("long"), "doc_id": F.col("doc_id").cast("string")})
    done = grouped.groupBy("g", "block").cogroup(outer.groupBy("g", "block")).applyInPandas(_finish(levels), _OUT)
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
