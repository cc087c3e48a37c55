"""Phrase collocation mining: best-first branch and bound over counted phrases.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into
words ``[^\\x20\\x09]+``.  Per language (null: ``und``), ``n`` counts all words and
``f(p)`` all contiguous occurrences of phrase ``p`` inside pieces, overlaps included.

Growth by prefix counts.  Only words with ``f >= least`` can lie in a phrase with
``f >= least``, and a phrase of ``k`` words has it only if both its parts of ``k - 1``
words have.  So the words are counted first and the frequent ones numbered, over all
languages in one sequence; the texts are then written once as word numbers (runs of
two frequent words at least), and one pass over those per phrase length grows the
frequent phrases of one word less.  A phrase is one 64-bit integer: the number of its
first ``k - 1`` words times the count of frequent words, plus its last word.  Both
passes over the texts cut them on whole byte buffers (``mapInArrow``); keys are summed
by sorting in the map tasks, dealt by hash in compressed blocks, and summed again.
Counts below ``least`` go, and the rest are spelled out.  What remains, with the
frequent words, is the table of *prefix counts* from which every cut is scored: all
parts of a candidate are at least as frequent.

Bound.  A candidate's score is the least over its cuts of
``floor(1000 * a * n / (l * r))``.  The cut after the first word has ``r >= a``,
and the cut before the last has ``l >= a``, so ``1000 * n / max(f(first), f(last))``
bounds the score from above for every phrase with those end words.  Best first: per
language the candidates of highest bound (``frontier * top`` of them, ties included)
are scored exactly and reduced by the drop rule; the ``top``-th survivor's score is
a lower bound of the final one, so every candidate whose bound lies below it is cut
off unscored.  The rest are scored, and the ranking settles the ``top`` rows.

Exact arithmetic: scores are computed with 38-digit decimals and integral division.
Drop rule: a candidate goes if a longer candidate containing its words contiguously
has the same count; any such one implies an extension by one word with that count,
so the test looks only one word to the left and right.

Defined results: null texts are empty and add nothing; an empty table or a language
without candidates gives no rows; repeated rows count twice; only ``lang`` and
``text`` are read; ties rank by ``a`` descending, then phrase bytes ascending.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remap.llm.texts import buffers, slices
from remap.session import materialize

LEAST = 100
LONGEST = 5
TOP = 2000
FRONTIER = 4
BROADCAST_BYTES = 64 << 20  # frequent words, and keys of frequent phrases, broadcast below this measured size
TEXT_BYTES = 8 << 20  # of texts cut at a time
HELD_KEYS = 2 << 20  # phrase occurrences a task holds before it sums them

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE_BREAK = "[.,;:!?\\x0A-\\x0D]"
WORD_BREAK = "[\\x20\\x09]+"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BLANKS, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"  # the same as bytes
_BETWEEN = _BLANKS + _BREAKS
_KINDS = bytes(2 if b in _BREAKS else 1 if b in _BLANKS else 0 for b in range(256))
_LOW = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
_EXACT = "decimal(38,0)"


def piece_texts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece) per lower-cased piece holding more than blanks."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    cut = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                      F.explode(F.split(text, PIECE_BREAK, -1)).alias("piece"))
    return cut.where(F.length(F.translate("piece", " \t", "")) > 0)


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words) per non-empty piece."""
    return words_of(piece_texts(docs, lang_col, text_col))


def words_of(cut: DataFrame) -> DataFrame:
    words = F.filter(F.split("piece", WORD_BREAK, -1), lambda w: w != "")
    return cut.select("lang", words.alias("words")).where(F.size("words") > 0)


def _all_grams(ks: tuple[int, ...]):
    """mapInPandas body: every phrase of ``ks`` words."""

    def run(batches):
        for pdf in batches:
            langs, phrases = [], []
            for lang, words in zip(pdf["lang"], pdf["words"]):
                words = list(words)
                for k in ks:
                    for i in range(len(words) - k + 1):
                        langs.append(lang)
                        phrases.append(" ".join(words[i : i + k]))
            yield pd.DataFrame({"lang": langs, "phrase": phrases}, dtype=object)

    return run


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``texts`` in order, and before which of them (or the end) a piece is cut."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")
    raw = joined[0].as_buffer().to_pybytes()
    kinds = np.frombuffer(raw.translate(_KINDS), np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    np.equal(kinds, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = raw.translate(_LOW, _BETWEEN)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    cut = np.zeros(len(starts) + 1, dtype=bool)
    cut[np.searchsorted(starts, np.flatnonzero(kinds == 2))] = True
    return words, cut


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) in slices of bounded bytes; null texts are left out."""
    langs, texts = batch.column(0), batch.column(1)
    for lang in pc.unique(langs).to_pylist():
        part = pc.drop_null(pc.filter(texts, pc.equal(langs, lang)))
        _, offsets = buffers(part)
        for first, last in slices(offsets, TEXT_BYTES):
            yield lang, part.slice(first, last - first)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (lang, phrase, f) per word of a slice; the empty word counts all words."""
    for batch in batches:
        for lang, texts in _by_lang(batch):
            words, _ = _tokens(texts)
            found = pc.value_counts(words)
            phrases = pa.concat_arrays([found.field(0), pa.array([""], pa.string())])
            f = pa.concat_arrays([found.field(1), pa.array([len(words)], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(f)), phrases, f],
                                             names=["lang", "phrase", "f"])


def _packed(values: np.ndarray) -> bytes:
    """Integers by their bytes' places, compressed: the high bytes are mostly equal."""
    return pa.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: pa.Scalar, count: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data.as_buffer(), decompressed_size=count * width, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, count).T).view(kind).reshape(count)


def _runs(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` words from each of ``at``, -1 after each run; the last of ``ids`` is -1."""
    kept = np.zeros(len(ids), dtype=bool)
    for j in range(k):
        kept[at + j] = True
    closed = kept.copy()
    closed[1:] |= kept[:-1]
    return np.where(kept, ids, np.int32(-1))[closed]


def _numbered(vocab):
    """mapInArrow body: (n, ids), the numbers of the frequent words that stand beside another in
    their piece, -1 after each run of them."""

    def run(batches):
        langs, lang_of, words = vocab.value
        sets = {}
        for batch in batches:
            for lang, texts in _by_lang(batch):
                if lang not in langs:
                    continue
                if lang not in sets:
                    own = np.flatnonzero(lang_of == langs.index(lang)).astype(np.int32)
                    sets[lang] = np.append(own, np.int32(-1)), words.take(pa.array(own))
                own, known = sets[lang]
                found, cut = _tokens(texts)
                place = pc.fill_null(pc.index_in(found, value_set=known), len(known)).to_numpy()
                ids = np.full(len(found) + int(cut.sum()) + 1, -1, np.int32)
                ids[np.arange(len(found)) + np.cumsum(cut[:-1])] = own[place]
                ids = _runs(ids, np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)), 2)
                if len(ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([len(ids)], pa.int32()), pa.array([_packed(ids)], pa.binary())], names=["n", "ids"])

    return run


def _grown(ids: np.ndarray, at: np.ndarray, known: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys of the phrases of ``k`` words both of whose parts of ``k - 1`` words are frequent,
    from the starts and numbers of these."""
    both = np.flatnonzero(at[1:] == at[:-1] + 1)
    at = at[both]
    return at, known[both] * size + ids[at + k - 1]


def _spot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - bits)).view(np.int64)


def _levels(tables: list) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Per table its sorted keys and a sieve of their hashes, which spares most other keys the search."""
    out = []
    for table in tables:
        bits = max(10, min(26, (16 * len(table.value)).bit_length()))
        sieve = np.zeros(1 << bits, dtype=bool)
        sieve[_spot(table.value, bits)] = True
        out.append((table.value, sieve, bits))
    return out


def _known(ids: np.ndarray, levels: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of the longest frequent phrases that ``levels`` holds the sorted keys of."""
    at = np.flatnonzero(ids >= 0)
    known = ids[at].astype(np.int64)
    for k, (keys, sieve, bits) in enumerate(levels, 2):
        at, wanted = _grown(ids, at, known, k, size)
        likely = np.flatnonzero(sieve[_spot(wanted, bits)])
        at, wanted = at[likely], wanted[likely]
        place = np.searchsorted(keys, wanted)
        place[place == len(keys)] = 0
        hit = np.flatnonzero(keys[place] == wanted)
        at, known = at[hit], place[hit]
    return at, known


def _summed(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts (of ones without)."""
    flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    if counts is None:
        flat.sort()
    else:
        order = np.argsort(flat, kind="stable")
        flat, weights = flat[order], np.concatenate(counts)[order] if counts else flat
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    if counts is None:
        return flat[first], np.diff(np.append(first, len(flat)))
    return flat[first], np.add.reduceat(weights, first) if len(first) else first


def _blocks(vocab, tables: list, k: int, buckets: int, keep: bool):
    """mapInArrow body: (bucket, n, keys, counts) of the phrases of ``k`` words, summed per HELD_KEYS;
    with ``keep`` also the words in them, as rows of bucket -1 with the numbers for keys."""
    kinds = {"bucket": pa.int32(), "n": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    narrow = np.uint16 if buckets <= 1 << 16 else np.int64

    def rows(*found):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds.values())],
                                          names=list(kinds))

    def packed(held):
        keys, counts = _summed(held)
        bucket = (_spot(keys, 40) % buckets).astype(narrow)
        order = np.argsort(bucket, kind="stable")  # keys stay ascending within a bucket
        keys, counts, bucket = keys[order], counts[order].astype(np.int32), bucket[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        return rows(*[(int(bucket[a]), int(b - a), _packed(np.diff(keys[a:b], prepend=0)), _packed(counts[a:b]))
                      for a, b in zip(first, [*first[1:], len(keys)])])

    def run(batches):
        levels, size = _levels(tables), len(vocab.value[2])
        held, number = [], 0
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = _unpacked(data, n, np.int32)
                at, keys = _grown(ids, *_known(ids, levels, size), k, size)
                held.append(keys)
                number += len(keys)
                if keep and len(at):
                    ids = _runs(ids, at, k)
                    yield rows((-1, len(ids), _packed(ids), None))
                if number >= HELD_KEYS:
                    yield packed(held)
                    held, number = [], 0
        if number:
            yield packed(held)

    return run


def _frequent(least: int):
    """mapInArrow body: (key, f) with f >= least from all blocks of a partition's buckets."""

    def run(batches):
        keys, counts, number = [], [], 0
        for batch in batches:
            for n, k, c in zip(batch.column("n").to_pylist(), batch.column("keys"), batch.column("counts")):
                keys.append(np.cumsum(_unpacked(k, n, np.int64)))
                counts.append(_unpacked(c, n, np.int32).astype(np.int64))
                number += n
                if number >= 2 * HELD_KEYS:
                    keys, counts = ([x] for x in _summed(keys, counts))
                    number = 0
        found, f = _summed(keys, counts)
        often = f >= least
        yield pa.RecordBatch.from_arrays([pa.array(found[often], pa.int64()), pa.array(f[often], pa.int64())],
                                         names=["key", "f"])

    return run


def _tuples(vocab, tables: list, ks: tuple[int, ...], longest: int):
    """mapInArrow body: word numbers (-1 padded to ``longest``) of the phrases of ``ks`` words whose
    parts of as many words as ``tables`` goes up to are all frequent."""

    def run(batches):
        levels, size = _levels(tables), len(vocab.value[2])
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = _unpacked(data, n, np.int32)
                at, _ = _known(ids, levels, size)
                for k in ks:
                    further = k - len(levels) - 1  # as many more parts must follow word by word
                    starts = at[: max(0, len(at) - further)]
                    starts = starts[at[further:] == starts + further]
                    cols = [ids[starts + j] if j < k else np.full(len(starts), -1, np.int32) for j in range(longest)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols],
                                                     names=[f"w{j + 1}" for j in range(longest)])

    return run


def _texts_of(vocab, words: list[np.ndarray], f: pa.Array) -> pa.RecordBatch:
    langs, lang_of, texts = vocab.value
    lang = pa.array(langs, pa.string()).take(pa.array(lang_of[words[0]]))
    phrase = pc.binary_join_element_wise(*[texts.take(pa.array(w)) for w in words], " ")
    return pa.RecordBatch.from_arrays([lang, phrase, pa.repeat(pa.scalar(len(words), pa.int32()), len(f)), f],
                                      names=["lang", "phrase", "k", "f"])


def _spelled(vocab, tables: list):
    """mapInArrow body: (lang, phrase, k, f) of counted (k, key, f)."""

    def run(batches):
        size = len(vocab.value[2])
        for batch in batches:
            lengths, every = batch.column("k").to_numpy(), batch.column("key").to_numpy()
            for k in np.unique(lengths):
                at = np.flatnonzero(lengths == k)
                keys, words = every[at], []
                for j in range(k, 1, -1):
                    words.insert(0, keys % size)
                    keys = keys // size if j == 2 else tables[j - 3].value[keys // size]
                yield _texts_of(vocab, [keys, *words], batch.column("f").take(pa.array(at)))

    return run


def _spelled_tuples(vocab):
    """mapInArrow body: (lang, phrase, k, f) of counted (w1, .., f)."""

    def run(batches):
        for batch in batches:
            words = np.stack([c.to_numpy() for c in batch.columns[:-1]])
            lengths = (words >= 0).sum(axis=0)
            for k in np.unique(lengths):
                at = np.flatnonzero(lengths == k)
                yield _texts_of(vocab, list(words[:k, at]), batch.column("f").take(pa.array(at)))

    return run


def _measured(df: DataFrame, width: Column) -> int:
    return df.select(F.sum(width)).first()[0] or 0


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts (lang, phrase, k, f) of every phrase of 1 to ``longest`` words with f >= least, and n per lang.

    Apriori growth on word numbers, see above; only the frequent phrases are spelled out
    again.  The frequent words, and the keys of the frequent phrases of each length, go to
    the tasks as broadcasts where they measure below BROADCAST_BYTES.  From the length on
    at which the keys are beyond that, phrases are counted as word numbers and tested by
    the shorter ones only; with the words themselves beyond it, phrases are generated as
    text without the test.  Both count more but find the same.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    every = texts.mapInArrow(_word_counts, "lang string, phrase string, f long")
    every = every.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    every = materialize(every.where((F.col("f") >= least) | (F.col("phrase") == "")), "colloc-words")
    totals = every.where((F.col("phrase") == "") & (F.col("f") > 0)).select("lang", F.col("f").alias("n"))
    singles = every.where((F.col("phrase") != "") & (F.col("f") >= least)).select(
        "lang", "phrase", F.lit(1).alias("k"), "f")
    if _measured(singles, F.octet_length("phrase") + 8) > BROADCAST_BYTES:
        grams = pieces(docs, lang_col, text_col).mapInPandas(_all_grams(tuple(range(2, longest + 1))),
                                                             "lang string, phrase string")
        counted = grams.groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least)
        counted = counted.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "f")
        return materialize(singles.unionByName(counted), "colloc-counts"), totals
    held = singles.select("lang", "phrase", "f").toArrow().combine_chunks()
    if not held.num_rows:
        return singles, totals
    held = held.take(pa.array(np.argsort(-held["f"].to_numpy(), kind="stable")))  # small numbers for the most frequent
    langs = pc.unique(held["lang"]).to_pylist()
    lang_of = pc.index_in(held["lang"], value_set=pa.array(langs, pa.string())).to_numpy()
    vocab = spark.sparkContext.broadcast((langs, lang_of, held["phrase"].combine_chunks()))
    ids = materialize(texts.mapInArrow(_numbered(vocab), "n int, ids binary"), "colloc-ids")
    words = totals.agg(F.sum("n")).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // (2 * HELD_KEYS)))

    tables, held_bytes, found, table = [], 0, [], singles
    schema = "lang string, phrase string, k int, f long"
    for k in range(2, longest + 1):
        keep = 2 < k < longest  # the words that longer phrases can have; before, ids has them alone
        blocks = ids.mapInArrow(_blocks(vocab, list(tables), k, buckets, keep), "bucket int, n int, keys binary, counts binary")
        if keep:
            blocks = materialize(blocks, "colloc-blocks")
            ids = blocks.where(F.col("bucket") < 0).select("n", F.col("keys").alias("ids"))
            blocks = blocks.where(F.col("bucket") >= 0)
        counted = blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(_frequent(least), "key long, f long")
        counted = materialize(counted, "colloc-keys")
        found.append(counted.select(F.lit(k).alias("k"), "key", "f"))
        number = counted.count()
        held_bytes += 8 * number
        if k == longest or not number:
            break
        if held_bytes > BROADCAST_BYTES:
            ws = [f"w{j}" for j in range(1, longest + 1)]
            rest = ids.mapInArrow(_tuples(vocab, list(tables), tuple(range(k + 1, longest + 1)), longest),
                                  ", ".join(f"{w} int" for w in ws))
            rest = rest.groupBy(*ws).agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least)
            table = table.unionByName(rest.mapInArrow(_spelled_tuples(vocab), schema))
            break
        keys = counted.select("key").toArrow()["key"].to_numpy()
        tables.append(spark.sparkContext.broadcast(np.sort(keys)))
    for keys in found:
        table = table.unionByName(keys.mapInArrow(_spelled(vocab, tables), schema))
    return materialize(table, "colloc-counts"), totals


def _part(words: Column, first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def score(cands: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Exact score of candidates (lang, phrase, k, f): the least cut, ties to the smallest k."""
    words = F.split("phrase", " ")
    cuts = cands.select("lang", "phrase", F.col("f").alias("a"),
                        F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"), words.alias("ws"))
    cuts = cuts.select("lang", "phrase", "a", "j", _part(F.col("ws"), 1, F.col("j")).alias("lp"),
                       _part(F.col("ws"), F.col("j") + 1, F.size("ws") - F.col("j")).alias("rp"))
    side = counts.select("lang", "phrase", "f")
    cuts = cuts.join(side.withColumnsRenamed({"phrase": "lp", "f": "l"}), ["lang", "lp"]).join(
        side.withColumnsRenamed({"phrase": "rp", "f": "r"}), ["lang", "rp"]).join(totals, "lang")
    num = F.lit(1000).cast(_EXACT) * F.col("a").cast(_EXACT) * F.col("n").cast(_EXACT)
    den = F.col("l").cast(_EXACT) * F.col("r").cast(_EXACT)
    cuts = cuts.withColumns({"__num": num, "__den": den}).withColumn("score", F.expr("__num div __den").cast("long"))
    best = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "j", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def survivors(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """Scored candidates that no one-word-longer counted phrase with the same count contains."""
    words = F.split("phrase", " ")
    longer = counts.where(F.col("k") >= 3)
    inner = longer.select("lang", _part(words, 1, F.col("k") - 1).alias("phrase"), "f").unionByName(
        longer.select("lang", _part(words, 2, F.col("k") - 1).alias("phrase"), "f"))
    inner = inner.select("lang", "phrase", F.col("f").alias("a")).distinct()
    return scored.join(inner, ["lang", "phrase", "a"], "left_anti")


def _nth_value(df: DataFrame, value: str, nth: int) -> DataFrame:
    """Per lang, the ``nth`` largest ``value`` (ties counted), through a histogram of the values."""
    hist = df.groupBy("lang", value).agg(F.count(F.lit(1)).alias("__c"))
    above = Window.partitionBy("lang").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("__run", F.sum("__c").over(above))
    return hist.where(F.col("__run") >= nth).groupBy("lang").agg(F.max(value).alias("__cut"))


def mine_collocations(
    docs: DataFrame,
    *,
    top: int = TOP,
    least: int = LEAST,
    longest: int = LONGEST,
    frontier: int = FRONTIER,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """Per language the ``top`` surviving phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = count_phrases(docs, least, longest, lang_col, text_col)
    singles = counts.where(F.col("k") == 1).select("lang", F.col("phrase").alias("__w"), F.col("f").alias("__fw"))
    cands = counts.where(F.col("k") >= 2).withColumn("__ws", F.split("phrase", " "))
    ends = cands.withColumns({"__first": F.element_at("__ws", 1), "__last": F.element_at("__ws", -1)})
    first = singles.withColumnsRenamed({"__w": "__first", "__fw": "__f1"})
    last = singles.withColumnsRenamed({"__w": "__last", "__fw": "__f2"})
    bound = F.expr("(CAST(1000 AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0))) div CAST(greatest(__f1, __f2) AS DECIMAL(38,0))")
    ends = ends.join(first, ["lang", "__first"]).join(last, ["lang", "__last"]).join(totals, "lang")
    cands = materialize(ends.select("lang", "phrase", "k", "f", bound.cast("long").alias("bound")), "colloc-bounds")

    # Round 1: the best-bounded frontier, scored exactly; its top-th survivor bounds the cut.
    reach = _nth_value(cands, "bound", frontier * top)
    first_round = cands.join(reach, "lang", "left").where(
        F.col("__cut").isNull() | (F.col("bound") >= F.col("__cut")))
    kept = survivors(score(first_round, counts, totals), counts)
    floor_ = _nth_value(kept, "score", top)
    # Round 2: every candidate whose bound can still reach that score.
    rest = cands.join(floor_, "lang", "left").where(F.col("__cut").isNull() | (F.col("bound") >= F.col("__cut")))
    final = materialize(survivors(score(rest, counts, totals), counts), "colloc-final")
    cut = _nth_value(final, "score", top)
    final = final.join(cut, "lang", "left").where(F.col("__cut").isNull() | (F.col("score") >= F.col("__cut")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = final.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
