"""URL filter: a bit-parallel automaton that runs every glob rule at once.

Each glob becomes a run of states, one bit each, packed side by side into 64-bit
words.  Reading a character is one multiword Shift-And step: states move on
where their token accepts the character and stay where a ``*`` follows them.
A batch of urls is stepped together, one character position at a time.

A glob is matched against the whole canonical url ``.<host>#<path>``: ``#`` can
occur in neither part, so a rule cannot match a host name inside a path.  ``*``
stands for any run of characters (none included), ``?`` for exactly one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CELLS = 4 << 20  # characters stepped together


@dataclass(frozen=True)
class SiteRule:
    """``site`` is ``host/path``; it holds for the host and all its subdomains."""

    site: str
    verdict: str

    @property
    def glob(self) -> str:
        host, _, path = self.site.partition("/")
        return f"*.{host}#/{path}*"


class Automaton:
    """All globs as multiword Shift-And masks."""

    def __init__(self, globs: Sequence[str]):
        tokens: list[str] = []  # token that leads into each state; "" for a first state
        stays: list[bool] = []
        self.accept: list[int] = []
        first: list[int] = []
        for glob in globs:
            first.append(len(tokens))
            tokens.append("")
            stays.append(False)
            for ch in glob:
                if ch == "*":
                    stays[-1] = True
                else:
                    tokens.append(ch)
                    stays.append(False)
            self.accept.append(len(tokens) - 1)
        self.words = max(1, -(-len(tokens) // 64))
        self.alphabet = np.array(sorted({ord(t) for t in tokens if t and t != "?"}), dtype=np.int64)
        self.start = self._mask(first)
        self.stay = self._mask([i for i, s in enumerate(stays) if s])
        wild = [i for i, t in enumerate(tokens) if t == "?"]
        # One row of masks per character of the alphabet, the last for any other.
        self.step = np.stack(
            [self._mask(wild + [i for i, t in enumerate(tokens) if t == chr(c)]) for c in self.alphabet]
            + [self._mask(wild)]
        )

    def _mask(self, states: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for s in states:
            out[s // 64] |= np.uint64(1 << (s % 64))
        return out

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """Row of ``step`` for each character."""
        if not len(self.alphabet):
            return np.zeros(len(codes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, len(self.alphabet))

    def matches(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix: text by glob."""
        out = np.zeros((len(texts), len(self.accept)), dtype=bool)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):  # texts of like length together, within a bound of cells
            longest = max(1, int(lengths[order[at]]))
            rows = order[at : at + max(1, _CELLS // longest)]
            out[rows] = self._run([texts[r] for r in rows], lengths[rows])
            at += len(rows)
        return out

    def _run(self, texts: list[str], lengths: np.ndarray) -> np.ndarray:
        """``texts`` are sorted by falling length."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = self.classes(codes.astype(np.int64))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        live = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -i, side="left"))  # texts longer than i
            now = live[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.step[kinds[starts[:n] + i]]
            live[:n] = moved | (now & self.stay)
        end = np.array(self.accept, dtype=np.int64)
        return ((live[:, end // 64] >> (end % 64).astype(np.uint64)) & one).astype(bool)


def canonical(url) -> tuple:
    """Host and path columns of a url column; null or no ``://`` gives empty ones."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, SMALL)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(
    df: DataFrame,
    url_col: str,
    id_col: str,
    rules: Sequence[SiteRule],
    block_globs: Sequence[str] = (),
) -> DataFrame:
    """``id_col``, host, path, rule, verdict and the block globs that fit, per row.

    The longest site rule that fits decides (of equally long ones the first
    listed).  Where none fits, a url that any block glob fits is blocked and
    every other allowed.  Null, empty and repeated rows each get their own
    verdict; other columns of ``df`` are left out, so their names cannot clash.
    """
    host, path = canonical(F.col(f"`{url_col}`"))
    globs = [r.glob for r in rules] + list(block_globs)
    sites = [(r.site, r.verdict) for r in rules]
    ranks = sorted(range(len(sites)), key=lambda i: (-len(sites[i][0]), i))
    plain = list(block_globs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            hit = automaton.matches(texts)
            rule: list[str | None] = [None] * len(texts)
            blocked = hit[:, len(sites) :]
            verdict = np.where(blocked.any(axis=1), "block", "allow").astype(object)
            for i in reversed(ranks):  # the longest is written last
                for row in np.flatnonzero(hit[:, i]):
                    rule[row], verdict[row] = sites[i]
            fits = [[plain[j] for j in np.flatnonzero(row)] for row in blocked]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict.tolist(), pa.string()),
                 pa.array(fits, pa.list_(pa.string()))],
                ["id", "host", "path", "rule", "verdict", "globs"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("canonical", F.concat(F.lit("."), "host", F.lit("#"), "path"))
    schema = f"id {id_type}, host string, path string, rule string, verdict string, globs array<string>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
