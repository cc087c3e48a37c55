"""Token ids of texts, with a bounded cache of the ids of repeated words.

The byte-level tokenizer cuts a text at every single space between two other
characters before it merges anything, so such chunks can be encoded one by one and
put together again.  Most chunks of a corpus repeat; each worker keeps the ids of
those it has met, up to a bound, and asks the tokenizer for the rest only, many at a
time: a newline between two chunks is an id of its own.  At the bound, chunks that were
met once are forgotten.
"""

from __future__ import annotations

import hashlib
import os
import re
import string

import numpy as np

CACHE_CHUNKS = 1_400_000  # about 250 MB in a worker
JOINED = 20_000  # new chunks in one call of the tokenizer
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SIMPLE = re.compile(r" ?\S+")
_encoders: dict[str, Encoder] = {}


class _Numbers(dict):
    """Numbers chunks in the order they are first asked for; new ones go to ``queue``."""

    def __init__(self, before: str, queue: list[str]):
        self.before, self.queue, self.base = before, queue, 0

    def __missing__(self, chunk: str) -> int:
        at = self[chunk] = self.base + len(self.queue)
        self.queue.append(self.before + chunk)
        return at


class Encoder:
    """A tokenizer of the ``tokenizers`` library behind the cache."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        pre = self.tokenizer.pre_tokenizer
        # Other tokenizers get whole texts: what is said above holds for this kind only.
        self.by_chunk = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and not self.tokenizer.normalizer
        if self.by_chunk:
            self.newline = self._ask(["\n"])[0]
            self.by_chunk = len(self.newline) == 1
        self.bound = CACHE_CHUNKS
        self._clear()

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _clear(self) -> None:
        self.queue: list[str] = []
        self.plain = _Numbers("", self.queue)  # chunks as they stand
        self.spaced = _Numbers(" ", self.queue)  # chunks without the space before them
        self.ids = np.zeros(0, dtype=np.uint32)
        self.starts = self.sizes = self.uses = np.zeros(0, dtype=np.int64)

    def _learn(self) -> None:
        """Ids of the queued chunks.

        A word with punctuation behind it is two pieces to the tokenizer, so only the
        word is asked for; it joins the queue as a chunk of its own.
        """
        base, joined, simple = self.plain.base, [], []
        for i, chunk in enumerate(self.queue):  # grows meanwhile
            word = chunk.rstrip(string.punctuation)
            bare = word[1:] if word[:1] == " " else word
            if len(word) < len(chunk) and bare.isalpha():
                joined.append((i, (self.spaced if len(bare) < len(word) else self.plain)[bare], self.plain[chunk[len(word) :]]))
            elif _SIMPLE.fullmatch(chunk):
                simple.append(i)
        found: list = [None] * len(self.queue)
        for a in range(0, len(simple), JOINED):
            part = simple[a : a + JOINED]
            ids = np.array(self._ask(["\n".join([self.queue[i] for i in part])])[0], dtype=np.uint32)
            ends = np.append(np.flatnonzero(ids == self.newline[0]), len(ids))
            for i, first, last in zip(part, np.append(0, ends[:-1] + 1).tolist(), ends.tolist()):
                found[i] = ids[first:last]
        rest = sorted({i for i, x in enumerate(found) if x is None} - {i for i, *_ in joined})
        for i, ids in zip(rest, self._ask([self.queue[i] for i in rest])):
            found[i] = np.array(ids, dtype=np.uint32)
        for i, *parts in joined:
            found[i] = np.concatenate([found[k - base] if k >= base else self._known(k) for k in parts])
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, *found))
        self.uses = np.concatenate((self.uses, np.zeros_like(sizes)))
        self.queue.clear()
        self.plain.base = self.spaced.base = len(self.sizes)

    def _forget(self) -> None:
        """Keep what was met again since the last time; start anew if that is too much still."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.bound // 2 or int(self.sizes[kept].sum()) > 5 * self.bound:
            self._clear()
            return
        number = np.full(len(self.uses), -1)
        number[kept] = np.arange(len(kept))
        number = number.tolist()
        for cache in (self.plain, self.spaced):
            own = {c: number[k] for c, k in cache.items() if number[k] >= 0}
            cache.clear()
            cache.update(own)
            cache.base = len(kept)
        sizes = self.sizes[kept]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.ids = self.ids[np.repeat(self.starts[kept], sizes) + within]
        self.starts, self.sizes, self.uses = np.cumsum(sizes) - sizes, sizes, np.zeros_like(sizes)

    def _known(self, k: int) -> np.ndarray:
        return self.ids[self.starts[k] : self.starts[k] + self.sizes[k]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer gives them for the whole text."""
        if not self.by_chunk:
            return [np.array(x, dtype=np.uint32) for x in self._ask(texts)]
        if len(self.sizes) > self.bound or len(self.ids) > 10 * self.bound:
            self._forget()
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        chunks = []
        for text in texts:
            if "  " in text:
                chunks.append(list(map(plain, _CUT.split(text))))
            else:
                first, *rest = text.split(" ")
                chunks.append([plain(first), *map(spaced, rest)])
        if self.queue:
            self._learn()
        out = []
        all_numbers = [np.array(numbers, dtype=np.int64) for numbers in chunks]
        if all_numbers:
            self.uses += np.bincount(np.concatenate(all_numbers), minlength=len(self.uses))
        for at in all_numbers:
            sizes = self.sizes[at]
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out.append(self.ids[np.repeat(self.starts[at], sizes) + within])
        return out


def encoder(spec: str, cache: int = CACHE_CHUNKS) -> Encoder:
    """One encoder per worker and tokenizer; ``cache`` bounds the chunks it remembers."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    _encoders[key].bound = cache
    return _encoders[key]


def tokenizer_spec(path: str) -> str:
    """The tokenizer file as text, read where the driver runs and sent to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()
