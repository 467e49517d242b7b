"""Encoding of whole texts with a public byte-level BPE: speculate and verify.

Method. A text is cut into words by the tokenizer's own pattern; each new word
is encoded once and its ids kept. Greedy longest match proposes the tokens of
a word. A sequence of tokens is what merging would give exactly if every
adjacent pair is compatible, that is, if no merge across their border comes
before the merges that built the two sides. All adjacent pairs of all new
words of a batch are tested at once in numpy; only words with a failing pair
are merged step by step.

Defined results
* empty text -> empty list; null text -> ``null_ids`` (empty list by default).
* strings that look like special tokens are ordinary text.
* unpaired surrogates can't occur: texts are UTF-8.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT = "byte_bpe_50k.json"
DEFAULT_DIR = "/opt/tokenizers"
# Fixed value: the pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = DEFAULT, folder: str = DEFAULT_DIR) -> str:
    return os.path.join(folder, name)


def _byte_of() -> dict[str, int]:
    """Character of the vocabulary files -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """A vocabulary with its merges and the words encoded so far."""

    def __init__(self, path: str, most_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of()
        raw = {t: bytes(byte[c] for c in t) for t in model["vocab"] if all(c in byte for c in t)}
        self.id_of = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        n = max(model["vocab"].values()) + 1
        self.base = np.zeros(256, np.int64)
        for b in range(256):
            self.base[b] = self.id_of[bytes([b])]
        left, right, rank = np.arange(n), np.arange(n), np.full(n, -1)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            pairs[(x, y)] = (r, z)
            if rank[z] < 0:
                left[z], right[z], rank[z] = x, y, r
        self.pairs, self.left, self.right, self.rank = pairs, left, right, rank
        keys = np.array([x << 32 | y for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([r for r, _ in pairs.values()], np.int64)[order]
        self.longest = max(map(len, self.id_of))
        self.most_words = most_words
        self.cut = regex.compile(PATTERN)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.sizes: list[int] = []

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids = [], 0, len(word), self.id_of
        if word in ids:
            return [ids[word]]
        while at < n:
            end = min(n, at + self.longest)
            while word[at:end] not in ids:
                end -= 1
            out.append(ids[word[at:end]])
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of adjacent tokens, whether merging would keep the border between them.

        Both sides are taken apart along the border, the later merge first; a
        merge over the border that comes before the merge just taken apart
        would have happened instead.
        """
        a, b = a.copy(), b.copy()
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            over = np.where(self.keys[at] == key, self.key_rank[at], np.iinfo(np.int64).max)
            # of equal ranks the leftmost merge comes first: a token's own last merge lies left of the border on side a
            bad = over < limit[live]
            ok[live[bad]] = False
            ra, rb = self.rank[x], self.rank[y]
            take_a = ra > rb
            done = (ra < 0) & (rb < 0)
            go = ~bad & ~done
            la = live[go & take_a]
            limit[la] = self.rank[a[la]]
            a[la] = self.right[a[la]]
            lb = live[go & ~take_a]
            limit[lb] = self.rank[b[lb]] + 1
            b[lb] = self.left[b[lb]]
            live = live[go]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, for words whose proposal failed: a queue of merges over linked pieces."""
        import heapq

        piece = self.base[np.frombuffer(word, np.uint8)].tolist()
        n = len(piece)
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        queue = []
        for i in range(n - 1):
            if (p := self.pairs.get((piece[i], piece[i + 1]))) is not None:
                queue.append((p[0], i, piece[i], piece[i + 1], p[1]))
        heapq.heapify(queue)
        while queue:
            _, i, x, y, z = heapq.heappop(queue)
            j = after[i] if not dead[i] else n
            if dead[i] or j >= n or piece[i] != x or piece[j] != y:
                continue
            piece[i], dead[j] = z, True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (p := self.pairs.get((piece[left], piece[after[left]]))) is not None:
                    heapq.heappush(queue, (p[0], left, piece[left], piece[after[left]], p[1]))
        return [p for p, d in zip(piece, dead, strict=True) if not d]

    def learn(self, words: list[str]) -> None:
        """Encode words that weren't met before."""
        new = [w.encode("utf-8") for w in words]
        proposed = [self.propose(w) for w in new]
        sizes = np.array([len(p) for p in proposed])
        flat = np.array([t for p in proposed for t in p], np.int64)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(new)), sizes)
            inner = owner[1:] == owner[:-1]
            bad = inner.copy()
            bad[inner] = ~self.compatible(flat[:-1][inner], flat[1:][inner])
            for i in np.unique(owner[1:][bad]).tolist():
                proposed[i] = self.merge(new[i])
        for w, p in zip(words, proposed, strict=True):
            self.index[w] = len(self.sizes)
            self.flat.append(np.array(p, np.int32))
            self.sizes.append(len(p))

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.index) > self.most_words:
            self._forget()
        words: list[str] = []
        counts = []
        for t in texts:
            n = len(words)
            if t:
                words += self.cut.findall(t)
            counts.append(len(words) - n)
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            self.learn(new)
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        sizes = np.array(self.sizes, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        all_ids = np.concatenate(self.flat) if self.flat else np.zeros(0, np.int32)
        n = sizes[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(starts[at] - (ends - n), n) if total else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        upto = np.concatenate([[0], ends])
        return all_ids[source], upto[bounds[1:]] - upto[bounds[:-1]]


_KEPT: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The vocabulary, read once for each worker process."""
    if path not in _KEPT:
        _KEPT[path] = Bpe(path)
    return _KEPT[path]


BLOCK = 1_500_000


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``BLOCK`` characters: bounds the memory whatever the texts' lengths."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size > BLOCK:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode(df: DataFrame, text: str = "text", path: str | None = None, null_ids: Sequence[int] | None = ()) -> DataFrame:
    """``df`` with ``ids`` (array of int). Narrow: one scan, no shuffle."""
    file = path or vocabulary_path()
    null = None if null_ids is None else list(null_ids)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def udf(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        b = bpe(file)
        for texts in it:
            parts = []
            for block in _blocks(texts.to_pylist()):
                ids, sizes = b.encode(block)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return df.withColumn("ids", F.when(F.col(text).isNull(), F.lit(null).cast("array<int>")).otherwise(udf(F.col(text))))


def token_counts(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with ``n_tokens``; null and empty texts have 0."""
    file = path or vocabulary_path()

    @F.arrow_udf(T.LongType())
    def udf(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        b = bpe(file)
        for texts in it:
            sizes = [b.encode(block)[1] for block in _blocks(texts.to_pylist())]
            yield pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())

    return df.withColumn("n_tokens", udf(F.col(text)))
