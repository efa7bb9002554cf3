"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

Texts are split into words by the vocabulary's public pattern; every distinct
word of a batch is encoded once. Speculate and verify: greedy longest match
proposes tokens for a word, and two neighbours are compatible if encoding their
joined bytes by exact merging gives the same two tokens. A word whose
neighbours are all compatible is encoded exactly; only the others are merged
rank by rank.

Defined cases: null and empty texts have the empty list of ids; the strings of
special tokens are ordinary text; no special tokens are added.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.shared import Shared

#: Where the public vocabularies lie.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that a worker keeps; beyond that it starts afresh. Words above so many characters aren't kept.
KEEP_WORDS, KEEP_CHARS = 400_000, 64


class ByteBpe:
    def __init__(self, rank_file: bytes):
        lines = (x.split() for x in rank_file.splitlines() if x)
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def exact(self, word: bytes) -> list[int]:
        """Merges the neighbours of least rank, again and again."""
        ranks = self.ranks
        if len(word) > 200:
            return self._exact_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _exact_long(self, word: bytes) -> list[int]:
        """The same by a heap and linked neighbours, so that one huge word takes n log n."""
        import heapq

        ranks, n = self.ranks, len(word)
        part = [word[i : i + 1] for i in range(n)]
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or part[i] + part[j] != joined:
                continue
            part[i], alive[j], nxt[i] = joined, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b < n and (r := ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, part[a] + part[b]))
        return [ranks[part[i]] for i in range(n) if alive[i]]

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, ranks = [], 0, len(word), self.ranks
        while i < n:
            j = min(n, i + self.longest)
            while (r := ranks.get(word[i:j])) is None:
                j -= 1
            out.append(r)
            i = j
        return out

    def learn(self, words: list[str]) -> list[tuple[int, ...]]:
        """The tokens of distinct words: speculation, checks of all neighbours at once, exact merging of the failures."""
        raw = [w.encode("utf-8", "replace") for w in words]
        got: list = [None] * len(raw)
        guess, at = [], []
        for k, b in enumerate(raw):
            if (r := self.ranks.get(b)) is not None:
                got[k] = (r,)
            else:
                guess.append(self.greedy(b))
                at.append(k)
        if guess:
            n = np.fromiter(map(len, guess), np.int64, len(guess))
            flat = np.fromiter(chain.from_iterable(guess), np.int64, int(n.sum()))
            ends = np.cumsum(n)
            inner = np.ones(len(flat), np.bool_)
            inner[ends - 1] = False  # the last token of a word has no right neighbour
            left = np.flatnonzero(inner)
            code = flat[left] << 20 | flat[left + 1] if len(left) else left
            distinct, back = np.unique(code, return_inverse=True)
            if len(self.pairs) > 4 * KEEP_WORDS:
                self.pairs.clear()
            fits = np.fromiter((self._fits(int(c)) for c in distinct), np.bool_, len(distinct))
            bad = np.zeros(len(guess), np.bool_)
            bad[np.searchsorted(ends, left[~fits[back]], side="right")] = True
            for k, g, b in zip(at, guess, bad):
                got[k] = tuple(self.exact(raw[k])) if b else tuple(g)
        return got

    def _fits(self, code: int) -> bool:
        if (known := self.pairs.get(code)) is None:
            a, b = code >> 20, code & 0xFFFFF
            known = self.pairs[code] = self.exact(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split, known = self.split, self.words
        parts = [split(t) if t else [] for t in texts]
        if len(known) > KEEP_WORDS:
            known.clear()
        new = list(set().union(*parts).difference(known))
        if new:
            known.update(zip(new, self.learn(new)))
        look = known.__getitem__
        out = [list(chain.from_iterable(map(look, p))) for p in parts]
        for w in new:
            if len(w) > KEEP_CHARS:
                del known[w]
        return out


_LOADED: dict[str, ByteBpe] = {}


def _tokenizer(ranks: Shared) -> ByteBpe:
    """One tokenizer, with its known words, for each worker process."""
    if ranks.name not in _LOADED:
        _LOADED.clear()
        _LOADED[ranks.name] = ByteBpe(ranks.value)
    return _LOADED[ranks.name]


def _vocabulary(spark: SparkSession, name: str, folder: str | None) -> Shared:
    with open(os.path.join(folder or VOCABULARIES, f"{name}.tiktoken"), "rb") as f:
        return Shared(spark, f.read())  # under 1 MB, read once on the driver


#: Texts that are split at a time, to bound a worker's memory.
STEP = 256


def _encoded(column, ranks: Shared) -> Iterator[list[list[int]]]:
    bpe = _tokenizer(ranks)
    for s in range(0, len(column), STEP):
        yield bpe.encode_batch(column.slice(s, STEP).to_pylist())


def ids(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    ranks = _vocabulary(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = 0
            for got in _encoded(b.column(1), ranks):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, STEP), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                s += STEP

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def sizes(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): the number of tokens of every text."""
    ranks = _vocabulary(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x) for got in _encoded(b.column(1), ranks) for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def vocabulary_use(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(token_id, n): how often every used token occurs in the corpus."""
    return ids(documents, name, folder).select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
