"""Substring dedup of words by relative Lempel-Ziv parsing.

Each word that lies in a window of WINDOW words that also starts earlier is removed.  repeats.py cuts the corpus into
reference blocks, so that whatever may equal a fragment is in its block; each fragment is then
factored greedily against its block: at a place where a window of the block starts with the same words, the
longest match with the earliest such place is a factor.  Windows inside a factor are repeated; those that cross
its end are looked up one by one, since a longer greedy factor may hide their match.

Defined cases: as in suffix_dedup.py, with words for bytes; texts without words come out with none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import id_out
from .repeats import RUN, covered, keyed, repeated_runs, spread, windows_of, with_runs

WINDOW, GRAM, CACHE = 20, 8, 200_000


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


CACHED = Hashes()


def word_symbols(texts: list[bytes]):
    if len(CACHED) > CACHE:
        CACHED.clear()
    words = [t.split() for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    every = [x for w in words for x in w]
    v = np.fromiter(map(CACHED.__getitem__, every), np.uint64, len(every))

    def same(a, b, size):
        return np.array([every[i : i + n] == every[j : j + n] for i, j, n in zip(a.tolist(), b.tolist(), size.tolist(), strict=True)], bool)

    return v, lens, same


def word_content(texts: list[bytes], own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, np.ndarray]:
    split: dict[int, list[bytes]] = {}
    out = []
    for t, a, b in zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True):
        words = split.get(t)
        if words is None:
            words = split[t] = texts[t].split()
        out.append(b" ".join(words[a:b]))
    return b"".join(out), np.fromiter(map(len, out), np.int32, len(out))


class Block:
    """A reference block: fragments in order of their places, indexed by the words of each window."""

    def __init__(self, n: int):
        self.n, self.parts, self.index = n, [], {}

    def add(self, words: list[bytes], windows: int) -> None:
        """Index the first so many windows of a fragment; of equal windows the earliest stays."""
        part = len(self.parts)
        self.parts.append(words)
        for i in range(windows):
            self.index.setdefault(tuple(words[i : i + self.n]), (part, i))

    def source(self, words: list[bytes], i: int) -> tuple[int, int] | None:
        return self.index.get(tuple(words[i : i + self.n]))

    def factors(self, words: list[bytes], windows: int):
        """(start, length, source) greedily; windows that cross a factor's end are looked up next."""
        i = 0
        while i < windows:
            at = self.source(words, i)
            if at is None:
                i += 1
                continue
            other, j = self.parts[at[0]], at[1]
            length, most = self.n, min(len(words) - i, len(other) - j)
            while length < most and words[i + length] == other[j + length]:
                length += 1
            yield i, length, at
            i += length - self.n + 1


def match(pieces: np.ndarray, raws: list[bytes], n: int = WINDOW) -> np.ndarray:
    """pieces come ordered by anchor, then place; a block for each anchor."""
    own, places, many, block, last = [], [], [], Block(n), None
    for k, (q, cnt, raw) in enumerate(zip(pieces["q"].tolist(), pieces["cnt"].tolist(), raws, strict=True)):
        if q != last:
            block, last = Block(n), q
        words = raw.split(b" ")
        for i, length, _ in block.factors(words, cnt):
            own.append(k)
            places.append(i)
            many.append(min(cnt, i + length - n + 1) - i)
        block.add(words, cnt)
    if not own:
        return np.zeros(0, RUN)
    many = np.array(many, np.int64)
    return windows_of(pieces, np.repeat(own, many), np.repeat(places, many) + spread(many))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans."""
    docs = keyed(docs)
    found = repeated_runs(docs, word_symbols, word_content, match, WINDOW, GRAM, "op7")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())

    def finish(batches):
        for batch in batches:
            rows = []
            for i, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                lo, hi = covered(own, WINDOW, len(words))
                kept, at = [], 0
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), len(lo)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans"])

    out = with_runs(docs, found).mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long")
    return out.withColumn("doc_id", id_out())
