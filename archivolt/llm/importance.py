"""Importance resampling towards a target corpus, by hashed runs of words.

A feature is a run of 1 to ORDER consecutive words; its bucket is the CRC-32 of its bytes.  Each task keeps a trie of
words: a node is a path of words, and holds how often the path was walked and the CRC state that its bytes leave, so a
child's CRC goes on from its parent's and no feature is ever put together as a string.  A trie that has grown to
NODES paths adds its counts to its task's bucket totals and starts anew: totals are sums, so neither that nor how rows fell into
tasks changes them.  What leaves a task are its bucket totals, at most one row a bucket.

A bucket's gain compares its shares of the target and of the corpus.  In a second pass documents walk a trie whose
nodes carry their bucket's gain; a document's weight is the floored mean over its features.  Scores add a Gumbel term made of
the id alone, and the highest scores are drawn.  The score at which the quota is reached comes from counts by score; only rows from there
on are sorted, in ranges, and numbered by the ranges' counts: no task sees all rows, and rows that share score and id are split by row.

The driver gets bucket totals (BUCKETS rows), counts by score (scores are bounded by the buckets' gains and the Gumbel term, so tens
of thousands of rows whatever the input), and a count for each range.

Defined cases: a null text has no words, no features, weight 0; a null id counts as an empty string in the draw, as the smallest id among equal scores, and
comes out as null; rows that repeat an id are drawn row by row (equal rows have equal scores; which of them comes first means nothing); an empty
target or table gives gains that only smoothing decides; other columns are ignored; a text is walked in pieces, however long.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, cut, id_out, parts, plain

BUCKETS, ORDER, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
NODES, TEXT_BYTES, PIECE = 60_000, 1 << 18, 1 << 18
#: Words are letters and digits; A-Z becomes a-z, any other ASCII character parts words.
LETTERS = bytes(b if chr(b).isalnum() and b < 128 or b > 127 else 32 for b in range(256)).lower()


class Trie:
    """Paths of words. states: the CRC after each path; counts: how often it was walked; gains: its bucket's gain."""

    def __init__(self, order: int = ORDER, buckets: int = BUCKETS, gains: np.ndarray | None = None):
        self.order, self.buckets, self.bucket_gains = order, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.first: dict[bytes, int] = {}
        self.below: dict[int, int] = {}  # by parent and word
        self.words: list[bytes | None] = []
        self.states: list[int] = []
        self.spaced: list[int] = []  # the state after a space, of nodes that can have children
        self.counts, self.gains = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.told = 0

    def _add(self, states: list[int], words: list[bytes] | None, leaves: bool) -> range:
        at = range(len(self.states), len(self.states) + len(states))
        self.states += states
        self.words += words or [None] * len(states)
        self.spaced += [0] * len(states) if leaves else [zlib.crc32(b" ", x) for x in states]
        return at

    def _of_words(self, words: list[bytes]) -> np.ndarray:
        """Nodes of single words; new ones are made together."""
        got = list(map(self.first.get, words))
        if None in got:
            new = list(dict.fromkeys(w for w, n in zip(words, got, strict=True) if n is None))
            self.first.update(zip(new, self._add(list(map(zlib.crc32, new)), new, self.order == 1), strict=True))
            got = list(map(self.first.__getitem__, words))
        return np.array(got, np.int64)

    def _of_paths(self, keys: np.ndarray, leaves: bool) -> np.ndarray:
        """Nodes of longer paths, by distinct keys of parent and word: a new one's CRC goes on from its parent's state."""
        listed = keys.tolist()
        got = list(map(self.below.get, listed))
        if None in got:
            new = [k for k, n in zip(listed, got, strict=True) if n is None]
            words, spaced, crc = self.words, self.spaced, zlib.crc32
            self.below.update(zip(new, self._add([crc(words[k & 0xFFFFFFFF], spaced[k >> 32]) for k in new], None, leaves), strict=True))
            got = list(map(self.below.__getitem__, listed))
        return np.array(got, np.int64)

    def _grown(self) -> None:
        """Arrays reach as far as the nodes, and new nodes have their gains."""
        n = len(self.states)
        if n > len(self.counts):
            self.counts, self.gains = (np.concatenate([a, np.zeros(n, np.int64)]) for a in (self.counts, self.gains))
        if self.bucket_gains is not None and n > self.told:
            self.gains[self.told : n] = self.bucket_gains[np.array(self.states[self.told :], np.int64) % self.buckets]
        self.told = n

    def walk(self, pieces: list[tuple[list[bytes], int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: the piece of each path that ends in it, and the path's node. pieces: words, and how many of them are there only as
        context (a path that ends in context belongs to the piece before)."""
        lens = np.array([len(w) for w, _ in pieces], np.int64)
        context = np.array([c for _, c in pieces], np.int64)
        owner = np.repeat(np.arange(len(pieces)), lens)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)
        own = at >= context[owner]
        word = self._of_words(list(chain.from_iterable(w for w, _ in pieces)))
        path = word
        for k in range(1, self.order + 1):
            if k > 1:
                # the paths that end one word earlier, each with the next word; places where no such path ends hold junk
                keys = (path[:-1] << 32) | word[1:]
                fits = at[1:] >= k - 1
                distinct, back = np.unique(keys[fits], return_inverse=True)
                nodes = self._of_paths(distinct, k == self.order)
                path = np.zeros_like(word)
                path[1:][fits] = nodes[back]
            counted = own & (at >= k - 1)
            yield owner[counted], path[counted]

    def count(self, pieces: list[tuple[list[bytes], int]]) -> None:
        for _, nodes in self.walk(pieces):
            self._grown()
            n = np.bincount(nodes, minlength=1)
            self.counts[: len(n)] += n

    def totals(self) -> np.ndarray:
        """Counts by bucket."""
        self._grown()
        n = len(self.states)
        buckets = np.array(self.states, np.int64) % self.buckets
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, buckets, self.counts[:n])
        return out

    def summed(self, pieces: list[tuple[list[bytes], int]]) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's number of features, and the sum of their gains."""
        n, total = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for owner, nodes in self.walk(pieces):
            self._grown()
            n += np.bincount(owner, minlength=len(pieces))
            np.add.at(total, owner, self.gains[nodes])
        return n, total


def pieces_of(text: bytes, order: int) -> Iterator[tuple[list[bytes], int]]:
    """The text's words, about PIECE bytes at a time; later pieces begin with the last words of what came before, as context."""
    t = text.translate(LETTERS)
    if len(t) <= PIECE:
        yield t.split(), 0
        return
    lo, before = 0, []
    while lo < len(t):
        hi = t.find(b" ", lo + PIECE)
        hi = len(t) if hi < 0 else hi
        words = before + t[lo:hi].split()
        yield words, len(before)
        before = words[-(order - 1) :] if order > 1 else []
        lo = hi + 1


def blocks(texts: list[bytes], order: int) -> Iterator[tuple[list[int], list[tuple[list[bytes], int]]]]:
    """Pieces of texts, and the text of each, about a quarter of TEXT_BYTES words at a time."""
    owners, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        for words, context in pieces_of(t, order):
            owners.append(i)
            pieces.append((words, context))
            size += len(words)
            if size > TEXT_BYTES // 4:
                yield owners, pieces
                owners, pieces, size = [], [], 0
    if pieces:
        yield owners, pieces


def bucket_totals(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches):
        trie, out = Trie(order, buckets), np.zeros(buckets, np.int64)
        for _, texts in chunks(batches, TEXT_BYTES):
            for _, pieces in blocks(texts, order):
                trie.count(pieces)
            if len(trie.states) > NODES:
                out += trie.totals()
                trie.clear()
        out += trie.totals()
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out[some])], names=["bucket", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # one row a bucket
        out[r[0]] = r[1]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket thousandths of the log ratio of smoothed shares, floored."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * float(s_all + size) / ((s + 1.0) * float(t_all + size))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight: a row for each row of docs."""

    def run(batches):
        trie = Trie(order, len(gain), gain)
        for ids, texts in chunks(batches, TEXT_BYTES):
            words, features, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for owners, pieces in blocks(texts, order):
                n, s = trie.summed(pieces)
                np.add.at(features, owners, n)
                np.add.at(total, owners, s)
                np.add.at(words, owners, [len(w) - c for w, c in pieces])
            if len(trie.states) > NODES:
                trie.clear()
            mean = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(words), pa.array(features), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def drawn(rows: DataFrame, eligible: Column, percent: int, label: str) -> DataFrame:
    """rows (doc_id, score and others) with rank: 1, 2, ... for the percent of eligible rows of highest score, null for all others."""
    by_score = sorted((tuple(r) for r in rows.filter(eligible).groupBy("score").count().collect()), reverse=True)
    quota = percent * sum(n for _, n in by_score) // 100
    have, least = 0, None
    for score, n in by_score:
        if have >= quota:
            break
        have, least = have + n, score
    if least is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    near = eligible & (F.col("score") >= least)
    order = [F.desc("score"), F.col("doc_id"), F.col("row")]
    high = rows.filter(near).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    high = cut(high.withColumn("place", F.monotonically_increasing_id()).drop("row"), f"{label}-high")
    of = F.shiftright("place", 33)
    counts = {r[0]: r[1] for r in high.groupBy(of.alias("range")).count().collect()}
    before = dict(zip(sorted(counts), np.cumsum([0, *(counts[k] for k in sorted(counts))]).tolist(), strict=False))
    first = F.create_map(*[F.lit(int(x)) for kv in before.items() for x in kv])
    rank = F.try_element_at(first, of.cast("int")) + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    high = high.withColumn("rank", F.when(rank <= quota, rank).cast("long")).drop("place")
    return high.unionByName(rows.filter(~near).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, label: str = "op11") -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words. target: text."""
    docs = plain(docs)
    gain = gains(bucket_totals(docs, order, buckets), bucket_totals(target.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(target["text"].cast("string"), F.lit("")).alias("text")), order, buckets))
    named = F.coalesce(F.nullif("doc_id", F.lit(NULL_ID)).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), named), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = cut(weighted(docs, gain, order).withColumn("score", F.col("weight") + gumbel), f"{label}-scored")
    return drawn(rows, F.col("n_words") >= least_words, percent, label).select(id_out(), "n_features", "weight", "score", "rank", "n_words")
