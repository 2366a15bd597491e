"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences.  Seeds, the hashes of SEED consecutive words, join the two:

1. the items' seeds are a table; a bit set of FILTER_BITS bits, of the same size for any benchmark, goes to the scan of the documents, which
   emits the seeds that may be an item's;
2. these are joined with the items' seeds: pairs of a text and an item that share one;
3. each pair is tiled.  For falling lengths, running Karp-Rabin hashes find the matches of that length or more
   among the words not marked yet, and the longest are marked first; what an earlier tile cuts off comes again with its own length;
4. of each text the item that it covers most; a text that covers enough of an item's words by its tiles, in whatever order they
   stand, is contaminated.

What is found depends on the text alone, so texts (by two 64-bit hashes) are what moves, and equal ones are tiled once.

Defined cases: null and empty texts match nothing; an item of fewer than SEED words is looked for as a
whole; items without words match nothing; items that repeat id and text count once, and different texts that share an id (null too) are items of
their own; a null doc_id stays null; rows that repeat an id come out each, judged by its own text; ties between items go to the smallest
item_id; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, cut, id_out, mix, plain, spread
from .substring_dedup import Hashes

SEED, THRESHOLD, TEXT_BYTES, CACHE, FILTER_BITS, PAIRS = 5, 0.5, 1 << 20, 150_000, 1 << 25, 1 << 20
BASE = 0x9E3779B97F4A7C15
TEXT = [("t1", "<i8"), ("t2", "<i8")]
KNOWN = Hashes()


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


class Running:
    """Karp-Rabin hashes of stretches of any length, from one running sum."""

    def __init__(self, ids: np.ndarray):
        steps = np.full((2, len(ids) + 1), [[BASE], [pow(BASE, -1, 2**64)]], np.uint64)
        steps[:, 0] = 1
        power, self.back = np.cumprod(steps, axis=1)
        self.sum = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix((ids + 2).astype(np.uint64) * np.uint64(BASE)) * power[:-1], out=self.sum[1:])

    def at(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sum[start + size] - self.sum[start]) * self.back[start]


class Tiling:
    """Two sequences of word numbers (-1 matches nothing) and which of their words are not marked yet."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.free_a, self.free_b = a, b, a >= 0, b >= 0
        self.hash_a, self.hash_b = Running(a), Running(b)

    @staticmethod
    def room(free: np.ndarray) -> np.ndarray:
        """How many free words follow each other from each place on."""
        busy = np.flatnonzero(np.append(~free, True))
        return busy[np.searchsorted(busy, np.arange(len(free)))] - np.arange(len(free))

    def matches(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts in a and b and lengths of the maximal free matches of at least size words: the longest first, then the first in a, then in b."""
        room_a, room_b = self.room(self.free_a), self.room(self.free_b)
        at_a, at_b = np.flatnonzero(room_a >= size), np.flatnonzero(room_b >= size)
        # places of one hash by the word before, as a match that the words before prolong starts earlier
        span = int(max(self.a.max(initial=0), self.b.max(initial=0))) + 3
        before = lambda ids, free, at, none: np.where((at > 0) & free[at - 1], ids[at - 1] + 2, none)
        classes, of_b = np.unique(self.hash_b.at(at_b, size), return_inverse=True)
        key = of_b.ravel() * span + before(self.b, self.free_b, at_b, 0)
        order = np.argsort(key, kind="stable")
        at_b, key = at_b[order], key[order]
        own = self.hash_a.at(at_a, size)
        of_a = np.searchsorted(classes, own)
        hit = of_a < len(classes)
        hit[hit] = classes[of_a[hit]] == own[hit]
        at_a, of_a = at_a[hit], of_a[hit]
        same = of_a * span + before(self.a, self.free_a, at_a, 1)
        ranges = [(np.searchsorted(key, of_a * span), np.searchsorted(key, same)), (np.searchsorted(key, same, "right"), np.searchsorted(key, (of_a + 1) * span))]
        found = [(np.zeros(0, np.int64),) * 3]
        for lo, hi in ranges:
            ends, begin = np.cumsum(hi - lo), 0
            while begin < len(at_a):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
                many = (hi - lo)[begin:stop]
                i, j = np.repeat(at_a[begin:stop], many), at_b[np.repeat(lo[begin:stop], many) + spread(many)]
                begin = stop
                found.append((i, j, self.common(i, j, np.minimum(room_a[i], room_b[j]))))
        i, j, n = (np.concatenate(x) for x in zip(*found, strict=True))
        i, j, n = i[n >= size], j[n >= size], n[n >= size]
        order = np.lexsort((j, i, -n))
        return i[order], j[order], n[order]

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The longest common prefixes from i and j on, by their hashes."""
        out, step = np.zeros(len(i), np.int64), 1 << int(most.max(initial=0)).bit_length()
        while step:
            fits = np.flatnonzero(out + step <= most)
            same = self.hash_a.at(i[fits], out[fits] + step) == self.hash_b.at(j[fits], out[fits] + step)
            out[fits[same]] += step
            step //= 2
        return out

    def mark(self, size: int) -> list[tuple[int, int, int]]:
        """Tiles of at least size words, as long as there are any."""
        i, j, n = self.matches(size)
        tiles, cut_off, k, open_ = [], [], 0, True
        while open_ and (k < len(i) or cut_off):
            if cut_off and (k == len(i) or cut_off[0] < (-n[k], i[k], j[k])):
                m, x, y = heapq.heappop(cut_off)
                m = -m
            else:
                m, x, y = int(n[k]), int(i[k]), int(j[k])
                k += 1
            free = self.free_a[x : x + m] & self.free_b[y : y + m] & (self.a[x : x + m] == self.b[y : y + m])
            if free.all():
                self.free_a[x : x + m] = self.free_b[y : y + m] = False
                tiles.append((x, y, m))
                open_ = self.room(self.free_b).max(initial=0) >= size
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).view(np.int8))).tolist()
            for s, e in zip(edge[::2], edge[1::2], strict=True):
                if e - s >= size:
                    heapq.heappush(cut_off, (s - e, x + s, y + s))
        return tiles


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, length), the longest first; of equal length the first in a, then in b."""
    size, tiles = min(len(a), len(b)), []
    if size < least:
        return tiles
    state = Tiling(a, b)
    while True:
        tiles += state.mark(size)
        if size == least or state.room(state.free_b).max(initial=0) < least:
            return tiles
        size = max(least, size // 2)


def seeds(texts: list[bytes], lengths: list[int], whole: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of so many consecutive words, and which text each is of. whole: texts of fewer words have one seed, all their words."""
    if len(KNOWN) > CACHE:
        KNOWN.clear()
    split = [words(t) for t in texts]
    lens = np.array([len(w) for w in split], np.int64)
    v = np.fromiter((KNOWN[w] for own in split for w in own), np.uint64, int(lens.sum()))
    owner, left = np.repeat(np.arange(len(texts)), lens), np.repeat(np.cumsum(lens), lens) - np.arange(len(v))
    out = []
    for n in lengths:
        h = np.full(max(0, len(v) - n + 1), n, np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(BASE) + v[i : i + len(h)])
        at = np.flatnonzero((left[: len(h)] >= n) & ((lens[owner[: len(h)]] == n) if whole and n < whole else True))
        out.append((h[at], owner[at]))
    h, owner = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return h.view(np.int64), owner


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def with_text_key(docs: DataFrame, t1: str = "t1", t2: str = "t2") -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn(t1, F.xxhash64(text)).withColumn(t2, F.xxhash64(F.lit(1), text))


def covered(docs: DataFrame, benchmark: DataFrame, seed: int, block_bytes: int, label: str) -> DataFrame:
    """t1, t2, item_id, coverage, n_covered, n_tiles: of each text that shares a tile with an item, the item that it covers most."""
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("long"), F.lit(NULL_ID)).alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("item")).distinct()
    items = cut(items.withColumn("number", F.monotonically_increasing_id()), f"{label}-items")

    def of_items(batches):
        for number, texts in chunks(batches, block_bytes):
            h, owner = distinct(*seeds(texts, list(range(1, seed + 1)), seed))
            size = np.array([len(words(t)) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(number[owner]), pa.array(np.minimum(size[owner], seed), pa.int32())], names=["seed", "number", "size"])

    known = cut(items.select("number", "item").mapInArrow(of_items, "seed long, number long, size int"), f"{label}-seeds")
    slot = F.pmod("seed", F.lit(FILTER_BITS))
    bits = known.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in bits:
        table[r[0]] = r[1]
    lengths = sorted(r[0] for r in known.select("size").distinct().collect())
    table = table.view(np.uint8)

    def of_docs(batches):
        for keys, texts in chunks(batches, block_bytes, TEXT):
            h, owner = seeds(texts, lengths)
            at = h.view(np.uint64) % np.uint64(FILTER_BITS)  # a power of two: pmod of the signed number too
            hit = (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            h, owner = distinct(h[hit], owner[hit])
            yield pa.RecordBatch.from_arrays([pa.array(keys["t1"][owner]), pa.array(keys["t2"][owner]), pa.array(h)], names=["t1", "t2", "seed"])
        KNOWN.clear()  # the worker may go on to other tasks

    texts = with_text_key(plain(docs)).select("t1", "t2", "text")
    hits = texts.mapInArrow(of_docs, "t1 long, t2 long, seed long")
    pairs = cut(hits.join(known.select("seed", "number"), "seed").select("t1", "t2", "number").distinct(), f"{label}-pairs", (known,))
    met = texts.join(pairs.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])

    def tiled(batches):
        for batch in batches:
            rows = []
            for t1, t2, item_id, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                numbers: dict[bytes, int] = {}
                b = np.array([numbers.setdefault(w, len(numbers)) for w in words(item.encode())], np.int64)
                own = words(text.encode())
                a = np.fromiter((numbers.get(w, -1) for w in own), np.int64, len(own))
                tiles = tile(a, b, min(seed, len(b)))
                n = sum(x[2] for x in tiles)
                if n:
                    rows.append((t1, t2, item_id, n / len(b), n, len(tiles)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["t1", "t2", "item_id", "coverage", "n_covered", "n_tiles"])

    both = pairs.join(items, "number").join(met, ["t1", "t2"]).select("t1", "t2", "item_id", "item", "text")
    each = both.mapInArrow(tiled, "t1 long, t2 long, item_id long, coverage double, n_covered long, n_tiles long")
    best = F.max(F.struct("coverage", F.bitwise_not("item_id").alias("order"), "n_covered", "n_tiles")).alias("b")
    each = each.groupBy("t1", "t2").agg(best)
    return cut(each.select("t1", "t2", F.bitwise_not("b.order").alias("item_id"), F.round("b.coverage", 6).alias("coverage"), "b.n_covered", "b.n_tiles"), f"{label}-covered", (pairs, items))


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD, block_bytes: int = TEXT_BYTES) -> DataFrame:
    """doc_id, item_id (the item covered most, null if none is), coverage, n_covered, n_tiles, contaminated. block_bytes: so much text is hashed at a time."""
    found = covered(docs, benchmark, seed, block_bytes, "op10")
    out = with_text_key(plain(docs)).select("doc_id", "t1", "t2").join(found, ["t1", "t2"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    coverage = F.coalesce("coverage", F.lit(0.0))
    return out.select(id_out(), F.nullif("item_id", F.lit(NULL_ID)).alias("item_id"), coverage.alias("coverage"), none("n_covered").alias("n_covered"), none("n_tiles").alias("n_tiles"), (coverage >= threshold).alias("contaminated"))


def decontamination_filter(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD, block_bytes: int = TEXT_BYTES) -> DataFrame:
    """The rows of docs that decontaminate() doesn't call contaminated, all columns."""
    t1, t2 = (next(n for i in range(99) if (n := f"{x}_{i}") not in docs.columns) for x in ("t1", "t2"))
    bad = covered(docs, benchmark, seed, block_bytes, "filter10").filter(F.col("coverage") >= threshold).select(F.col("t1").alias(t1), F.col("t2").alias(t2))
    return with_text_key(docs, t1, t2).join(bad, [t1, t2], "left_anti").select(*[f"`{c}`" for c in docs.columns])
