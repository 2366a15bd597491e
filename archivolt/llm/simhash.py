"""Near-duplicate documents by SimHash.

A document's fingerprint has a bit for each of 64: set if more than half of the 64-bit hashes of its shingles have it (repeats count).
Two fingerprints are linked if they differ in DISTANCE bits or fewer.

Links are found between distinct fingerprints.  A fingerprint is embedded as the vector of the numbers of bits set in its SEGMENT-bit
segments; two fingerprints differ in at least as many bits as their vectors are apart (Manhattan).  The vector is cut into
DISTANCE // 2 + 1 parts, so in at least one part two linked fingerprints are at most 1 apart: a range join of reach 1 on the grid of each part's
vectors.  At reach 1 vectors are equal, or the sum of one is even and that of the other odd; so every fingerprint is sent to its own
cell, and those of odd sums also to the cells next to it (some dozen), where they meet those that live there.  Cells and neighbours are packed
in a 64-bit number by bit arithmetic; nothing but (part, cell, fingerprint) moves, and the join's condition compares all 64 bits: what
comes out are links.  A fingerprint's links are bounded by the geometry of 64 bits, however many copies it has: copies are one fingerprint.

Components are those of the fingerprints; documents get theirs by an equi-join, in which fingerprints that hold a thousandth of all rows or more (so a thousand of
them at most) are joined by broadcast instead of being dealt out by key.

Defined cases: a null or empty text has fingerprint 0 and is linked like any other; fewer words than SHINGLE are one shingle; a null id
counts as the smallest, and comes out as null; rows that repeat an id come out repeated, each with its own text's fingerprint;
other columns are ignored; an empty table gives an empty table; a text is hashed in pieces, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, cut, forget, id_out, joined_back, plain
from .components import components

SHINGLE, DISTANCE, SEGMENT, SEED = 3, 3, 2, 42
TEXT_BYTES, SHINGLES = 1 << 20, 1 << 17


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each run of k words, joined by a space."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    lo, hi = [0, *ends[:-k].tolist()], (ends[k - 1 :] - 1).tolist()
    return np.array([digest(text[i:j], SEED) for i, j in zip(lo, hi, strict=True)], np.uint64)


def fingerprints(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Of each text 64 bits, as a signed number."""
    out = np.zeros(len(texts), np.uint64)
    todo: list[tuple[int, np.ndarray]] = []
    bits = lambda h: np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    packed = lambda over: np.packbits(over, axis=1).view(">u8").ravel()

    def settle() -> None:
        if todo:
            lens = np.array([len(h) for _, h in todo])
            ones = np.add.reduceat(bits(np.concatenate([h for _, h in todo])), np.cumsum(lens) - lens, axis=0, dtype=np.int64)
            out[[i for i, _ in todo]] = packed(2 * ones > lens[:, None])
            todo.clear()

    size = 0
    for i, t in enumerate(texts):
        words = t.lower().split()
        if len(words) <= SHINGLES:
            if words:
                todo.append((i, shingle_hashes(words, k)))
                size += len(words)
            if size > SHINGLES:
                settle()
                size = 0
        else:
            pieces = [shingle_hashes(words[lo : lo + SHINGLES + k - 1], k) for lo in range(0, len(words) - k + 1, SHINGLES)]
            ones = sum(bits(h).sum(0, dtype=np.int64) for h in pieces)
            out[i] = packed((2 * ones > sum(map(len, pieces)))[None])[0]
    settle()
    return out.view(np.int64)


def printed(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, print: a row for each row of docs."""

    def run(batches):
        for ids, texts in chunks(batches, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fingerprints(texts, k))], names=["doc_id", "print"])

    return docs.mapInArrow(run, "doc_id long, print long")


def _long(x: int) -> Column:
    """The 64 bits of x as a signed number."""
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _every(pattern: int, width: int) -> int:
    return sum(pattern << i for i in range(0, 64, width))


def segment_counts(print_: Column, width: int) -> Column:
    """The numbers of bits set in each segment of width bits (2, 4 or 8), each in the place of its segment."""
    low, high = (F.shiftrightunsigned(print_, i).bitwiseAND(_long(_every(0b01, 2))) for i in (0, 1))
    x = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # their sum, without a carry into the sign
    if width >= 4:
        x = x.bitwiseAND(_long(_every(0x3, 4))) + F.shiftrightunsigned(x, 2).bitwiseAND(_long(_every(0x3, 4)))
    if width >= 8:
        x = (x + F.shiftrightunsigned(x, 4)).bitwiseAND(_long(_every(0x0F, 8)))
    return x


def masks(distance: int, width: int) -> list[int]:
    """Bits of each part of the vector: one part more than half the distance, of whole segments."""
    n, segments = distance // 2 + 1, 64 // width
    ends = [segments * i // n * width for i in range(n + 1)]
    return [((1 << hi) - 1) & ~((1 << lo) - 1) for lo, hi in zip(ends, ends[1:], strict=False)]


def _next_cells(cell: Column, mask: int, width: int) -> Column:
    """The cells that differ by 1 in one segment of a part."""
    top = (1 << width) - 1
    out = []
    for i in range(0, 64, width):
        if mask >> i & 1:
            own = F.shiftrightunsigned(cell, i).bitwiseAND(F.lit(top).cast("long"))
            changed = lambda step, i=i, own=own: cell.bitwiseXOR(F.shiftleft(own.bitwiseXOR(own + step), i))
            out += [F.when(own < width, changed(1)), F.when(own > 0, changed(-1))]
    return F.array_compact(F.array(*out))


def linked_prints(nodes: DataFrame, distance: int = DISTANCE, width: int = SEGMENT) -> DataFrame:
    """a, b: distinct fingerprints (nodes: print) that differ in distance bits or fewer, each pair once or more often."""
    home, reach = None, None
    for part, mask in enumerate(masks(distance, width)):
        cell = segment_counts(F.col("print"), width).bitwiseAND(_long(mask))
        odd = F.bit_count(F.col("print").bitwiseAND(_long(mask))) % 2 == 1
        own = nodes.select(F.lit(part).alias("part"), cell.alias("cell"), F.col("print"))
        near = nodes.filter(odd).select(F.lit(part).alias("part"), F.explode(_next_cells(cell, mask, width)).alias("cell"), F.col("print"))
        sent = own.withColumn("next", F.lit(False)).unionByName(near.withColumn("next", F.lit(True)))
        home, reach = (own, sent) if home is None else (home.unionByName(own), reach.unionByName(sent))
    x, y = home.select("part", "cell", F.col("print").alias("a")), reach.select("part", "cell", F.col("print").alias("b"), "next")
    # whoever is sent to a next cell meets only those of other sums; in its own cell a pair meets twice, and counts once
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = x.hint("merge").join(y, (x["part"] == y["part"]) & (x["cell"] == y["cell"]) & close & (F.col("next") | (F.col("a") < F.col("b"))))
    return pairs.select("a", "b")


def simhash_dedup(docs: DataFrame, k: int = SHINGLE, distance: int = DISTANCE, width: int = SEGMENT, label: str = "op13") -> DataFrame:
    """doc_id, fingerprint, component_id, kept."""
    every = cut(printed(plain(docs), k), f"{label}-prints")
    nodes = cut(every.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")), f"{label}-nodes")
    links = cut(linked_prints(nodes, distance, width).distinct(), f"{label}-links")
    found = components(links, f"{label}-stars").withColumnRenamed("node", "print")
    placed = nodes.join(found, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = cut(placed.join(least, "component").select("print", "size", "component_id"), f"{label}-groups", (links,))
    out = joined_back(every, groups, "print")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return out.select(id_out(), digits.alias("fingerprint"), F.nullif("component_id", F.lit(NULL_ID)).alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))
