"""Substring dedup of bytes by suffix arrays, built by two-stage sorting.

Each byte that lies in a string of WINDOW bytes that also starts earlier is removed.  repeats.py brings
together what may be equal; in a bucket, the texts of the fragments that differ are laid end to end and their suffix array
is built: suffixes smaller than their successors are sorted directly, on as many bytes as matter; the others
follow from those by one scan over the buckets of first bytes; then the common prefixes of
neighbours are computed, and suffixes linked by prefixes of WINDOW bytes are one string.

Defined cases: null and empty texts have no bytes; texts of fewer than WINDOW bytes lose none; equal strings in one
document count by their starts, overlapping ones too; a null doc_id counts as the smallest and comes out as null;
rows that repeat an id and a text are one document and come out alike; different texts that share an id (null too) are documents of their own, each
judged by itself, in the order of their hashes; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_out, mix
from .repeats import PLACE, covered, keyed, repeated_runs, same_place, spread, windows_of, with_runs

WINDOW, GRAM = 100, 32
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def big_words(t: np.ndarray, pad: int) -> np.ndarray:
    """At each place the next eight bytes as a number, zeros after the end."""
    x = np.concatenate([t, np.zeros(pad + 8, np.uint8)]).astype(np.uint64)
    span = 1
    while span < 8:
        x[:-span] = (x[:-span] << np.uint64(8 * span)) | x[span:]
        span *= 2
    return x


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than its successor; the last isn't."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    step[-1] = -1
    told = np.flatnonzero(step)
    return step[told[np.searchsorted(told, np.arange(n))]] > 0


def sorted_directly(at: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that start at `at`, ordered by their first depth bytes at least; equal ones by start."""
    key = w[at]
    order = at[np.argsort(key, kind="stable")]
    key = w[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    for done in range(8, depth, 8):
        alone = new & np.append(new[1:], True)
        rest = np.flatnonzero(~alone)
        if not len(rest):
            break
        group, own = np.cumsum(new)[rest], order[rest]
        key = w[np.minimum(own + done, len(w) - 1)]
        by = np.lexsort((key, group))
        order[rest], key = own[by], key[by]
        split = np.ones(len(rest), bool)
        split[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        new[rest] = split
    return order


def suffix_array(t: np.ndarray, depth: int, w: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of t (bytes) in order; those that agree on depth bytes are in any order."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    w = big_words(t, depth) if w is None else w
    small = smaller_than_next(t)
    direct = sorted_directly(np.flatnonzero(small), w, depth)
    ends = np.cumsum(np.bincount(t[direct], minlength=256))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[-1]].append(np.array([n - 1]))
    out = []

    def deal(found: np.ndarray, c: int) -> np.ndarray:
        """Predecessors larger than the suffixes found go to their buckets; those of bucket c itself come back."""
        before = found[found > 0] - 1
        before = before[~small[before] & (t[before] >= c)]
        byte = t[before]
        mine = before[byte == c]
        other, byte = before[byte > c], byte[byte > c]
        if len(other):
            order = np.argsort(byte, kind="stable")
            other, many = other[order], np.bincount(byte, minlength=256)
            stops = np.cumsum(many)
            for b in np.flatnonzero(many).tolist():
                induced[b].append(other[stops[b] - many[b] : stops[b]])
        return mine

    for c in range(256):
        level = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(level):
            out.append(level)
            level = deal(level, c)
        own = direct[ends[c - 1] if c else 0 : ends[c]]
        if len(own):
            out.append(own)
            deal(own, c)
    return np.concatenate(out)


def common_prefixes(sa: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order, the bytes it shares with the one before it, most at most."""
    out = np.zeros(len(sa), np.int64)
    at = np.arange(1, len(sa))
    for done in range(0, most, 8):
        if not len(at):
            break
        x = w[np.minimum(sa[at] + done, len(w) - 1)] ^ w[np.minimum(sa[at - 1] + done, len(w) - 1)]
        same = sum((x >> np.uint64(64 - 8 * i)) == 0 for i in range(1, 8)) + (x == 0)
        out[at] += same
        at = at[x == 0]
    return np.minimum(out, most)


def match(pieces: np.ndarray, raws: list[bytes], n: int = WINDOW) -> np.ndarray:
    """The repeated windows among the pieces."""
    t = np.frombuffer(b"".join(raws), np.uint8)
    w = big_words(t, n)
    sa = suffix_array(t, n, w)
    string = np.cumsum(common_prefixes(sa, w, n) < n)
    cnt = pieces["cnt"].astype(np.int64)
    start = np.cumsum(pieces["size"], dtype=np.int64) - pieces["size"]
    cls = np.empty(len(t), np.int64)
    cls[sa] = string
    own = np.repeat(np.arange(len(pieces)), cnt)
    at = spread(cnt)
    cls = cls[start[own] + at]
    keep = np.bincount(cls)[cls] > 1
    cls, x = cls[keep], windows_of(pieces, own[keep], at[keep])
    order = np.lexsort((*(x[c] for c, _ in PLACE[::-1]), cls))
    cls, x = cls[order], x[order]
    new = np.ones(len(cls), bool)
    new[1:] = cls[1:] != cls[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(cls) else np.zeros(0, np.int64)
    return x[~same_place(x, x[head])]


def same_bytes(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes of t from places a on are those from places b on."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), 8192):
        part = slice(lo, lo + 8192)
        step = spread(size[part])
        other = t[np.repeat(a[part], size[part]) + step] != t[np.repeat(b[part], size[part]) + step]
        if len(other):
            out[part] = np.add.reduceat(other, np.cumsum(size[part]) - size[part], dtype=np.int64) == 0
    return out


def byte_symbols(texts: list[bytes]):
    t = np.frombuffer(b"".join(texts), np.uint8)
    return VALUES[t], np.array([len(x) for x in texts], np.int64), lambda a, b, size: same_bytes(t, a, b, size)


def byte_content(texts: list[bytes], own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, np.ndarray]:
    out = [texts[t][a:b] for t, a, b in zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True)]
    return b"".join(out), (hi - lo).astype(np.int32)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = keyed(docs)
    found = repeated_runs(docs, byte_symbols, byte_content, match, WINDOW, GRAM, "op1")

    def finish(batches):
        for batch in batches:
            rows = []
            for i, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                lo, hi = covered(own, WINDOW, len(raw))
                kept, at = hashlib.sha256(), 0
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((i, len(raw), int((hi - lo).sum()), len(lo), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = with_runs(docs, found).mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", id_out())
