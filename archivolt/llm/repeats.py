"""Which windows of n consecutive symbols (bytes, words) occur earlier, over all documents.

No window moves by itself.  Of the grams of k symbols in a window, the one of least hash is its anchor (the
leftmost of equals), so equal windows have equal anchors at equal distances.  The consecutive windows of one
anchor are a fragment: about two fragments in n - k + 2 symbols.

1. Fragments meet by anchor hash, in buckets: only hashes and places move.  An anchor that one place has is done with.
2. Where an anchor has several fragments, their content is fetched from the texts, and meets in the bucket again.  There
   content decides: a fragment equal to an earlier one is repeated as a whole, and those that differ go to
   the caller's matcher.  Hashes bring together what may be equal; that two hashes agree by chance changes nothing.
3. Each document gets its repeated windows back, as runs.

A task compares equal fragments of the text it holds itself (by content too) before anything moves, so of a passage that is
everywhere a bucket gets one fragment for each TEXT_BYTES of text at most.

Windows are judged on the input: a window is repeated if the same symbols start earlier (smaller doc_id, or the same
document and an earlier start).  A document is an id and a text (its 128-bit hash tells it): rows that repeat both are that one
document, and different texts that share an id (null is an id like others) are documents of their own, in the order of their hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, doubled, mix, parts, plain, spread

TEXT_BYTES, FLUSH, MATCH_BYTES, BUCKET_BYTES, PIECES = 1 << 20, 300_000, 1 << 20, 16 << 20, 20_000
#: A document: its id and two hashes of its text.
KEY = [("doc", "<i8"), ("t1", "<i8"), ("t2", "<i8")]
PLACE = [*KEY, ("pos", "<i4")]
FRAGMENT = np.dtype([("q", "<u8"), *PLACE, ("cnt", "<i2")])
RUN = np.dtype([*PLACE, ("cnt", "<i4")])
PIECE = np.dtype([("q", "<u8"), *PLACE, ("cnt", "<i2"), ("size", "<i4")])
KEYS = ["doc_id", "t1", "t2"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, text."""
    return plain(docs).select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")


def fragments(v: np.ndarray, lens: np.ndarray, keys: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fragments, a hash of each one's content, and where each starts in v. v: a hash for each symbol of the documents, one after another; k: a power of two."""
    w, total = n - k + 1, len(v)
    has = np.flatnonzero(lens >= n)
    if not len(has):
        return np.zeros(0, FRAGMENT), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.cumsum(lens) - lens
    g, span, whole = v, 1, 1
    gram = v if k == 1 else None
    while whole * 2 <= n:
        g = doubled(g, whole)
        whole *= 2
        if whole == k:
            gram = g
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(total, dtype=np.uint64)
    while span * 2 <= w:
        least[:-span] = np.minimum(least[:-span], least[span:])
        span *= 2
    if w > span:
        least[: span - w] = np.minimum(least[: span - w], least[w - span :])
    many = lens[has] - n + 1
    at = np.repeat(start[has], many) + spread(many)
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    lo, cnt = at[first], np.diff(first, append=len(at))
    size, a = cnt + n - 1, anchor[first]
    own = np.searchsorted(start, lo, "right") - 1
    pieces = -(-(n + w - 1) // whole)
    f = mix(cnt.astype(np.uint64) * np.uint64(65536) + (a - lo).astype(np.uint64) + np.uint64(1))
    for j in range(pieces):
        f = mix(f * np.uint64(0x9E3779B97F4A7C15) + g[lo + (size - whole) * j // max(1, pieces - 1)])
    out = np.empty(len(lo), FRAGMENT)
    out["q"], out["pos"], out["cnt"] = mix(gram[a].copy()), lo - start[own], cnt
    for c, _ in KEY:
        out[c] = keys[c][own]
    return out, f, lo


def by_place(x: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """The order of x by the arrays in first, then by document and place."""
    return np.lexsort((x["pos"], x["t2"], x["t1"], x["doc"], *first[::-1]))


def same_place(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x["pos"] == y["pos"]) & (x["doc"] == y["doc"]) & (x["t1"] == y["t1"]) & (x["t2"] == y["t2"])


def settled_within(x: np.ndarray, f: np.ndarray, lo: np.ndarray, same: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The fragments that still have to be looked at, and the runs of those equal to an earlier one of the same chunk. f: a hash of each; same: whether the
    symbols from two places on are equal."""
    order = by_place(x, x["q"], f)
    x, f, lo = x[order], f[order], lo[order]
    new = np.ones(len(x), bool)
    new[1:] = (x["q"][1:] != x["q"][:-1]) | (f[1:] != f[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(x) else np.zeros(0, np.int64)
    rest = np.flatnonzero(~new)
    rest = rest[x["cnt"][rest] == x["cnt"][head[rest]]]
    rest = rest[same(lo[rest], lo[head[rest]], x["cnt"][rest].astype(np.int64) + n - 1)]
    again = same_place(x[rest], x[head[rest]])  # the same place, from a repeated row
    gone, left = rest[~again], np.ones(len(x), bool)
    left[rest] = False
    return x[left], runs(x[gone])


def runs(x: np.ndarray) -> np.ndarray:
    """Fragments or windows (place and cnt), in any order, as maximal runs."""
    x = x[by_place(x)]
    new = np.ones(len(x), bool)
    new[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["t1"][1:] != x["t1"][:-1]) | (x["t2"][1:] != x["t2"][:-1]) | (x["pos"][1:] != x["pos"][:-1] + x["cnt"][:-1])
    at = np.flatnonzero(new)
    out = np.empty(len(at), RUN)
    for c in ("doc", "t1", "t2", "pos"):
        out[c] = x[c][at]
    out["cnt"] = np.add.reduceat(x["cnt"].astype(np.int64), at) if len(at) else 0
    return out


def packed(x: np.ndarray) -> bytes:
    """Column by column, which compresses better."""
    return b"".join(np.ascontiguousarray(x[c]).tobytes() for c in x.dtype.names)


def unpacked(raw: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(raw) // dtype.itemsize
    out, at = np.empty(n, dtype), 0
    for c in dtype.names:
        size = n * dtype[c].itemsize
        out[c] = np.frombuffer(raw, dtype[c], n, at)
        at += size
    return out


def dealt(kind: int, x: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[lo]), kind, packed(x[lo:hi])


def batches_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)


DEALT = (["bucket", "kind", "payload"], [pa.int32(), pa.int32(), pa.binary()])


def in_table(x: np.ndarray, bucket: int) -> pd.DataFrame:
    """bucket: -1 for runs; else x are fragments whose content is asked for."""
    q = x["q"].view(np.int64) if bucket >= 0 else np.zeros(len(x), np.int64)
    return pd.DataFrame({"doc_id": x["doc"], "t1": x["t1"], "t2": x["t2"], "pos": x["pos"], "cnt": x["cnt"].astype(np.int32), "bucket": np.full(len(x), bucket, np.int32), "q": q})


RUNS = "doc_id long, t1 long, t2 long, pos int, cnt int"


def repeated_runs(
    docs: DataFrame,
    symbols: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]],
    content: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[bytes, np.ndarray]],
    matcher: Callable[[np.ndarray, list[bytes]], np.ndarray],
    n: int,
    k: int,
    label: str,
) -> DataFrame:
    """doc_id, t1, t2, pos, cnt: runs of repeated windows by their starts.

    docs: as keyed() gives them.  symbols: texts to a hash for each symbol, each text's number of symbols, and a test whether as many symbols from
    two places on are the same.  content: texts, and for each piece its text, its first symbol and the one after its last, to the pieces' bytes
    and their sizes.  matcher: pieces (PIECE, in order of anchor and place) and their bytes to the windows among them (RUN) that are repeated."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts(docs.sparkSession), -(-size // BUCKET_BYTES))

    def scan(batches):
        held: list[np.ndarray] = []
        gone: list[np.ndarray] = []

        def flush():
            x, again = np.concatenate(held), np.concatenate(gone)
            held.clear()
            gone.clear()
            rows = [*dealt(1, x, (x["q"] % np.uint64(buckets)).astype(np.int64)), *dealt(0, again, again["doc"] % buckets)]
            return batches_of(rows, *DEALT)

        for keys, texts in chunks(batches, TEXT_BYTES, KEY):
            v, lens, same = symbols(texts)
            x, again = settled_within(*fragments(v, lens, keys, n, k), same, n)
            held.append(x)
            gone.append(again)
            if sum(map(len, held)) + sum(map(len, gone)) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        gone = np.concatenate([np.zeros(0, RUN), *(unpacked(p, RUN) for p in frame.payload[frame.kind == 0])])
        x = np.concatenate([np.zeros(0, FRAGMENT), *(unpacked(p, FRAGMENT) for p in frame.payload[frame.kind == 1])])
        x = x[by_place(x, x["q"])]
        new = np.ones(len(x), bool)  # a repeated row brings the same fragment again
        new[1:] = (x["q"][1:] != x["q"][:-1]) | ~same_place(x[1:], x[:-1])
        x = x[new]
        group = np.cumsum(np.append(True, x["q"][1:] != x["q"][:-1])) - 1 if len(x) else np.zeros(0, np.int64)
        ask = x[np.bincount(group)[group] > 1] if len(x) else x
        return pd.concat([in_table(gone, -1), in_table(ask, int(frame.bucket.iloc[0]))])

    met = docs.select(*KEYS, "text").mapInArrow(scan, "bucket int, kind int, payload binary").groupBy("bucket").applyInPandas(meet, f"{RUNS}, bucket int, q long")
    met = cut(met, f"{label}-met")
    asked = met.filter("bucket >= 0").groupBy(*KEYS).agg(F.collect_list(F.struct("bucket", "q", "pos", "cnt")).alias("asked"))

    def fetch(batches):
        for batch in batches:
            texts = [t.as_py().encode() if isinstance(t.as_py(), str) else t.as_py() for t in batch.column(3)]
            lists = batch.column(4)
            own = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
            bucket, q, pos, cnt = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            for lo in range(0, len(own), PIECES):
                part = slice(lo, lo + PIECES)
                x = np.empty(len(own[part]), PIECE)
                x["q"], x["pos"], x["cnt"] = q[part].view(np.uint64), pos[part], cnt[part]
                for c, (name, _) in enumerate(KEY):
                    x[name] = batch.column(c).to_numpy(zero_copy_only=False)[own[part]]
                order = np.argsort(bucket[part], kind="stable")
                x, b = x[order], bucket[part][order]
                first = x["pos"].astype(np.int64)
                raw, x["size"] = content(texts, own[part][order], first, first + x["cnt"] + n - 1)
                ends = np.concatenate([[0], np.cumsum(x["size"], dtype=np.int64)])
                edges = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(x)]
                yield batches_of([(int(b[i]), j - i, packed(x[i:j]) + raw[ends[i] : ends[j]]) for i, j in zip(edges, edges[1:], strict=False)], *DEALT)

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        heads, raws = [], []
        for m, raw in zip(frame.kind, frame.payload, strict=True):
            head = unpacked(raw[: m * PIECE.itemsize], PIECE)
            ends = np.cumsum(head["size"], dtype=np.int64) + m * PIECE.itemsize
            heads.append(head)
            raws += [raw[e - s : e] for e, s in zip(ends.tolist(), head["size"].tolist(), strict=True)]
        x = np.concatenate(heads)
        order = by_place(x, x["q"])
        x = x[order]
        new = np.ones(len(x), bool)  # a repeated row brings the same piece again
        new[1:] = (x["q"][1:] != x["q"][:-1]) | ~same_place(x[1:], x[:-1])
        x, raws = x[new], [raws[i] for i in order[new].tolist()]
        seen: set[bytes] = set()
        equal = np.zeros(len(x), bool)
        for i, raw in enumerate(raws):
            if raw in seen:
                equal[i] = True
            else:
                seen.add(raw)
        found = [runs(x[equal])]
        rest = np.flatnonzero(~equal)
        x, raws = x[rest], [raws[i] for i in rest.tolist()]
        edges = [0, *(np.flatnonzero(x["q"][1:] != x["q"][:-1]) + 1).tolist(), len(x)]
        alone = np.repeat(np.diff(edges) == 1, np.diff(edges))
        x, raws = x[~alone], [r for r, y in zip(raws, alone.tolist(), strict=True) if not y]
        edges = [0, *(np.flatnonzero(x["q"][1:] != x["q"][:-1]) + 1).tolist(), len(x)]
        sizes, lo = np.concatenate([[0], np.cumsum(x["size"], dtype=np.int64)]), 0
        for b in edges[1:]:  # as many anchors at a time as fit
            if b > lo and (sizes[b] - sizes[lo] >= MATCH_BYTES or b == len(x)):
                found.append(runs(matcher(x[lo:b], raws[lo:b])))
                lo = b
        return in_table(np.concatenate(found), -1).drop(columns=["bucket", "q"])

    pieces = docs.join(asked, KEYS).select(*KEYS, "text", "asked").mapInArrow(fetch, "bucket int, kind int, payload binary")
    matched = cut(pieces.groupBy("bucket").applyInPandas(match, RUNS), f"{label}-matched")
    return met.filter("bucket < 0").select(*KEYS, "pos", "cnt").unionByName(matched)


def with_runs(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text, runs (array of pos, cnt, or null): every row of docs."""
    return docs.join(found.groupBy(*KEYS).agg(F.collect_list(F.struct("pos", "cnt")).alias("runs")), KEYS, "left").select("doc_id", "text", "runs")


def windows_of(x: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows that start at places `at` within pieces own of x, as RUN."""
    out = np.empty(len(own), RUN)
    for c, _ in KEY:
        out[c] = x[c][own]
    out["pos"], out["cnt"] = x["pos"][own] + at, 1
    return out


def covered(runs_: list[dict] | None, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of symbols that repeated windows cover."""
    if not runs_:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = np.array([r["pos"] for r in runs_], np.int64)
    hi = np.minimum(np.array([r["pos"] + r["cnt"] for r in runs_], np.int64) + n - 1, length)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:] - 1, len(hi) - 1)]
