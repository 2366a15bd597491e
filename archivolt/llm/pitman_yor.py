"""Hierarchical Pitman-Yor language model of words, its restaurants spread over the cluster.

Each word is a context with a restaurant of its own; what follows the word are its customers, the words
its dishes.  Its tables are customers of the restaurant all contexts share, whose base is uniform over the V
known words and one for all others.  Seatings are sampled by Gibbs: in each sweep all customers of a dish get up and sit
down again, that is, the number of their tables is drawn given their own number and what the context grants the parent's
probability of the dish.  Sweeps are exchanges: the tables drawn are summed, the parent's are drawn, and the next sweep starts from
them.  Predictions are averaged over the sweeps kept.

Documents lie in blocks (BLOCK_BYTES of text).  A block's words and word pairs, counted, go to buckets by hash and
come back as sums, so no table of the corpus is ever in one place:
1. words and pairs: how often each occurs in training, and the first block that has a pair owns it;
2. types: of each context and each dish, summed from owned pairs; they give the parent's first estimate;
3. tables, in each sweep: the same from the owned pairs' draws, and the parent's own draws;
4. scores, in the blocks.
The draws depend on the pair's hash and the sweep alone, so every block that has a pair sees the same seating.

Words and pairs are known by 64-bit hashes; counts have 64 bits too.  What a sweep has read goes when the next one is written.
Training documents are those whose crc32(doc_id as text) mod 7 isn't 2.

Defined cases: null and empty texts consist of the end alone; a null doc_id counts as the smallest (held out or not by that
number's text) and comes out as null; rows that repeat an id train and are scored each; other columns are ignored; an empty
table gives an empty table; without training tokens every token has the probability of a new word.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import chunks, cut, forget, id_out, mix, parts, plain

BLOCK_BYTES, FOLDS, HELD = 5 << 20, 7, 2
STRENGTH, DISCOUNT, SWEEPS, BURN = 1.0, 0.75, 6, 2
END = np.uint64(0x1F0E1D2C3B4A5968)
TOTAL = -1
WORDS, PAIRS, TYPES, TABLES = range(4)  # TABLES + s are those of sweep s
#: Up to EXACT customers of a dish the number of tables is drawn from its exact distribution; the axes of the table for more.
EXACT, LOG_C, LOG_RATE = 64, np.arange(5.75, 40.3, 0.25), np.arange(-8.0, 16.1, 0.1)


def squeezed(x: np.ndarray) -> bytes:
    """Compressed byte by byte of the items, first all their low bytes: most numbers are small."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(raw: bytes, dtype) -> np.ndarray:
    (size,) = struct.unpack_from("<q", raw)
    planes = np.frombuffer(pa.decompress(raw[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def is_held(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def blocked(docs: DataFrame) -> DataFrame:
    """block, ids, lens, tokens (numbers within the block, frequent words first after 0, the end), words (their hashes)."""

    def run(batches):
        part, seq = TaskContext.get().partitionId() << 24, 0
        for ids, texts in chunks(batches, BLOCK_BYTES):
            seen: dict[bytes, int] = {b"": 0}
            number = seen.setdefault
            tokens, lens = [], []
            for t in texts:
                own = t.lower().split()
                lens.append(len(own) + 1)
                tokens.append(np.array([number(w, len(seen)) for w in own] + [0], np.uint32))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
            hashes[0] = END
            tokens = np.concatenate(tokens)
            order = np.argsort(-np.bincount(tokens, minlength=len(hashes))[1:], kind="stable") + 1
            place = np.zeros(len(hashes), np.uint32)
            place[order] = np.arange(1, len(hashes), dtype=np.uint32)
            tokens, hashes[1:] = place[tokens], hashes[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part + seq]), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), np.array(lens, np.int32).tobytes(), squeezed(tokens), hashes.tobytes()))], names=["block", "ids", "lens", "tokens", "words"]
            )
            seq += 1

    return docs.mapInArrow(run, "block long, ids binary, lens binary, tokens binary, words binary")


class Block:
    """A block with its distinct pairs (context, word)."""

    def __init__(self, ids: bytes, lens: bytes, tokens: bytes, words: bytes, buckets: int):
        self.buckets = buckets
        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int32).astype(np.int64)
        self.tokens, self.words = unsqueezed(tokens, np.uint32).astype(np.int64), np.frombuffer(words, np.uint64)
        self.held = np.array([is_held(i) for i in self.ids.tolist()], bool)
        before = np.concatenate([[0], self.tokens[:-1]])  # a text's first word follows the end of another
        codes = before * len(self.words) + self.tokens
        codes, pair = np.unique(codes, return_inverse=True)
        self.pair = pair.astype(np.int32)
        self.context, self.dish = (codes // len(self.words)).astype(np.int32), (codes % len(self.words)).astype(np.int32)
        del codes, pair, before
        self.hash = mix(self.words[self.context] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.dish])
        self.trained = np.repeat(~self.held, self.lens)

    in_order: tuple[np.ndarray, np.ndarray] | None = None

    def _order(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places by bucket, and each bucket's end. Small integers are sorted by radix; the words' order is kept, every sweep asks for it."""
        if h is self.words and self.in_order:
            return self.in_order
        bucket = ((h >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.min_scalar_type(self.buckets))
        out = np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=self.buckets))
        if h is self.words:
            self.in_order = out
        return out

    def send(self, kind: int, h: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, kind, payload): hashes and columns of what belongs to the bucket."""
        order, ends = self._order(h)
        h, columns = h[order], [c[order] for c in columns]
        for b in range(self.buckets):
            lo, hi = ends[b - 1] if b else 0, ends[b]
            if lo < hi:
                tail = [squeezed(c[lo:hi]) for c in columns]
                yield b, kind, struct.pack(f"<q{len(tail)}q", hi - lo, *map(len, tail)) + h[lo:hi].astype("<u8").tobytes() + b"".join(tail)

    def receive(self, h: np.ndarray, got: dict[int, bytes], dtypes: list) -> list[np.ndarray]:
        """The columns that came back, in the order of h. got: by bucket."""
        order, _ = self._order(h)
        out = []
        for i, dtype in enumerate(dtypes):
            column = np.empty(len(h), dtype)
            if len(h):
                column[order] = np.concatenate([unsqueezed(split(got[b])[i], dtype) for b in sorted(got)])
            out.append(column)
        return out


class Owned(Block):
    """Of a block its words, and the pairs that it owns with their counts: what the sweeps need."""

    def __init__(self, raw: bytes, buckets: int):
        self.buckets = buckets
        words, context, dish, count = split(raw)
        self.words, self.context, self.dish = unsqueezed(words, np.uint64), unsqueezed(context, np.int32), unsqueezed(dish, np.int32)
        self.count = unsqueezed(count, np.int64)
        self.hash = mix(self.words[self.context] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.dish])


def joined(columns: list[np.ndarray]) -> bytes:
    tail = [squeezed(c) for c in columns]
    return struct.pack(f"<q{len(tail)}q", len(tail), *map(len, tail)) + b"".join(tail)


def split(raw: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<q", raw)
    sizes, at, out = struct.unpack_from(f"<{n}q", raw, 8), 8 + 8 * n, []
    for s in sizes:
        out.append(raw[at : at + s])
        at += s
    return out


def received(raw: bytes, dtypes: list) -> tuple[np.ndarray, list[np.ndarray]]:
    k = len(dtypes)
    n, *sizes = struct.unpack_from(f"<q{k}q", raw)
    at = 8 + 8 * k
    h = np.frombuffer(raw, "<u8", n, at)
    at += 8 * n
    out = []
    for s, d in zip(sizes, dtypes, strict=True):
        out.append(unsqueezed(raw[at : at + s], d))
        at += s
    return h, out


def uniform(h: np.ndarray, draw: int) -> np.ndarray:
    return (mix(h + np.uint64(0x9E3779B97F4A7C15 * (draw + 1) % 2**64)) >> np.uint64(11)).astype(float) / 2.0**53


def log_stirling(most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of c customers at t tables, [c, t], by their recursion."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = np.log(c - DISCOUNT * t) + out[c, 1 : c + 1]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], out[c, : c + 1])
    return out


def moments(c: np.ndarray, grant: np.ndarray, nodes: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of tables of c customers, of weight grant^t * Stirling(c, t).  Their generating function in c is
    exp(rate * (1 - (1 - z)^DISCOUNT)), rate = grant / DISCOUNT; its coefficients are integrals over z = exp(-w), w on a parabola around the cut."""
    c, rate = np.asarray(c, float), np.asarray(grant, float) / DISCOUNT
    lo, hi = np.full(c.shape, -60.0), np.full(c.shape, 6.0)
    for _ in range(60):  # the saddle: rate * d * (1 - e^-w)^(d - 1) * e^-w = c
        x = (lo + hi) / 2
        w = np.exp(x)
        up = np.log(rate * DISCOUNT) + (DISCOUNT - 1) * np.log(-np.expm1(-w)) - w > np.log(c)
        lo, hi = np.where(up, x, lo), np.where(up, hi, x)
    top = np.maximum(np.exp(lo), 6.0 / c)
    u = (np.arange(nodes) + 0.5 - nodes / 2) * (2 * np.minimum(2.5, 8 / np.sqrt(c * top)) / nodes)[..., None]
    w = top[..., None] * (1 + 1j * u) ** 2
    near = np.abs(w.imag) < np.pi
    tables = rate[..., None] * (1 - (1 - np.exp(-w)) ** DISCOUNT)
    log = tables + c[..., None] * w
    weight = np.where(near, np.exp(log - log.real.max(-1, keepdims=True)) * (1 + 1j * u), 0)
    all_ = weight.sum(-1).real
    mean = (weight * tables).sum(-1).real / all_
    return mean, (weight * (tables - mean[..., None]) ** 2).sum(-1).real / all_ + mean


@functools.cache
def tabled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stirling numbers up to EXACT; beyond, over log2(c) and log(rate / c^DISCOUNT): log of (mean - 1) / (rate * c / (rate + c)), and variance / (mean - 1)."""
    at, x = np.meshgrid(LOG_C, LOG_RATE, indexing="ij")
    c = 2.0**at
    rate = np.exp(x) * c**DISCOUNT
    mean, variance = (np.concatenate(y) for y in zip(*[moments(c[i : i + 16], DISCOUNT * rate[i : i + 16]) for i in range(0, len(c), 16)], strict=True))
    return log_stirling(EXACT), np.log((mean - 1) * (rate + c) / (rate * c)), np.clip(variance / (mean - 1), 1e-6, 1)


def looked_up(c: np.ndarray, grant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables but one, between the points of the table; below them both are the rate."""
    _, means, shares = tabled()
    c, rate = c.astype(float), grant / DISCOUNT
    place = lambda y, axis: np.clip((y - axis[0]) / (axis[1] - axis[0]), 0, len(axis) - 1.001)
    i, j = place(np.log2(c), LOG_C), place(np.log(rate) - DISCOUNT * np.log(c), LOG_RATE)
    a, b = i.astype(int), j.astype(int)
    i, j = i - a, j - b
    mixed = lambda y: (1 - i) * ((1 - j) * y[a, b] + j * y[a, b + 1]) + i * ((1 - j) * y[a + 1, b] + j * y[a + 1, b + 1])
    mean = np.minimum(np.exp(mixed(means)) * rate * c / (rate + c), c - 1)
    return mean, mean * mixed(shares)


def binomial(u: np.ndarray, mean: np.ndarray, variance: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Draws of that mean and variance (smaller than the mean) between 0 and most: binomial, for means over 40 its normal limit with the skew."""
    p = np.clip(1 - variance / mean, 1e-9, 1 - 1e-9)
    n = mean / p
    out = np.zeros(len(u))
    big = mean > 40
    if big.any():
        v = 2 * np.minimum(u[big], 1 - u[big]) / 2
        r = np.sqrt(-2 * np.log(np.maximum(v, 1e-17)))
        z = r - (2.515517 + 0.802853 * r + 0.010328 * r * r) / (1 + 1.432788 * r + 0.189269 * r * r + 0.001308 * r**3)
        z = np.where(u[big] < 0.5, -z, z)
        out[big] = np.round(mean[big] + np.sqrt(variance[big]) * z + (1 - 2 * p[big]) * (z * z - 1) / 6)
    live = np.flatnonzero(~big)
    log, left, k = n[live] * np.log1p(-p[live]), u[live], 0
    while len(live):
        left = left - np.exp(log)
        go = (left > 0) & (n[live] > k) & (k < 200)
        live, left, log = live[go], left[go], log[go]
        log = log + np.log((n[live] - k) / (k + 1)) + np.log(p[live] / (1 - p[live]))
        k += 1
        out[live] = k
    return np.clip(out, 0, most)


def polynomial_draw(weights: np.ndarray, g: np.ndarray, u: np.ndarray) -> np.ndarray:
    """1, 2, ..., each drawn by its share of the terms weights[0], weights[1] * g, ..., of which u says how far to go."""
    left = np.zeros(len(g))
    for w in weights[::-1]:
        left = left * g + w
    left *= u
    out, power = np.ones(len(g), np.int64), np.ones(len(g))
    for w in weights[:-1]:
        left -= w * power
        more = left > 0
        if not more.any():
            break
        out += more
        power *= g
    return out


def drawn(h: np.ndarray, c: np.ndarray, grant: np.ndarray, sweep: int) -> np.ndarray:
    """A draw of the number of tables of dishes with c customers each, all of whom sit down anew. grant: a new table's weight; h: what
    the draw depends on.  Up to EXACT customers it's from the numbers' own distribution, beyond from the binomial of the same mean and variance
    (the number of tables is a sum of independent yes-or-no draws, as the Stirling polynomials have real roots)."""
    out = np.minimum(c, 1).astype(np.int64)
    u, grant = uniform(h, sweep), np.maximum(grant, 1e-300)
    stirling = tabled()[0]
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    few = few[np.argsort(c[few], kind="stable")]
    for same in np.split(few, np.flatnonzero(np.diff(c[few])) + 1):
        if not len(same):
            continue
        k = int(c[same[0]])
        weights = np.exp(stirling[k, 1 : k + 1] - stirling[k, 1 : k + 1].max())
        for i in range(0, len(same), 1 << 14):
            at = same[i : i + (1 << 14)]
            # weights of more tables by powers of the grant, from the side on which they don't overflow
            g, turned = grant[at], grant[at] > 1
            g = np.where(turned, 1 / g, g)
            for rows, own in ((np.flatnonzero(~turned), weights), (np.flatnonzero(turned), weights[::-1])):
                if len(rows):
                    tables = polynomial_draw(own, g[rows], u[at[rows]] if own is weights else 1 - u[at[rows]])
                    out[at[rows]] = tables if own is weights else k + 1 - tables
    many = np.flatnonzero(c > EXACT)
    if len(many):
        out[many] = 1 + binomial(u[many], *looked_up(c[many], grant[many]), c[many] - 1).astype(np.int64)
    return out


def seated(h: np.ndarray, c: np.ndarray, grant: np.ndarray, sweeps: int = SWEEPS, burn: int = BURN) -> np.ndarray:
    """The mean number of tables over the sweeps kept, under grants that stay."""
    return np.mean([drawn(h, c, grant, s) for s in range(burn, sweeps)], axis=0)


def parent_probability(customers: np.ndarray, tables: np.ndarray, all_customers: float, all_tables: float, v: int) -> np.ndarray:
    """Of dishes in the shared restaurant; its base is 1 / (v + 1)."""
    known = np.maximum(customers - DISCOUNT * tables, 0)
    return (known + (STRENGTH + DISCOUNT * all_tables) / (v + 1)) / (STRENGTH + all_customers)


def batch_of(block: int, sent) -> pa.RecordBatch:
    sent = list(sent)
    columns = ([x[0] for x in sent], pa.int32()), ([block] * len(sent), pa.int64()), ([x[1] for x in sent], pa.int32()), ([x[2] for x in sent], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["bucket", "block", "kind", "payload"])


SENT = "bucket int, block long, kind int, payload binary"
BACK = "block long, bucket int, kind int, payload binary"


def answer(kind: int, frame: pd.DataFrame, v: int, last_tables: float) -> Iterator[tuple[int, int, int, bytes]]:
    """What a bucket returns to the blocks: sums by hash, and totals to the driver."""
    dtypes = [np.int64] if kind in (WORDS, PAIRS) else [np.int64, np.int64]
    bucket = int(frame.bucket.iloc[0])
    frame = frame.sort_values("block")
    sent = [received(p, dtypes) for p in frame.payload]
    lens = [len(h) for h, _ in sent]
    h = np.concatenate([x for x, _ in sent])
    columns = [np.concatenate([c[i] for _, c in sent]).astype(np.int64) for i in range(len(dtypes))]
    each, at = np.unique(h, return_inverse=True)
    sums = [np.bincount(at, c, len(each)) for c in columns]
    if kind == PAIRS:
        mine = np.flatnonzero(columns[0] > 0)
        owner = np.zeros(len(h), np.uint8)
        owner[mine[np.unique(at[mine], return_index=True)[1]]] = 1
        back = [sums[0].astype(np.int64)[at], owner]
        totals = []
    elif kind == WORDS:
        back, totals = [sums[0].astype(np.int64)[at]], [sums[0].sum(), (sums[0] > 0).sum()]
    elif kind == TYPES:
        back, totals = [s.astype(np.int64)[at] for s in sums], [sums[1].sum()]
    else:
        customers = sums[1].astype(np.int64)
        tables = drawn(each, customers, np.full(len(each), (STRENGTH + DISCOUNT * last_tables) / (v + 1)), kind - TABLES)
        back, totals = [x.astype(np.int64)[at] for x in (sums[0], customers, tables)], [customers.sum(), tables.sum()]
    ends = np.cumsum(lens)
    for b, n, e in zip(frame.block.tolist(), lens, ends.tolist(), strict=True):
        yield b, bucket, kind, joined([x[e - n : e] for x in back])
    if totals:
        yield TOTAL, bucket, kind, np.array(totals, float).tobytes()


def language_model(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    docs = plain(docs)
    spark = docs.sparkSession
    buckets = 2 * parts(spark)
    blocks = cut(blocked(docs), "op6-blocks")

    def first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["ids"], row["lens"], row["tokens"], row["words"], buckets)
                for kind, h, by, n in ((WORDS, b.words, b.tokens, len(b.words)), (PAIRS, b.hash, b.pair, len(b.hash))):
                    yield batch_of(row["block"], b.send(kind, h, [np.bincount(by[b.trained], minlength=n).astype(np.int64)]))

    def reduced(sent: DataFrame, label: str, v: int = 0, last_tables: float = 0.0, done: tuple[DataFrame, ...] = ()) -> tuple[DataFrame, np.ndarray]:
        def run(frame):
            rows = [r for kind, own in frame.groupby("kind") for r in answer(int(kind), own, v, last_tables)]
            return pd.DataFrame(rows, columns=["block", "bucket", "kind", "payload"])

        out = cut(sent.groupBy("bucket").applyInPandas(run, BACK), f"op6-{label}", done)
        totals = [np.frombuffer(r[0]) for r in out.filter(f"block = {TOTAL}").select("payload").collect()]
        back = out.filter(f"block <> {TOTAL}")
        back.cut_path = out.cut_path
        return back, np.sum([t for t in totals if len(t)], axis=0) if totals else np.zeros(2)

    def with_answers(base: DataFrame, answers: DataFrame, f, schema: str) -> DataFrame:
        def run(one, many):
            if not len(one):
                return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
            r = one.iloc[0]
            b = Owned(r["payload"], buckets) if "payload" in one else Block(r["ids"], r["lens"], r["tokens"], r["words"], buckets)
            got: dict[int, dict[int, bytes]] = {}
            for k, u, p in zip(many.kind, many.bucket, many.payload, strict=True):
                got.setdefault(int(k), {})[int(u)] = p
            return f(int(r["block"]), b, got)

        return base.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)

    def sent_frame(block: int, sent) -> pd.DataFrame:
        rows = [(x, block, kind, p) for x, kind, p in sent]
        return pd.DataFrame(rows, columns=["bucket", "block", "kind", "payload"])

    counts, totals = reduced(blocks.mapInArrow(first, SENT), "counts")
    n, v = int(totals[0]), int(totals[1])

    def owning(block, b, got):
        c, owner = b.receive(b.hash, got[PAIRS], [np.int64, np.uint8])
        own = owner > 0
        return pd.DataFrame({"block": [block], "payload": [joined([b.words, b.context[own], b.dish[own], c[own]])]})

    def types(batches):
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Owned(raw, buckets)
                yield batch_of(block, b.send(TYPES, b.words, [np.bincount(x, minlength=len(b.words)).astype(np.int64) for x in (b.context, b.dish)]))

    owned = cut(with_answers(blocks, counts.filter(f"kind = {PAIRS}"), owning, "block long, payload binary"), "op6-owned")
    last, totals = reduced(owned.mapInArrow(types, SENT), "types")

    def grants(b, got, s: int, all_customers: float, all_tables: float):
        """Of the pairs: what their contexts grant a new table, after s sweeps; of the contexts, their tables; and the dishes' probabilities."""
        if s:
            by_context, customers, tables = b.receive(b.words, got[TABLES + s - 1], [np.int64] * 3)
        else:
            by_context, customers = b.receive(b.words, got[TYPES], [np.int64, np.int64])
            tables = np.minimum(customers, 1)
        parent = parent_probability(customers.astype(float), tables.astype(float), all_customers, all_tables, v)
        return (STRENGTH + DISCOUNT * by_context[b.context].astype(float)) * parent[b.dish]

    def swept(s: int, all_customers: float, all_tables: float):
        def tables(block, b, got):
            t = drawn(b.hash, b.count, grants(b, got, s, all_customers, all_tables), s)
            return sent_frame(block, b.send(TABLES + s, b.words, [np.bincount(x, t, len(b.words)).astype(np.int64) for x in (b.context, b.dish)]))

        return tables

    # each sweep starts from the tables of the one before
    state = [(float(totals[0]), float(v))]
    kept = counts
    for s in range(SWEEPS):
        before = last
        last, totals = reduced(with_answers(owned, before, swept(s, *state[-1]), SENT), f"tables-{s}", v, state[-1][1], (before,) if s < BURN else ())
        state.append((float(totals[0]), float(totals[1])))
        if s >= BURN - 1:
            kept = kept.unionByName(last)
    forget(owned)

    def scored(block, b, got):
        (count,) = b.receive(b.words, got[WORDS], [np.int64])
        c = b.receive(b.hash, got[PAIRS], [np.int64, np.uint8])[0].astype(np.int64)
        room = STRENGTH + count[b.context].astype(float)
        grant, p = grants(b, got, BURN, *state[BURN]), 0.0
        for s in range(BURN, SWEEPS):
            t = drawn(b.hash, c, grant, s)
            grant = grants(b, got, s + 1, *state[s + 1])
            p = p + (np.maximum(c - DISCOUNT * t, 0) + grant) / room / (SWEEPS - BURN)
        owner = np.repeat(np.arange(len(b.ids)), b.lens)
        base = np.log10((count.astype(float) + 1) / (n + v + 1))
        score = np.bincount(owner, np.log10(p)[b.pair], len(b.ids))
        known = np.bincount(owner, (count > 0)[b.tokens], len(b.ids))
        return pd.DataFrame({"doc_id": b.ids, "held_out": b.held, "n_tokens": b.lens, "n_known": known.astype(np.int64), "train_tokens": np.full(len(b.ids), n), "base_score": np.bincount(owner, base[b.tokens], len(b.ids)), "score": score, "perplexity": 10 ** (-score / b.lens)})

    out = with_answers(blocks, kept, scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return out.withColumn("doc_id", id_out())
