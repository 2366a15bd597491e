"""Whitening of embeddings, by block Lanczos on a covariance that is never formed.

Each entry c becomes the whole number floor(SCALE * c) + SHIFT; the fit list holds each distinct vector once (packed in 1 + 2, 4 or 8 bytes an
entry, so that deduplication moves no more than it must, and partly before the shuffle).  Its size and sums are exact whole numbers.

The covariance meets the algorithm only as a product: every task centres its rows, X - S/n, multiplies them with a block Q of a few
columns and adds up X'(XQ); what leaves a task is one row a column and dimension group, and sums of these are what the driver gets: dimension x
block numbers, however many rows there are.  The driver holds the Krylov basis (at most dimension x dimension numbers) and
orthogonalises each new block against all of it, twice.  Where a new block loses rank (breakdown: an invariant subspace
was found), its lost columns start again from random vectors orthogonal to the basis, so repeated eigenvalues are found too.  It ends when the
residuals of the wanted pairs, |V y - e y| by the last block, fall to TOLERANCE of the largest eigenvalue, or when the basis spans the whole space.

The trace is the sum of squared deviations of the fit list, and shares are eigenvalues by it.  The whitened fit list's covariance is then measured in
one more pass and given as identity_error.

Defined cases: a vector that is null or has a null or non-finite entry isn't used and has no rows; so has one whose number of entries isn't the most
frequent one (the largest of equally frequent); entries whose scaled value leaves 64 bits count as non-finite; rows that repeat are each given their rows, and count
once in the fit; a null vec_id comes out as null; a component without variance (an eigenvalue within rounding of 0 by the trace) can't be
whitened and isn't given, so one distinct vector or a constant table gives no rows; a deviation beyond 64 bits is null; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

SCALE, SHIFT, COMPONENTS, BLOCK = 64, 1_000_000, 16, 16
TOLERANCE, NO_VARIANCE, SEED = 1e-13, 1e-12, 12
#: Entries decoded at a time; and what scaled entries stay within 64 bits below.
ENTRIES, LARGEST = 1 << 21, 2.0**56
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id, v (array of double): vectors without null or non-finite entries, of the most frequent length."""
    v = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[column].cast("array<double>").alias("v"))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    v = v.filter(F.col("v").isNotNull() & F.forall("v", fits))
    size = v.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return v.filter(F.size("v") == (size[0][0] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's vectors as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(column), -1)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in as few bytes as its own entries need, the width first: equal rows are packed alike."""
    y = x - SHIFT
    most = np.abs(y).max(1, initial=0)
    small, middle = y.astype("<i2"), y.astype("<i4")
    return [b"2" + small[i].tobytes() if m < 2**15 else b"4" + middle[i].tobytes() if m < 2**31 else b"8" + y[i].astype("<i8").tobytes() for i, m in enumerate(most)]


def unpacked(rows: list[bytes], d: int) -> np.ndarray:
    """What packed() packed, without the shift."""
    out = np.empty((len(rows), d), np.int64)
    by: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by.setdefault(r[0], []).append(i)
    for width, at in by.items():
        out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), f"<i{chr(width)}").reshape(len(at), d)
    return out


def _pieces(batch: pa.RecordBatch, d: int):
    """The batch's vectors, about ENTRIES entries at a time."""
    step = max(1, ENTRIES // max(1, d))
    for lo in range(0, batch.num_rows, step):
        yield unpacked(batch.column(0)[lo : lo + step].to_pylist(), d)


def _summed(fit: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all rows of what make(rows without shift) gives: size doubles. A task gives one row a slot."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            for y in make.pieces(b):
                total += make(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["slot", "value"])

    out = np.zeros(size)
    for r in fit.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out[r[0]] = r[1]
    return out


class Product:
    """Of a block of centred rows X: X'(XQ), flat."""

    def __init__(self, d: int, mean: np.ndarray, q: np.ndarray):
        self.d, self.mean, self.q = d, mean, q

    def pieces(self, batch):
        return _pieces(batch, self.d)

    def __call__(self, y: np.ndarray) -> np.ndarray:
        x = y - self.mean
        return (x.T @ (x @ self.q)).ravel()


class Squares(Product):
    """Of whitened rows W = XQ: the sums of W's columns, then W'W."""

    def __call__(self, y: np.ndarray) -> np.ndarray:
        w = (y - self.mean) @ self.q
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])


class Spread(Product):
    """The sum of squared deviations."""

    def __call__(self, y: np.ndarray) -> np.ndarray:
        x = y - self.mean
        return np.array([(x * x).sum()])


def _orthogonal(w: np.ndarray, basis: np.ndarray, scale: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """q, r: w = q r within the rounding of scale, q orthonormal and orthogonal to basis; lost columns start again at random, with zeros in r."""
    d, k = w.shape
    q, r = np.zeros((d, 0)), np.zeros((k, k))
    rows = 0
    room = d - basis.shape[1]
    for j in range(k):
        v = w[:, j].copy()
        for _ in range(2):
            h = q.T @ v
            r[:rows, j] += h
            v -= q @ h
            v -= basis @ (basis.T @ v)
        norm = np.linalg.norm(v)
        if rows >= room:
            continue
        if norm <= 1e-13 * scale:
            # breakdown: what is left of the column is rounding
            for _ in range(20):
                v = random.standard_normal(d)
                for _ in range(3):
                    v -= basis @ (basis.T @ v)
                    v -= q @ (q.T @ v)
                    v /= np.linalg.norm(v)
                if np.abs(basis.T @ v).max(initial=0) < 1e-12:
                    break
        else:
            r[rows, j] = norm
            v /= norm
        q = np.column_stack([q, v])
        rows += 1
    return q, r[:rows]


def block_lanczos(times, d: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """The wanted largest eigenvalues, falling, their unit vectors as columns, and the number of products. times(Q): the symmetric matrix by Q."""
    random = np.random.default_rng(seed)
    wanted, block = min(wanted, d), min(block, d)
    q, _ = np.linalg.qr(random.standard_normal((d, block)))
    basis, image, products, closed = np.zeros((d, 0)), np.zeros((d, 0)), 0, False
    while True:
        v = times(q)
        products += 1
        basis, image = np.hstack([basis, q]), np.hstack([image, v])
        t = basis.T @ image
        values, vectors = np.linalg.eigh((t + t.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        scale = max(abs(values[0]), abs(values[-1]), 1e-300)
        rest = v - basis @ (basis.T @ v)
        rest -= basis @ (basis.T @ rest)
        q_next, r = _orthogonal(rest, basis, scale, random)
        last = vectors[-q.shape[1] :, :wanted]
        residual = np.linalg.norm(r @ last, axis=0) if r.size else np.zeros(wanted)
        small = basis.shape[1] >= wanted and residual.max(initial=0) <= tolerance * scale
        broken = not r.size or np.linalg.matrix_rank(r, tol=1e-12 * scale) < q.shape[1]
        # after a breakdown one restarted block has to leave the pairs as they are: a subspace that closed early may lack a repeated eigenvalue
        if basis.shape[1] >= d or not q_next.shape[1] or (small and (closed or not broken)):
            y = basis @ vectors[:, :wanted]
            return values[:wanted], y / np.linalg.norm(y, axis=0), products
        q, closed = q_next, small


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, block: int = BLOCK, label: str = "op12") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, column)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(packed(matrix(b.column(0))), pa.binary())], names=["x"])

    fit = cut(rows.select("v").mapInArrow(pack, "x binary").distinct(), f"{label}-fit")
    head = fit.selectExpr("count(*) AS n", "max((length(x) - 1) DIV cast(cast(substring(x, 1, 1) AS string) AS int)) AS d").first()
    n, d = head["n"], head["d"] or 0
    empty = spark.createDataFrame([], OUT + ", identity_error double")
    if not n or not d:
        return empty

    def sums(batches):
        total = [0] * d
        for b in batches:
            for y in _pieces(b, d):
                total = [a + int(s) for a, s in zip(total, y.astype(object).sum(0) if np.abs(y).max() > 2**40 else y.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([str(t) for t in total])], names=["slot", "value"])

    totals = {r[0]: int(r[1]) for r in fit.mapInArrow(sums, "slot int, value string").groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    plain = [totals[k] for k in range(d)]  # without the shift, which cancels out of every deviation
    mean = np.array([float(t // n) + (t % n) / n for t in plain])
    times = lambda q: _summed(fit, Product(d, mean, q), d * q.shape[1]).reshape(d, -1) / n
    trace = _summed(fit, Spread(d, mean, mean), 1)[0] / n
    if trace <= 0:
        return empty
    values, axes, _ = block_lanczos(times, d, components, block)
    some = values > NO_VARIANCE * trace
    values, axes = values[some], axes[:, some]
    k = len(values)
    to = axes / np.sqrt(values)
    found = _summed(fit, Squares(d, mean, to), k + k * k) / n
    error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    forget(fit)
    explained = values / trace

    def white(batches):
        for b in batches:
            step = max(1, ENTRIES // (d + k))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                y = matrix(part.column(1)) - SHIFT
                w = (y - mean) @ to
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(y)), k)))
                dev = pa.array(deviations(y, plain, n), pa.int64()).take(pa.array(np.repeat(np.arange(len(y)), k)))
                comp = np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))
                yield pa.RecordBatch.from_arrays([ids, pa.array(comp), pa.array(np.full(len(comp), n)), dev, pa.array(w.ravel()), pa.array(np.tile(explained, len(y)))], names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.select("vec_id", "v").mapInArrow(white, OUT).withColumn("identity_error", F.lit(error))


def deviations(y: np.ndarray, sums: list[int], n: int) -> np.ndarray | list[int | None]:
    """Each row's sum of (n * y - S) squared, exactly; None beyond 64 bits."""
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))
    if most * most * max(1, y.shape[1]) < 2**63:
        z = n * y - np.array(sums, np.int64)
        return (z * z).sum(1)
    out = ((n * y.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in out]
