"""Toxicity by a chain of classifiers.

The categories are what the labels say (toxic) and, before it, two kinds of toxic documents that training finds itself: a mixture of
two word distributions, fitted by expectation-maximisation to the words that mark the labelled toxic documents.  Each category has a linear model of
hashed words and word beginnings.  Models follow one another in a
fixed order: a later model also reads the earlier categories' probabilities.  In training those are out-of-fold
predictions (each document's from models that didn't see it), so a later model doesn't learn to trust an
earlier one more than it deserves.  Features are scaled by their log-count ratio in training.

The chain is fitted on a bounded sample of the labelled rows (SAMPLE of them, those of smallest hash).  All documents are
scored as a whole.

Defined cases: a null text is empty; an empty text is clean with probability 0; null labels don't
train, nor do labels of a null id or of no document; of several texts with a labelled id the one of smallest hash trains; a null doc_id stays null;
repeated rows come out repeated; other columns are ignored; with no labels, or of one kind only, the category's probability is that kind's.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, id_out, plain

BITS, SAMPLE, FOLDS, TEXT_BYTES = 18, 12_000, 5, 1 << 20
KINDS = 2
CHAIN = (*(f"kind_{i + 1}" for i in range(KINDS)), "toxic")
EDGES = b".,;:!?\"'()[]|*%&#$"


class Words:
    """A text's features: its distinct words, lower-cased and without punctuation at the edges, and their first four and six bytes."""

    def __init__(self, bits: int = BITS):
        self.size, self.cache = 1 << bits, {}

    def slots(self, words: list[bytes]) -> np.ndarray:
        cache, mask = self.cache, self.size - 1
        if len(cache) > 100_000:
            cache.clear()
        out: set[int] = set()
        for w in set(words):
            s = cache.get(w)
            if s is None:
                x = w.strip(EDGES)
                s = cache[w] = tuple({zlib.crc32(x) & mask, zlib.crc32(b"4" + x[:4]) & mask, zlib.crc32(b"6" + x[:6]) & mask}) if x else ()
            out.update(s)
        return np.fromiter(out, np.int64, len(out))


def lowered(text: bytes) -> list[bytes]:
    return text.lower().split()


class Sparse:
    def __init__(self, rows: list[np.ndarray], size: int):
        self.n, self.size = len(rows), size
        lens = np.array([len(r) for r in rows], np.int64)
        self.cols = np.concatenate(rows) if self.n else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(self.n), lens)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.cols], self.n) if self.n else np.zeros(0)


def train(x: Sparse, extra: np.ndarray, y: np.ndarray, use: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Weights of slots, extra columns, intercept, from the rows where use is true."""
    size, k, pos, neg = x.size, extra.shape[1], use & (y > 0), use & (y == 0)
    out = np.zeros(size + k + 1)
    if not pos.any() or not neg.any():
        out[-1] = 30.0 if pos.any() else -30.0
        return out
    p = np.bincount(x.cols, pos[x.owner], size) + 0.5
    q = np.bincount(x.cols, neg[x.owner], size) + 0.5
    ratio = np.log(p / (pos.sum() + 1)) - np.log(q / (neg.sum() + 1))
    ratio[p + q < 4] = 0  # slots that fewer than three training rows have
    live = use[x.owner] & (np.abs(ratio[x.cols]) > 0.7)
    cols, owner = x.cols[live], x.owner[live]
    w, past, total = np.zeros(size + k + 1), np.full(size + k + 1, 1e-8), use.sum()
    scale = np.concatenate([ratio, np.ones(k + 1)])
    for _ in range(rounds):
        z = np.bincount(owner, (w[:size] * ratio)[cols], x.n) + extra @ w[size:-1] + w[-1]
        err = np.where(use, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - (y > 0), 0) / total
        grad = np.concatenate([np.bincount(cols, err[owner], size) * ratio, extra.T @ err, [err.sum()]])
        grad[:-1] += 1e-5 * w[:-1]
        past += grad * grad
        w -= 0.3 * grad / np.sqrt(past)
    w *= scale
    w[:size][np.abs(ratio) <= 0.7] = 0
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def kinds(rows: list[np.ndarray], toxic: np.ndarray, size: int, rounds: int = 40) -> np.ndarray:
    """For each row and kind whether the row is of it (rows that aren't toxic are of none): a mixture over the slots that toxic rows have far more often.
    It starts from the most frequent such slot and the one that most often comes without it."""
    x, out = Sparse(rows, size), np.zeros((len(rows), KINDS))
    pos, neg = np.bincount(x.cols, toxic[x.owner] > 0, size), np.bincount(x.cols, toxic[x.owner] <= 0, size)
    ratio = np.log((pos + 0.5) / ((toxic > 0).sum() + 1)) - np.log((neg + 0.5) / ((toxic <= 0).sum() + 1))
    marks = np.flatnonzero((ratio > 1.5) & (pos >= 3))
    if len(marks) < KINDS:
        return out
    place = np.full(size, -1)
    place[marks] = np.arange(len(marks))
    live = (toxic[x.owner] > 0) & (place[x.cols] >= 0)
    owner, mark = x.owner[live], place[x.cols[live]]
    first = int(np.argmax(pos[marks]))
    with_first = np.bincount(owner[mark == first], minlength=len(rows)) > 0
    apart = np.bincount(mark, ~with_first[owner], len(marks)) - np.bincount(mark, with_first[owner], len(marks))
    with_second = np.bincount(owner[mark == int(np.argmax(apart))], minlength=len(rows)) > 0
    share = np.full((len(rows), KINDS), 0.5)
    share[with_first & ~with_second], share[with_second & ~with_first] = (0.9, 0.1), (0.1, 0.9)
    some = np.bincount(owner, minlength=len(rows)) > 0
    for _ in range(rounds):
        count = np.stack([np.bincount(mark, share[owner, k], len(marks)) for k in range(KINDS)]) + 0.5
        log = np.log(count / count.sum(1, keepdims=True))
        z = np.stack([np.bincount(owner, log[k][mark], len(rows)) for k in range(KINDS)], axis=1) + np.log(share[some].sum(0) + 1)
        share = np.exp(z - z.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
    out[some, share[some].argmax(1)] = 1
    return out


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, size: int, fits=None) -> list[np.ndarray]:
    """labels: a column for each category, in the chain's order. fits(extra, y, which): the weights of train() for each set of rows in which."""
    x, extra, models = Sparse(rows, size), np.zeros((len(rows), 0)), []
    fits = fits or (lambda extra, y, which: [train(x, extra, y, use) for use in which])
    for c in range(labels.shape[1]):
        y, held = labels[:, c], np.zeros(len(rows))
        *parts, whole = fits(extra, y, [*(folds != f for f in range(FOLDS)), np.ones(len(rows), bool)])
        for f, w in enumerate(parts):
            held = np.where(folds == f, sigmoid(x.dot(w) + extra @ w[size:-1] + w[-1]), held)
        models.append(whole)
        extra = np.column_stack([extra, held])
    return models


def fits_as_tasks(spark: SparkSession, rows: list[np.ndarray], size: int):
    """fits for fit_chain(), and what ends them: a category's folds don't wait for each other, so each is a task. What tasks get is broadcast once: the bounded
    sample's features, without the slots of fewer than three rows, which train() leaves out wherever they are."""
    lens = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    common = np.bincount(flat, minlength=size)[flat] >= 3
    ends = np.concatenate([[0], np.cumsum(common)])[np.concatenate([[0], np.cumsum(lens)])]
    shared = spark.sparkContext.broadcast((flat[common].astype(np.int32), ends))

    def fits(extra, y, which):
        def run(batches):
            slots, ends = shared.value
            for b in batches:
                for k in b.column(0).to_pylist():
                    w = train(Sparse([slots[lo:hi].astype(np.int64) for lo, hi in zip(ends, ends[1:], strict=False)], size), extra, y, which[k])
                    at = np.flatnonzero(w).astype("<i4")
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at.tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary())], names=["k", "at", "w"])

        out = [np.zeros(size + extra.shape[1] + 1) for _ in which]
        for r in spark.range(0, len(which), 1, len(which)).mapInArrow(run, "k long, at binary, w binary").collect():
            out[r[0]][np.frombuffer(r[1], "<i4")] = np.frombuffer(r[2])
        return out

    return fits, shared.destroy


def apply_chain(rows: list[np.ndarray], models: list[np.ndarray], size: int) -> np.ndarray:
    x, extra = Sparse(rows, size), np.zeros((len(rows), 0))
    for w in models:
        extra = np.column_stack([extra, sigmoid(x.dot(w) + extra @ w[size:-1] + w[-1])])
    return extra


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability for each category of CHAIN, and toxic: whether the last is at the threshold. labels: doc_id, toxic."""
    docs = plain(docs)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("y")).filter("y is not null AND doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def gather(batches):
        own = Words()
        for ids, texts in chunks(batches, TEXT_BYTES, [("doc_id", "<i8"), ("y", "<i4")]):
            yield pa.RecordBatch.from_arrays([pa.array(ids["doc_id"]), pa.array(ids["y"]), pa.array([own.slots(lowered(t)).astype("<i4").tobytes() for t in texts], pa.binary())], names=["doc_id", "y", "slots"])

    size = 1 << BITS
    one = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted((r[0], r[1], r[2]) for r in one.mapInArrow(gather, "doc_id long, y int, slots binary").toLocalIterator())
    slots = [np.frombuffer(r[2], "<i4").astype(np.int64) for r in rows]
    toxic = np.array([r[1] > 0 for r in rows], float)
    target = np.column_stack([kinds(slots, toxic, size), toxic])
    folds = np.array([zlib.crc32(str(r[0]).encode()) % FOLDS for r in rows], np.int64)
    fits, done = fits_as_tasks(docs.sparkSession, slots, size)
    models = [(np.flatnonzero(w).astype(np.int32), w[np.flatnonzero(w)]) for w in fit_chain(slots, target, folds, size, fits)]
    done()

    def run(batches):
        own, full = Words(), []
        for i, (at, value) in enumerate(models):
            full.append(np.zeros(size + i + 1))
            full[-1][at] = value
        for ids, texts in chunks(batches, TEXT_BYTES):
            words = [lowered(t) for t in texts]
            p = apply_chain([own.slots(w) for w in words], full, size)
            p[[not w for w in words]] = 0
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.round(p[:, j], 6)) for j in range(len(CHAIN)))], names=["doc_id", *(f"p_{c}" for c in CHAIN)])

    out = docs.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN))
    return out.select(id_out(), *[f"p_{c}" for c in CHAIN], (F.col(f"p_{CHAIN[-1]}") >= threshold).alias("toxic"))
