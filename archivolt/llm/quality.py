"""Quality classifier from weak labels.

Heuristic labellers vote keep, reject or nothing on each document.  Vote patterns are counted over all
documents (there are at most 3 ** labellers of them, so the counts fit the driver), and
expectation-maximisation over the counts estimates how often each labeller is right.
A pattern's posterior is the label of the documents that have it; on a bounded sample of those (SAMPLE
documents, those whose id and text have the smallest hash), a linear scorer of hashed words and the heuristics' own values is trained.
All documents are scored as a whole.

Defined cases: a null text is empty; an empty text has score 0 and is rejected; a null doc_id stays
null; repeated rows come out repeated; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, filtered, id_out, plain, smallest_hashes
from .labels import Features, logistic, scores

TEXT_BYTES, SAMPLE, THRESHOLD = 1 << 20, 8_000, 0.5
ABSTAIN, KEEP, REJECT = 0, 1, 2
#: A measure, up to which value it counts as calm, and from which its labeller votes reject.
MEASURES = (
    ("symbols", 0.02, 0.08),
    ("capitals", 0.12, 0.40),
    ("doubled", 0.04, 0.10),
    ("bars", 0.01, 0.10),
    ("marked", 0.05, 0.30),
    ("length", 9.0, 16.0),
    ("digits", 0.05, 0.30),
)
#: Labellers that vote reject or nothing, one for each measure, and two that vote keep or nothing.
LABELLERS = (*(m[0] for m in MEASURES), "calm", "clean words")
SYMBOLS = b"!#$%&*+/<=>@\\^_`{|}~"
UPPERCASE, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def measures(text: bytes, words: list[bytes]) -> list[float]:
    """In the order of MEASURES: symbols a byte, capitals a byte, words like the one before, words that
    are a bar, words that end in two symbols, mean bytes of a word, digits a byte; then words of at most three bytes."""
    n, m = max(1, len(text)), max(1, len(words))
    count = lambda of: len(text) - len(text.translate(None, of))
    lens = list(map(len, words))
    return [
        count(SYMBOLS) / n,
        count(UPPERCASE) / n,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        words.count(b"|") / m,
        sum(len(w) > 1 and w[-1] in SYMBOLS and w[-2] in SYMBOLS for w in words) / m,
        sum(lens) / m,
        count(DIGITS) / n,
        sum(x <= 3 for x in lens) / m,
    ]


def votes(values: np.ndarray) -> np.ndarray:
    """A row of votes for each row of measures."""
    values = values.reshape(-1, len(MEASURES) + 1)
    low, high = (np.array([x[i] for x in MEASURES]) for i in (1, 2))
    own = values[:, :-1]
    rejects = np.where(own >= high, REJECT, ABSTAIN)
    calm = np.where((own <= low).all(1), KEEP, ABSTAIN)
    clean = np.where((own[:, :3] <= low[:3]).all(1), KEEP, ABSTAIN)
    return np.column_stack([rejects, calm, clean])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns. Given the class, each vote that a labeller casts is right with the
    labeller's accuracy, and abstaining says nothing.  Returns each pattern's posterior of keep and each labeller's
    accuracy.  Either class has prior
    one half: labellers that vote one way only can't tell it.  Accuracies start at 0.9 and stay between 0.6 and 0.99, so the classes can't change places."""
    p, k = patterns.shape
    right = np.full(k, 0.9)
    good = np.full(p, 0.5)
    if not p:
        return good, right
    for _ in range(rounds):
        odds = np.log(right) - np.log(1 - right)
        z = (patterns == KEEP) @ odds - (patterns == REJECT) @ odds
        new = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        correct = ((patterns == KEEP) * new[:, None] + (patterns == REJECT) * (1 - new[:, None])) * counts[:, None]
        cast = (patterns != ABSTAIN) * counts[:, None]
        right = np.clip((correct.sum(0) + 8) / (cast.sum(0) + 10), 0.6, 0.99)
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return good, right


def voted(docs: DataFrame) -> DataFrame:
    """doc_id, pattern: the votes as a number to base 3."""

    def run(batches):
        place = 3 ** np.arange(len(LABELLERS))
        for ids, texts in chunks(batches, TEXT_BYTES):
            v = votes(np.array([measures(t, t.split()) for t in texts]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(v @ place)], names=["doc_id", "pattern"])

    return docs.mapInArrow(run, "doc_id long, pattern long")


def featured(docs: DataFrame) -> DataFrame:
    def run(batches):
        own = Features()
        for ids, texts in chunks(batches, TEXT_BYTES):
            words = [t.split() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([own.slots(w).astype("<i4").tobytes() for w in words], pa.binary()), pa.array([measures(t, w) for t, w in zip(texts, words, strict=True)], pa.list_(pa.float64()))], names=["doc_id", "slots", "values"])

    return docs.mapInArrow(run, "doc_id long, slots binary, values array<double>")


class Model:
    def __init__(self, posterior: dict[int, float], accuracy: np.ndarray, weights: np.ndarray):
        self.posterior, self.accuracy, self.weights = posterior, accuracy, weights


SCALE = np.array([*(1 / x[2] for x in MEASURES), 1.0])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id and text as plain() gives them."""
    k = len(LABELLERS)
    found = voted(docs).groupBy("pattern").count().orderBy("pattern").collect()
    codes = np.array([r[0] for r in found], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(k)) % 3 if len(codes) else np.zeros((0, k), np.int64)
    good, accuracy = estimate(patterns, np.array([r[1] for r in found], float))
    posterior = dict(zip(codes.tolist(), good.tolist(), strict=True))
    taken = smallest_hashes(docs.withColumn("h", F.xxhash64("doc_id", "text")), sample, "doc_id").select("doc_id", "text")
    rows = sorted((r[0], r[1], r[2]) for r in featured(taken).toLocalIterator())
    size = Features().size
    if not rows:
        return Model(posterior, accuracy, np.zeros(size + len(SCALE) + 1))
    values = np.array([r[2] for r in rows])
    label = np.array([posterior.get(int(x), 0.5) for x in votes(values) @ 3 ** np.arange(k)])
    slots = [np.frombuffer(r[1], "<i4").astype(np.int64) for r in rows]
    return Model(posterior, accuracy, logistic(slots, np.minimum(values * SCALE, 3), label, size, rounds=150))


def scorer(weights: np.ndarray):
    """Texts to scores; an empty text's is 0."""
    own = Features()

    def run(texts: list[bytes]) -> np.ndarray:
        words = [t.split() for t in texts]
        values = np.array([measures(t, w) for t, w in zip(texts, words, strict=True)])
        s = scores([own.slots(w) for w in words], np.minimum(values * SCALE, 3), weights, own.size)
        s[[not w for w in words]] = 0
        return s

    return run


def quality(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of keep), keep."""
    docs = plain(docs)
    weights = fit(docs, sample).weights

    def run(batches):
        score = scorer(weights)
        for ids, texts in chunks(batches, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(score(texts))], names=["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select(id_out(), F.round("score", 6).alias("score"), (F.round("score", 6) >= threshold).alias("keep"))


def quality_filter(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that quality() keeps, all columns, where they lie."""
    weights = fit(plain(docs), sample).weights

    def make():
        score = scorer(weights)
        return lambda texts: np.round(score(texts), 6) >= threshold

    return filtered(docs, make, TEXT_BYTES)
