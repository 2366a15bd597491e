"""Words and hashed features that the classifiers share."""

from __future__ import annotations

import zlib

import numpy as np

BITS = 16


class Features:
    """Documents as sparse rows: hashed words that occur, each with weight 1 / sqrt(distinct words)."""

    def __init__(self, bits: int = BITS):
        self.size, self.cache = 1 << bits, {}

    def slots(self, words: list[bytes]) -> np.ndarray:
        cache, size = self.cache, self.size
        if len(cache) > 150_000:
            cache.clear()
        out = []
        for w in set(words):
            s = cache.get(w)
            if s is None:
                s = cache[w] = zlib.crc32(w) % size
            out.append(s)
        return np.array(out, np.int64)


def logistic(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, size: int, weight: np.ndarray | None = None, rounds: int = 60, rate: float = 0.5, l2: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights of hashed slots, then of the extra columns, then the intercept: full-batch Adagrad on the logistic loss; y may hold probabilities."""
    n, k = len(rows), extra.shape[1]
    lens = np.array([len(r) for r in rows], np.int64)
    cols = np.concatenate(rows) if n and lens.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), lens)
    value = np.repeat(1 / np.sqrt(np.maximum(lens, 1)), lens)
    sample = np.ones(n) if weight is None else weight
    sample = sample / max(sample.sum(), 1e-9)
    w, past = np.zeros(size + k + 1), np.full(size + k + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(owner, w[cols] * value, n) + extra @ w[size:-1] + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * sample
        grad = np.concatenate([np.bincount(cols, err[owner] * value, size), extra.T @ err, [err.sum()]])
        grad[:-1] += l2 * w[:-1] * (1 / max(n, 1))
        past += grad * grad
        w -= rate * grad / np.sqrt(past)
    return w


def scores(rows: list[np.ndarray], extra: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    n = len(rows)
    lens = np.array([len(r) for r in rows], np.int64)
    cols = np.concatenate(rows) if n and lens.sum() else np.zeros(0, np.int64)
    z = np.bincount(np.repeat(np.arange(n), lens), w[cols] * np.repeat(1 / np.sqrt(np.maximum(lens, 1)), lens), n)
    return 1 / (1 + np.exp(-np.clip(z + extra @ w[size:-1] + w[-1], -30, 30)))
