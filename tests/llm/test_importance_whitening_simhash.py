"""Importance resampling, whitening and SimHash against plain versions, on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from archivolt.llm import importance, simhash, whitening
from archivolt.llm.common import joined_back, plain
from archivolt.llm.importance import importance_resample
from archivolt.llm.simhash import simhash_dedup
from archivolt.llm.whitening import block_lanczos, whiten

r = random.Random(11)
VOCABULARY = ["Alpha", "beta", "GAMMA", "delta", "the", "of", "É", "naïve", "x1", "中文", "w-z", "don't"]
PROSE = [" ".join(r.choice(VOCABULARY) for _ in range(r.randint(15, 60))) for _ in range(40)]
ROWS = [(i, t) for i, t in enumerate(PROSE)] + [(100, None), (101, ""), (102, " \n\t.,"), (103, "one"), (104, "ONE"), (105, PROSE[0]), (105, PROSE[1]), (None, PROSE[2]), (None, PROSE[2]), (None, None), (106, PROSE[3] + " ") , (7, PROSE[7])]
TARGET = [(1, "alpha beta alpha beta naïve"), (2, None), (3, PROSE[4])]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in ("rank", "score", "row", "print", "size", "cell", "n_words", "weight"):
        df = df.withColumn(c, F.lit("?"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(TARGET, "item_id long, text string")


def features(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return len(w), w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]


def plain_draw(rows, target, percent=25, least=20):
    """id, n_features, weight, score of each row, and the ranks by id and score."""
    bucket = lambda g: zlib.crc32(g) % 10_000
    s, t = Counter(bucket(g) for _, x in rows for g in features(x)[1]), Counter(bucket(g) for _, x in target for g in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    out = []
    for i, x in rows:
        words, f = features(x)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((words, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-score, -(2**63) if i is None else i) for words, i, _, _, score in out if words >= least)
    return [x[1:] for x in out], able[: percent * len(able) // 100]


def test_importance(docs, target):
    rows, ranked = plain_draw(ROWS, TARGET)
    got = importance_resample(docs, target).collect()
    assert sorted(tuple(x)[:4] for x in got if x.doc_id is not None) == sorted(x for x in rows if x[0] is not None)
    assert sorted(tuple(x)[1:4] for x in got if x.doc_id is None) == sorted(x[1:] for x in rows if x[0] is None)
    drawn = sorted((x.rank, -x.score, -(2**63) if x.doc_id is None else x.doc_id) for x in got if x.rank)
    assert [x[0] for x in drawn] == list(range(1, len(ranked) + 1)) and [x[1:] for x in drawn] == ranked
    assert importance_resample(docs.limit(0), target).count() == 0
    assert importance_resample(docs, target.limit(0)).count() == len(ROWS)
    assert importance_resample(docs, target, percent=0).filter("rank IS NOT NULL").count() == 0


def test_importance_of_long_runs(docs, monkeypatch):
    """Runs of one to three words; texts in pieces of a few bytes; tries that start anew in between."""
    for order in (1, 2, 3):
        whole = Counter()
        for _, x in ROWS:
            w = re.findall(rb"[0-9a-z\x80-\xff]+", (x or "").encode().lower())
            whole.update(zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in range(1, order + 1) for i in range(len(w) - k + 1))
        want = np.array([whole[b] for b in range(10_000)])
        assert (importance.bucket_totals(plain(docs), order) == want).all()
        monkeypatch.setattr(importance, "PIECE", 7)
        pieces = [p for _, x in ROWS for p in importance.pieces_of((x or "").encode(), order)]
        monkeypatch.undo()
        assert len(pieces) > 2 * len(ROWS) and (order == 1 or any(c for _, c in pieces))
        trie, total = importance.Trie(order), np.zeros(10_000, np.int64)
        for p in pieces:
            trie.count([p])
            if len(trie.states) > 30:
                total += trie.totals()
                trie.clear()
        assert (total + trie.totals() == want).all()


def test_very_long_text(spark, target):
    long = " ".join(r.choice(VOCABULARY) for _ in range(250_000))
    rows = [(1, long), (2, PROSE[0]), (3, long)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = plain_draw(rows, TARGET)
    assert sorted(tuple(x)[:4] for x in importance_resample(d, target).collect()) == sorted(want)
    got = {x.doc_id: x for x in simhash_dedup(d).collect()}
    assert got[3].component_id == got[1].component_id == 1 and got[1].fingerprint == f"{plain_print(long):016x}"


VECTORS = [(i, [r.gauss(0, 1) * (5 - j % 5) for j in range(20)]) for i in range(120)]
BAD = [(500, None), (501, [None] + [0.0] * 19), (502, [float("nan")] * 20), (503, [float("inf")] + [1.0] * 19), (504, [1.0]), (505, []), (506, [1e300] * 20)]


def plain_whitening(rows, most=16):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ axes / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening(spark):
    rows = [*VECTORS, (200, VECTORS[3][1]), (None, VECTORS[4][1]), VECTORS[0]]
    d = spark.createDataFrame(rows + BAD, "vec_id long, embedding array<double>").withColumn("n", F.lit("?")).withColumn("v", F.lit(1)).withColumn("component", F.lit(1)).repartition(4)
    got = whiten(d).collect()
    n, deviation, white, explained = plain_whitening(rows)
    assert len(got) == 16 * len(rows) and {x.n for x in got} == {n} == {120}
    by = {(x.vec_id, x.component): x for x in got}
    sign = np.sign([by[1, k + 1].whitened * white[1, k] for k in range(16)])
    for at, (i, _) in enumerate(rows):
        for k in range(16):
            x = by[i, k + 1]
            assert x.deviation == deviation[at] and abs(x.explained - explained[k]) < 1e-10
            assert abs(x.whitened * sign[k] - white[at, k]) < 1e-8
    assert {x.identity_error for x in got}.pop() < 1e-9
    # floats of another width, blocks narrower than what is wanted
    few = whiten(d.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).filter("vec_id < 120"), components=5, block=2).collect()
    assert {x.component for x in few} == {1, 2, 3, 4, 5}


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame(BAD[:2], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    # two directions vary, five don't: only two components
    flat = [(i, [float(i % 7), 2.0 * (i % 5), 1.0, 1.0, float(i % 7), 0.0, 3.0]) for i in range(60)]
    got = whiten(spark.createDataFrame(flat, schema)).collect()
    assert {x.component for x in got} == {1, 2} and max(x.identity_error for x in got) < 1e-9


def test_lanczos():
    """Repeated eigenvalues, invariant subspaces, clusters, and far more dimensions than are wanted."""
    g = np.random.default_rng(2)
    for d, values, wanted, block in ((40, [9.0] * 6 + [1.0] * 34, 8, 3), (30, [5.0, 4.0, 0.0], 10, 4), (300, np.geomspace(1, 1e-6, 300), 16, 16), (50, [2.0] * 50, 4, 2), (3, [3.0, 2.0, 1.0], 16, 16), (64, np.linspace(1, 0.9, 64), 16, 8)):
        full = np.zeros(d)
        full[: len(values)] = values
        q, _ = np.linalg.qr(g.standard_normal((d, d)))
        m = (q * full) @ q.T
        found, axes, products = block_lanczos(lambda b, m=m: m @ b, d, wanted, block)
        want = np.sort(full)[::-1][: min(wanted, d)]
        assert np.abs(found - want).max() < 1e-10 * max(full), (d, found)
        assert np.abs(m @ axes - axes * found).max() < 1e-9 and np.abs(axes.T @ axes - np.eye(len(found))).max() < 1e-10
        assert products <= d // block + 2 and (d != 300 or products < 13)


def test_packing():
    x = np.array([[0, 1, -1], [2**20, 0, 0], [2**40, 1, 2], [-(2**15), 0, 0], [2**15 - 1, 0, 0]], np.int64)
    rows = whitening.packed(x + whitening.SHIFT)
    assert (whitening.unpacked(rows, 3) == x).all() and [len(b) for b in rows] == [7, 13, 25, 13, 7]
    assert whitening.deviations(np.array([[2**40, 0]]), [0, 0], 2**20) == [None]
    assert whitening.deviations(np.array([[3, 1]]), [4, 4], 2).tolist() == [8]


def plain_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    prints = {i: plain_print(t) for i, (_, t) in enumerate(ROWS)}
    root = {i: {j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3} for i in prints}
    for _ in prints:
        root = {i: set().union(*(root[j] for j in root[i])) for i in root}
    least = lambda i: min(-(2**63) if ROWS[j][0] is None else ROWS[j][0] for j in root[i])
    want = sorted((ROWS[i][0] or -1, f"{prints[i]:016x}", least(i)) for i in prints)
    got = sorted((x.doc_id or -1, x.fingerprint, -(2**63) if x.component_id is None else x.component_id) for x in simhash_dedup(docs).collect())
    assert got == want
    assert simhash_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("distance", "width"), [(3, 2), (3, 4), (3, 8), (1, 2), (5, 4), (0, 2)])
def test_links_by_segment_counts(spark, distance, width):
    """Against all pairs: prints around a few centres, all flips of single bits, and the ends of the range."""
    g = random.Random(distance * 10 + width)
    prints = {0, 2**64 - 1, 2**63, 1}
    for _ in range(3):
        centre = g.getrandbits(64)
        prints |= {centre ^ (1 << b) for b in range(64)}
        prints |= {centre ^ sum(1 << b for b in g.sample(range(64), g.randint(1, 6))) for _ in range(60)}
    want = {(min(a, b), max(a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= distance}
    nodes = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "print long")
    got = {tuple(sorted(v % 2**64 for v in x)) for x in simhash.linked_prints(nodes, distance, width).collect()}
    assert got == want


def test_segment_counts(spark):
    g = random.Random(1)
    prints = [g.getrandbits(64) for _ in range(50)] + [0, 2**64 - 1]
    rows = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "print long")
    for width in (2, 4, 8):
        got = [x.c % 2**64 for x in rows.select(simhash.segment_counts(F.col("print"), width).alias("c")).collect()]
        for p, c in zip(prints, got, strict=True):
            for i in range(0, 64, width):
                assert c >> i & (1 << width) - 1 == (p >> i & (1 << width) - 1).bit_count()


def test_hot_keys_join_back(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(3000)], "doc_id long, k long")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("m"))
    out = joined_back(rows, groups, "k")
    assert out.count() == 3000 and out.filter("k = 0").select("m").distinct().collect()[0][0] == 0
    assert joined_back(rows.limit(0), groups.limit(0), "k").count() == 0
