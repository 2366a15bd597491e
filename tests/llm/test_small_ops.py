"""Each operator on small, awkward tables, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.llm import bpe, decontaminate, pitman_yor, quality, suffix_dedup, toxicity, url_filter
from archivolt.llm.components import components
from archivolt.llm.exact_dedup import exact_dedup
from archivolt.llm.near_dedup import band_keys, near_dedup, possible, registers, shingle_sets
from archivolt.llm.queries import tokenizer_path
from archivolt.llm.substring_dedup import substring_dedup

from . import brute

rnd = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "É", "x"]
BASE = [" ".join(rnd.choice(WORDS) for _ in range(60)) for _ in range(4)] + ["word " * 100, "y" * 400]
TEXTS = [(i, rnd.choice(BASE)[rnd.randint(0, 80) :][: rnd.randint(0, 400)] + (" " + rnd.choice(BASE) if i % 3 else "")) for i in range(50)]
TEXTS += [(50, None), (51, ""), (52, "  \n\t "), (53, "one"), (54, "ONE"), (55, BASE[0]), (56, BASE[0])]


@pytest.fixture(scope="module")
def docs(spark):
    """With other columns whose names the operators use themselves, and rows that repeat."""
    df = spark.createDataFrame(TEXTS + [TEXTS[3]], "doc_id long, text string")
    return df.withColumn("kept", F.lit("?")).withColumn("bucket", F.lit(1)).withColumn("n", F.lit(2)).withColumn("key", F.lit(3)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def plain_texts():
    return {i: (t or "").encode() for i, t in TEXTS}


@pytest.mark.parametrize(("op", "plain"), [(suffix_dedup.suffix_dedup, brute.suffix_dedup), (substring_dedup, brute.substring_dedup)])
def test_repeats(docs, empty, op, plain):
    expected = plain(plain_texts())
    rows = op(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert tuple(r)[1 : 1 + len(expected[r.doc_id])] == expected[r.doc_id], r.doc_id
    assert op(empty).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "z" * 150), (1, "z" * 150), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df).collect()}
    assert rows[1].n_removed == 150 and rows[None].n_removed == 149 and rows[2].n_bytes == 0
    kept = {r.doc_id: r for r in exact_dedup(df).collect()}
    assert kept[None].keep_id == 1 and not kept[None].kept and kept[1].group_size == 2
    assert {r.doc_id for r in near_dedup(df, 2).collect()} == {None, 1, 2}


@pytest.mark.parametrize("alphabet", [1, 2, 4, 256])
def test_two_stage_sorting(alphabet):
    r = random.Random(alphabet)
    for n in (1, 2, 3, 50, 400):
        t = bytes(r.randrange(alphabet) for _ in range(n))
        sa = suffix_dedup.suffix_array(np.frombuffer(t, np.uint8), n + 8).tolist()
        assert sorted(sa) == list(range(n))
        padded = t + bytes(n + 8)
        assert all(padded[i : i + n] <= padded[j : j + n] for i, j in zip(sa, sa[1:], strict=False))


def test_exact(docs, empty):
    groups: dict[str, list[int]] = {}
    for i, t in [*TEXTS, TEXTS[3]]:
        groups.setdefault(t or "", []).append(i)
    of = {i: g for g in groups.values() for i in g}
    for digest in (F.xxhash64, lambda c: F.length(c) % 3):  # the second one confuses many chunks
        rows = exact_dedup(docs, digest).collect()
        assert len(rows) == len(TEXTS) + 1
        for r in rows:
            assert (r.keep_id, r.group_size, r.kept) == (max(of[r.doc_id]), len(of[r.doc_id]), r.doc_id == max(of[r.doc_id]))
            assert r.text_sha256 == hashlib.sha256(plain_texts()[r.doc_id]).hexdigest()
    assert exact_dedup(empty).count() == 0


def test_chunks_make_up_the_text(docs):
    from archivolt.llm.exact_dedup import chunk_list

    long = docs.select(F.concat(F.repeat(F.coalesce("text", F.lit("")), 200), F.lit("end")).alias("text"))
    assert long.select((F.array_join(chunk_list(F.col("text")), "") == F.col("text")).alias("same")).filter("NOT same").isEmpty()


@pytest.mark.parametrize("k", [2, 5])
def test_near(docs, empty, k):
    expected = brute.near_components(plain_texts(), k)
    rows = near_dedup(docs, k).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id], r.doc_id
        assert r.kept == (r.doc_id == r.component_id)
    assert near_dedup(empty, k).count() == 0


def test_sketch_estimates():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    for both, each in ((1000, 60), (500, 500), (100, 900)):
        a, b = np.unique(np.concatenate([pool[:both], pool[both : both + each]])), np.unique(np.concatenate([pool[:both], pool[both + each : both + 2 * each]]))
        regs = registers([a, b, np.union1d(a, b)])
        assert (np.maximum(regs[0], regs[1]) == regs[2]).all()  # mergeable
        share = (regs[0] == regs[1]).mean()
        assert abs(share - both / (both + 2 * each)) < 0.12
        n = np.array([len(a)]), np.array([len(b)])
        assert possible(regs[:1], regs[1:2], *n, 0.8)[0] == (both == 1000)
    assert band_keys(regs).shape == (3, 40)
    assert len(shingle_sets([b"a b"], 5)[0]) == 1 and not len(shingle_sets([b" "], 5)[0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[200] == got[101] == got[100] == 100


def test_bpe_is_tiktoken(docs, empty):
    import public_tokenizers
    import tiktoken

    path = tokenizer_path()
    ranks = bpe.load_ranks(path)
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Bpe(ranks)
    r = random.Random(2)
    alphabet = list(" \n\t'srtvelmdLX19!?.,é—　 中😀ñÅ<|>") + [chr(c) for c in (0x1C89, 0x10D40, 0xA7CB, 0x85, 0x200B)]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, "'" * 300, " " * 999 + "x", "it's 'S ''s 're'll'l l", "<|endoftext|>"]
    for t, (ids, cuts) in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == real.encode_ordinary(t)
        assert own.decode(ids) == t.encode() and (not cuts or cuts[0][0] == 0 and cuts[-1][1] == len(t.encode()))
    for row in bpe.bpe_round_trip(docs, path).collect():
        raw = plain_texts()[row.doc_id]
        ids = np.array(real.encode_ordinary(raw.decode()), "<u4")
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
    back = {x.doc_id: x.text for x in bpe.bpe_decode(bpe.bpe_encode(docs, path), path).collect()}
    assert back == {i: t or "" for i, t in TEXTS}
    assert bpe.bpe_round_trip(empty, path).count() == 0


def brute_tiles(a, b, least):
    """The longest unmarked match first, the first in a and then in b of equals."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] >= 0 and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        out.append((i, j, n))
        fa[i : i + n] = fb[j : j + n] = [False] * n


def test_tiles():
    r = random.Random(3)
    for _ in range(60):
        a, b = ([r.randrange(-1, 4) for _ in range(r.randint(3, 40))] for _ in range(2))
        got, want = decontaminate.tile(np.array(a), np.array(b), 3), brute_tiles(a, b, 3)
        assert sorted(n for _, _, n in got)[::-1][:1] == sorted(n for _, _, n in want)[::-1][:1]
        assert abs(sum(n for _, _, n in got) - sum(n for _, _, n in want)) <= 3  # equal lengths may be marked in another order


def test_decontaminate(spark, empty):
    item = " ".join(f"w{i}" for i in range(40))
    w = item.split()
    moved = " ".join(w[20:]) + " junk " + " ".join(w[:20])
    rows = [(1, "pad " + item + " pad"), (2, moved.upper()), (3, " ".join(w[:10])), (4, None), (5, "nothing here"), (6, "tiny item")]
    d = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, item), (3, "tiny item"), (4, ""), (5, None)], "item_id long, text string")
    for block in (1 << 20, 100):
        got = sorted((r.doc_id, r.item_id, r.contaminated, round(r.coverage, 3)) for r in decontaminate.decontaminate(d, b, block_bytes=block).collect())
        assert got == [(1, 1, True, 1.0), (1, 1, True, 1.0), (2, 1, True, 1.0), (3, 1, False, 0.25), (4, None, False, 0.0), (5, None, False, 0.0), (6, 3, True, 1.0)]
        assert sorted(r.doc_id for r in decontaminate.decontamination_filter(d, b, block_bytes=block).collect()) == [3, 4, 5]
    assert decontaminate.decontaminate(empty, b).count() == 0
    assert decontaminate.decontaminate(d, b.limit(0)).filter("contaminated").count() == 0


def test_weak_labels():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.6
    right = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(r.random((4000, 4)) < right, np.where(truth, quality.KEEP, quality.REJECT)[:, None], np.where(truth, quality.REJECT, quality.KEEP)[:, None])
    votes = np.where(r.random((4000, 4)) < 0.3, quality.ABSTAIN, votes)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, found = quality.estimate(patterns, counts.astype(float))
    assert np.abs(found - right).max() < 0.05
    assert ((good > 0.5)[at.ravel()] == truth).mean() > 0.9


def test_quality(spark, docs, empty):
    prose = [(i, " ".join(rnd.sample([f"{a}{b}" for a in ("plain", "prose", "word", "lin") for b in ("s", "es", "ing", "er", "ly", "ed")], 20)) + ".") for i in range(300)]
    junk = [(1000 + i, " ".join(rnd.choice(["BUY!!", "NOW!!", "$$$$$$", "***###", "x%%%"]) for _ in range(40))) for i in range(100)]
    d = spark.createDataFrame([*prose, *junk, (5000, ""), (5001, None), (None, prose[0][1])], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(d).collect()}
    assert all(got[i].keep for i, _ in prose) and not any(got[i].keep for i, _ in junk)
    assert not got[5000].keep and not got[5001].keep and got[None].keep
    assert {r.doc_id for r in quality.quality_filter(d).collect()} == {i for i, r in got.items() if r.keep}
    assert quality.quality(docs).count() == len(TEXTS) + 1 and quality.quality(empty).count() == 0


def test_toxicity(spark, docs, empty):
    clean = [(i, " ".join(rnd.choice(WORDS) for _ in range(30))) for i in range(400)]
    bad = [(1000 + i, " ".join([rnd.choice(WORDS) for _ in range(25)] + [rnd.choice(["idiot", "moron", "stupid", "vequa", "vequo"]) for _ in range(3)])) for i in range(200)]
    d = spark.createDataFrame([*clean, *bad, (5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean[:300]] + [(i, 1) for i, _ in bad[:150]] + [(77777, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(d, labels).collect()}
    held = [got[i] for i, _ in bad[150:]], [got[i] for i, _ in clean[300:]]
    assert np.mean(held[0]) > 0.95 and np.mean(held[1]) < 0.05 and not got[5000]
    assert toxicity.toxicity(d, labels.limit(0)).filter("toxic").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(docs, labels).count() == len(TEXTS) + 1


def url_brute(rows):
    """Host, path and rule of each url."""
    out = {}
    for i, u in rows:
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [r for r, _ in url_filter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        out[i] = (host, path, max(fit, key=len) if fit else None)
    return out


def test_urls(spark):
    rows = [(i, f"https://{a}.good{i % 7}.org/fr/{i}") for i in range(60) for a in ["news"]] + [(100 + i, f"http://spam{i % 5}.example.net/x/{i}") for i in range(60)]
    rows += [(300, "https://News.Good1.ORG/en/5?a=b"), (301, "http://spam3.example.info/x/9"), (302, None), (303, "no scheme"), (304, "ftp://net"), (305, "x://a.net/"), (306, "x://a.example.net/en/"), (307, "x://example.com/de/1#f"), (308, "x://b.org?q=/fr/"), (309, "://")]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("?")).withColumn("rule", F.lit(1))
    got = {r.page_id: r for r in url_filter.url_filter(d).collect()}
    assert len(got) == len(rows)
    for i, (host, path, rule) in url_brute(rows).items():
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        if rule:
            assert got[i].verdict == dict(url_filter.RULES)[rule]
    assert got[300].verdict == "allow" and got[301].verdict == "block"
    twice = url_filter.url_filter(d.unionAll(d)).groupBy("page_id").count()
    assert {r["count"] for r in twice.collect()} == {2}
    assert url_filter.url_filter(d.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(d.filter("page_id >= 300 AND page_id <= 304")).collect()} == {"allow"}


def test_markov_against_plain(spark):
    """The table of differences gives what interpolation by hand gives."""
    train = [("abab", True), ("abba", True), ("bbbb", False), ("bab", False)]
    model = {r.key: r for r in url_filter.fit(spark.createDataFrame(train, "t string, good boolean"), 3).collect()}

    def p(s, c, good):
        grams = [t for t, g in train if g == good]
        count = lambda x: sum(t[i : i + len(x)] == x for t in grams for i in range(len(t) - len(x) + 1))
        follow = {a: count(s + a) for a in "abcd"}
        n, k = sum(follow.values()), sum(v > 0 for v in follow.values())
        below = p(s[1:], c, good) if s else 1 / url_filter.ALPHABET
        return below if not n else (follow.get(c, 0) + k * below) / (n + k)

    for t in ("abab", "bbac", "caab"):
        want = sum(math.log(p(t[max(0, i - 2) : i], t[i], True)) - math.log(p(t[max(0, i - 2) : i], t[i], False)) for i in range(len(t)))
        rows = spark.createDataFrame([(1, t)], "page_id long, t string")
        got = url_filter.score(rows, ["page_id"], spark.createDataFrame([(r.key, r.gram, r.back) for r in model.values()], "key string, gram double, back double"), 3).first()
        assert got.n == len(t) and abs(got.total - want) < 1e-9, t


def test_language_model(spark, docs, empty):
    texts = [(i, " ".join(rnd.choices(["a", "b", "c", f"r{i % 9}"], k=30))) for i in range(200)] + [(1000, None), (1001, "never seen words")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r.doc_id: r for r in pitman_yor.language_model(d).collect()}
    tokens = {i: (t or "").lower().split() + [None] for i, t in texts}
    counts: dict = {}
    for i, ts in tokens.items():
        if not pitman_yor.is_held(i):
            for w in ts:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (pitman_yor.is_held(i), len(ts), sum(w in counts for w in ts), n)
        assert abs(r.base_score - sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ts)) < 1e-9
        assert r.score < 0 and math.isfinite(r.score)
    again = {r.doc_id: r.score for r in pitman_yor.language_model(d.repartition(5)).collect()}
    assert all(abs(again[i] - r.score) < 1e-2 for i, r in rows.items())
    assert pitman_yor.language_model(docs).count() == len(TEXTS) + 1
    assert pitman_yor.language_model(empty).count() == 0


def test_seating():
    """Seatings against the exact posterior of the number of tables of three customers."""
    h = np.random.default_rng(4).integers(0, 2**63, 20_000).astype(np.uint64)
    grant = 0.7
    got = pitman_yor.seated(h, np.full(20_000, 3), np.full(20_000, grant), sweeps=60, burn=20).mean()
    d = pitman_yor.DISCOUNT
    # weights of seatings: a new table costs the grant, customer m of a table m - 1 - d
    one, two, three = (1 - d) * (2 - d), 3 * grant * (1 - d), grant * grant
    assert abs(got - (one + 2 * two + 3 * three) / (one + two + three)) < 0.05


def test_seating_of_many():
    """Production sweeps of dishes with many customers against the exact numbers of tables."""
    h = np.random.default_rng(5).integers(0, 2**63, 4_000).astype(np.uint64)
    log = pitman_yor.log_stirling(3_000)
    for c, grant in ((40, 5.0), (65, 0.1), (100, 50.0), (1_000, 50.0), (3_000, 5.0), (3_000, 500.0)):
        t = np.arange(1, c + 1)
        w = np.exp(log[c, 1 : c + 1] + np.log(grant) * t - (log[c, 1 : c + 1] + np.log(grant) * t).max())
        mean = (w * t).sum() / w.sum()
        var = (w * (t - mean) ** 2).sum() / w.sum()
        got = pitman_yor.drawn(h, np.full(len(h), c), np.full(len(h), grant), 1)
        assert abs(got.mean() - mean) < 0.1 * var**0.5 and abs(got.var() / var - 1) < 0.1, (c, grant)
        assert abs(pitman_yor.seated(h, np.full(len(h), c), np.full(len(h), grant)).mean() - mean) < 0.1 * var**0.5
    got = pitman_yor.drawn(h, np.full(len(h), 10**6), np.full(len(h), 5.0), 1)
    assert abs(got.mean() - (1 + 5 / pitman_yor.DISCOUNT)) < 0.2  # the limit: one and a Poisson number


def test_sweeps_feed_the_parent(spark):
    """Scores against one plain sampler over the whole corpus, whose sweeps start from the tables of the one before."""
    p = pitman_yor
    texts = [(i, " ".join(rnd.choices(["a", "b", "c", f"r{i % 9}"], k=200))) for i in range(60)]
    got = {r.doc_id: r.score for r in p.language_model(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    rows = {i: [b""] + t.encode().split() + [b""] for i, t in texts}
    pairs = sorted({x for w in rows.values() for x in zip(w, w[1:], strict=False)})
    words = sorted({w for x in pairs for w in x})
    name = np.array([int(p.END) if not w else p.xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    u, w = (np.array([words.index(x[i]) for x in pairs]) for i in (0, 1))
    h = p.mix(name[u] * np.uint64(0x9E3779B97F4A7C15) + name[w])
    c = np.array([sum(list(zip(r, r[1:], strict=False)).count(x) for i, r in rows.items() if not p.is_held(i)) for x in pairs])
    total = lambda x, by: np.bincount(by, x, len(words))
    tables, v = np.minimum(c, 1), int((total(c, w) > 0).sum())
    own, prob = np.minimum(total(tables, w), 1), 0.0
    for s in range(p.SWEEPS + 1):
        by, at = total(tables, u), total(tables, w)
        grant = (p.STRENGTH + p.DISCOUNT * by[u]) * p.parent_probability(at, own, at.sum(), own.sum(), v)[w]
        if s > p.BURN:
            prob = prob + (np.maximum(c - p.DISCOUNT * tables, 0) + grant) / (p.STRENGTH + total(c, w)[u]) / (p.SWEEPS - p.BURN)
        tables = p.drawn(h, c, grant, s)
        own = p.drawn(name, total(tables, w).astype(int), np.full(len(words), (p.STRENGTH + p.DISCOUNT * own.sum()) / (v + 1)), s)
    log = {x: math.log10(y) for x, y in zip(pairs, prob, strict=True)}
    for i, r in rows.items():
        assert abs(got[i] - sum(log[x] for x in zip(r, r[1:], strict=False))) < 0.05, i


def test_near_by_set_not_by_id(spark):
    """Several texts under a null id and under one reused id: each is searched for its own copies."""
    base = [" ".join(f"w{j}x{i}" for i in range(60)) for j in range(4)]
    near = [b + " more" for b in base]
    rows = [(None, base[0]), (None, base[1]), (7, base[2]), (7, base[3]), (8, near[2]), (9, near[3]), (10, near[0]), (11, near[1]), (None, near[1]), (None, ""), (None, None)]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by = {(r.doc_id, r.component_id) for r in got if r.doc_id is not None}
    assert by == {(7, 7), (8, 7), (9, 7), (10, None), (11, None)}
    assert sorted(r.doc_id for r in got if r.kept and r.doc_id is not None) == [7, 7]
    assert sum(r.chosen for r in got if r.doc_id is None) == 4  # one of base[1] and near[1]; the empty ones
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_kept_by_id(spark):
    """Rows that share an id and a component are kept alike; only one of their texts is chosen."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text + " more"), (2, text)]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert [r.doc_id for r in got if r.chosen] == [1]


SHARED = [" ".join(f"w{(7 * j + i) % 40}" for i in range(60)) for j in range(6)]
SHARED_ROWS = [(None, SHARED[0]), (None, SHARED[1]), (None, SHARED[2] + " end"), (2, SHARED[3]), (2, "short"), (2, SHARED[3] + " " + SHARED[4]), (3, SHARED[5]), (3, SHARED[5]), (None, SHARED[0]), (None, None), (9, SHARED[1])]


@pytest.mark.parametrize(("op", "plain"), [(suffix_dedup.suffix_dedup, brute.suffix_dedup), (substring_dedup, brute.substring_dedup)])
def test_repeats_of_texts_that_share_an_id(spark, op, plain):
    """Null ids and an id on several texts: each text is a document, in the order of id and hashes; rows that repeat both come out alike."""
    from archivolt.llm.repeats import keyed

    for rows in (SHARED_ROWS, SHARED_ROWS[::-1]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        documents = {(r.doc_id, r.t1, r.t2): r.text.encode() for r in keyed(docs).collect()}
        want = plain(documents)
        got = sorted(tuple(r)[1:4] for r in op(docs).collect() if r.doc_id is None or r.doc_id < 10)
        counts = {k: sum((-(2**63) if i is None else i) == k[0] and (t or "").encode() == documents[k] for i, t in rows) for k in documents}
        assert got == sorted(want[k][:3] for k in want for _ in range(counts[k]))


def test_equal_hashes_of_other_content(spark):
    """With one hash for all symbols every fragment meets every other; content decides."""
    from archivolt.llm import repeats

    def alike(texts):
        v, lens, same = suffix_dedup.byte_symbols(texts)
        return v & np.uint64(0), lens, same

    r = random.Random(8)
    pool = ["".join(r.choice("ab") for _ in range(r.randint(20, 90))) for _ in range(6)]
    texts = {i: "".join(r.choice(pool) for _ in range(3)) for i in range(12)}
    docs = repeats.keyed(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3))
    match = lambda pieces, raws: suffix_dedup.match(pieces, raws, 30)
    found = repeats.repeated_runs(docs, alike, suffix_dedup.byte_content, match, 30, 8, "t").collect()
    got = {i: set() for i in texts}
    for x in found:
        got[x.doc_id].update(range(x.pos, x.pos + x.cnt + 29))
    assert got == brute.repeated({i: t.encode() for i, t in texts.items()}, 30)


def test_tiles_exactly():
    r = random.Random(4)
    for _ in range(300):
        k = r.choice([1, 2, 4, 9])
        a, b = ([r.randrange(-1, k) for _ in range(r.randint(1, 40))] for _ in range(2))
        at = r.randrange(len(b))
        a = r.choice([a, a + b[at:] + [0, 1] + b[:at]])
        least = r.choice([1, 3, 5])
        assert decontaminate.tile(np.array(a), np.array(b), least) == brute_tiles(a, b, least)
    assert decontaminate.tile(np.zeros(200_000, np.int64), np.zeros(200, np.int64), 5) == [(0, 0, 200)]


def test_decontaminate_against_plain(spark):
    """Every text against every item; ids that are null or on several texts; rows judged one by one."""
    r = random.Random(6)
    items = [(i % 7 if i % 5 else None, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 30)))) for i in range(20)]
    rows = []
    for i in range(60):
        pieces = [w.split() for _, w in r.sample(items, 2)]
        words = [x for p in pieces for x in p[r.randrange(len(p)) :]] + [r.choice("xyz") for _ in range(r.randint(0, 20))]
        rows.append((r.choice([None, 1, 2, 100 + i]), " ".join(words)))
    best = {}
    for _, text in rows:
        a = text.split()
        for item, words in items:
            b = words.split()
            numbers: dict = {}
            nb = [numbers.setdefault(w, len(numbers)) for w in b]
            tiles = brute_tiles([numbers.get(w, -1) for w in a], nb, min(5, len(b)))
            n = sum(x[2] for x in tiles)
            if n:
                key = -(2**63) if item is None else item
                best[text] = max(best.get(text, (0.0, 0, 0, 0)), (n / len(b), ~key, n, len(tiles)))
    want = []
    for i, text in rows:
        c, order, n, k = best.get(text, (0.0, None, 0, 0))
        item = None if order is None or ~order == -(2**63) else ~order
        want.append((i, item, round(c, 6), n, k, round(c, 6) >= 0.5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t1", F.lit("?")).withColumn("coverage", F.lit(2)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect()), key=repr) == sorted(want, key=repr)
    left = decontaminate.decontamination_filter(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id) == sorted((i, t) for (i, t), w in zip(rows, want, strict=True) if not w[-1] and i)


def test_quality_of_rows_without_ids(spark):
    """A sample by id and text: as good where all ids are null or one."""
    prose = [" ".join(rnd.sample([f"{a}{b}" for a in ("plain", "prose", "word", "lin") for b in ("s", "es", "ing", "er", "ly", "ed")], 20)) + f" x{i}." for i in range(200)]
    junk = [" ".join(rnd.choice(["BUY!!", "NOW!!", "$$$$$$", "***###", "x%%%"]) for _ in range(40)) + f" {i}" for i in range(200)]
    for one in (None, 7):
        d = spark.createDataFrame([(one, t) for t in prose + junk], "doc_id long, text string").withColumn("keep", F.lit("?"))
        kept = {r.text for r in quality.quality_filter(d, sample=101).collect()}
        assert kept == set(prose)
        assert quality.quality(d, sample=101).filter("keep").count() == len(prose)


def test_toxicity_of_shared_ids(spark):
    """A label of a null id doesn't train; an id on several texts trains one of them; every row is judged."""
    clean = [(i, " ".join(rnd.choice(WORDS) for _ in range(30))) for i in range(100)]
    bad = [(1000 + i, " ".join([rnd.choice(WORDS) for _ in range(25)] + ["vequa", rnd.choice(["vequo", "zonk"])])) for i in range(60)]
    rows = clean + bad + [(None, clean[0][1])] * 20 + [(1000, clean[1][1]), (None, bad[0][1])]
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in bad] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit("?")), labels).collect()
    assert len(got) == len(rows)
    assert sum(r.toxic for r in got if r.doc_id is None) == 1 and sum(r.toxic for r in got if r.doc_id and r.doc_id > 1000) == 59


def test_kinds_are_learned():
    """Two groups of toxic rows with their own words are told apart without being named."""
    r = np.random.default_rng(3)
    rows, truth = [], []
    for i in range(300):
        kind = i % 3
        own = {1: [500, 501, 502], 2: [600, 601, 602]}.get(kind, [])
        rows.append(np.unique(np.concatenate([r.integers(0, 400, 20), r.choice(own, 2, replace=False) if own else []]).astype(np.int64)))
        truth.append(kind)
    got = toxicity.kinds(rows, (np.array(truth) > 0).astype(float), 1024)
    one = got[np.array(truth) == 1].mean(0), got[np.array(truth) == 2].mean(0), got[np.array(truth) == 0].sum()
    assert one[2] == 0 and abs(one[0] - one[1]).min() > 0.95


def test_long_urls_count_as_a_whole(spark):
    """What tells the kinds apart stands beyond 2,000 characters; ids may be null."""
    rows = [(None if i % 2 else i, f"http://h{i}.a.net/" + "p" * 2500 + "bad" * 20) for i in range(30)]
    rows += [(1000 + i, f"http://h{i}.org/fr/" + "p" * 2500 + "fine" * 15) for i in range(30)]
    rows += [(2000, "http://q.info/" + "p" * 2500 + "bad" * 20), (2001, "http://q.info/" + "p" * 2500 + "fine" * 15)]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string").withColumn("row", F.lit("?"))).collect()
    assert len(got) == len(rows) and {r.page_id: r.verdict for r in got if r.page_id and r.page_id >= 2000} == {2000: "block", 2001: "allow"}


def test_chunks_of_other_scripts(spark):
    """Where two texts of a script without Latin letters agree, most chunks agree too."""
    from archivolt.llm.exact_dedup import chunk_list

    r = random.Random(9)
    for of, mark in (("日本語中文字漢検索", "。"), ("абвгдежз", " "), ("กขคงจฉชซ", " ")):
        text = "".join(r.choice(of) + (mark if r.random() < 0.05 else "") for _ in range(20_000))
        rows = spark.createDataFrame([(1, text), (2, r.choice(of) * 7 + text)], "doc_id long, text string")
        a, b = (set(x.c) for x in rows.select(chunk_list(F.col("text")).alias("c")).collect())
        assert len(a & b) > 0.8 * len(a)


def test_quality_against_plain(spark):
    """Every score against a plain version that goes document by document: prose, junk, and what lies between."""
    r = random.Random(8)
    prose, noise = ["the", "river", "was", "quiet", "and", "people", "walked", "home", "early"], ["BUY!!", "$$$$", "|", "1234567", "x%%", "CLICKHERENOWFORTHEBESTOFFER"]
    texts = [" ".join(r.choice(noise if r.random() < share else prose) for _ in range(r.randint(1, 40))) for share in (0, 0, 0.1, 0.3, 0.6, 1) for _ in range(12)]
    texts += ["", "  ", texts[0], "É" * 30]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in quality.quality(d).collect()}
    for i, want in enumerate(brute.quality_scores([t.encode() for t in texts])):
        assert abs(got[i].score - want) < 1e-5 and got[i].keep == (got[i].score >= 0.5), i


def test_one_endless_url_changes_nothing_else(spark):
    """A blocked url of 500,001 characters among 120 others; and a kind that has none but long ones."""
    rows = [(i, f"https://news.good{i % 7}.org/fr/story/{i}") for i in range(60)] + [(100 + i, f"http://spam{i % 5}.a.net/win/cash{i}") for i in range(60)]
    asked = [(300, "https://news.good1.info/story/5"), (301, "http://spam3.b.info/win/cash9")]
    schema = "page_id long, url string"
    before = {x.page_id: x for x in url_filter.url_filter(spark.createDataFrame(rows + asked, schema)).collect()}
    assert (before[300].verdict, before[301].verdict) == ("allow", "block")
    endless = (400, "http://long.net/" + "z" * 500_001)
    after = {x.page_id: x for x in url_filter.url_filter(spark.createDataFrame([*rows, *asked, endless], schema)).collect()}
    assert after.pop(400).verdict == "block" and after == before
    only = [(i, u.replace("/win", "/" + "w" * 9_000)) if i >= 100 else (i, u) for i, u in rows]
    long = {x.page_id: x for x in url_filter.url_filter(spark.createDataFrame([*only, *asked, (302, "http://spam3.b.info/" + "w" * 9_000)], schema)).collect()}
    assert long[300].verdict == "allow" and long[302].verdict == "block"


def plain_urls(rows, order=4):
    """Verdict and score of each url: rules; else two interpolated models of all urls of a kind but every fifth hash, and the best threshold on the rest."""
    parts, said = url_brute(rows), dict(url_filter.RULES)
    lower = lambda u: "".join(c.lower() if c.isascii() else c for c in u.split("://", 1)[1]) if u and "://" in u else ""
    texts = {i: lower(u) for i, u in rows}
    known = {texts[i]: said[parts[i][2]] == "allow" for i in texts if parts[i][2] and texts[i]}
    fold = {t: url_hash(t) % 5 for t in known}
    count = {g: {} for g in (True, False)}
    for t, g in known.items():
        if fold[t]:
            for k in range(1, order + 1):
                for i in range(len(t) - k + 1):
                    count[g][t[i : i + k]] = count[g].get(t[i : i + k], 0) + 1
    follow = {g: {} for g in count}
    for g, c in count.items():
        for x, n in c.items():
            have = follow[g].setdefault(x[:-1], [0, 0])
            have[0] += n
            have[1] += 1

    def p(s, c, g):
        below = p(s[1:], c, g) if s else 1 / url_filter.ALPHABET
        n, kinds = follow[g].get(s, (0, 0))
        return (count[g].get(s + c, 0) + kinds * below) / (n + kinds) if n else below

    def mean(t):
        return sum(math.log(p(t[max(0, i - order + 1) : i], t[i], True)) - math.log(p(t[max(0, i - order + 1) : i], t[i], False)) for i in range(len(t))) / len(t) if t else 0.0

    held = sorted((max(-2000, min(2000, math.floor(100 * mean(t)))), g) for t, g in known.items() if not fold[t])
    bins, best = sorted({b for b, _ in held}), (0.0, 0, 0.0)
    good = max(1, sum(g for _, g in held))
    bad = max(1, len(held) - sum(g for _, g in held))
    for b, after in zip(bins, [*bins[1:], bins[-1] + 1], strict=True):
        gain = sum(not g for x, g in held if x <= b) / bad - sum(g for x, g in held if x <= b) / good
        if (gain, -abs(b)) > best[:2] and gain > 0:
            best = (gain, -abs(b), (b + after) / 200)
    return {i: (said[parts[i][2]] if parts[i][2] else "block" if round(mean(t), 12) < best[2] else "allow", mean(t)) for i, t in texts.items()}


def url_hash(t):
    import xxhash

    h = xxhash.xxh64_intdigest(t.encode(), 42)
    return h - 2**64 if h >> 63 else h


def test_urls_against_plain(spark):
    """Sample, threshold, scores and verdicts of undecided urls against a plain version."""
    g = random.Random(12)
    word = lambda of: "".join(g.choice(of) for _ in range(g.randint(3, 9)))
    rows = [(i, f"https://{word('aeinrst')}.org/fr/{word('aeinrst')}") for i in range(150)] + [(200 + i, f"http://{word('xzqkwe')}.net/{word('xzq018')}") for i in range(120)]
    rows += [(500 + i, f"http://{word(g.choice(['aeinrst', 'xzqkwe', 'aexz1']))}.info/{word('aexz')}") for i in range(80)] + [(900, None), (901, "plain"), (902, "://")]
    want = plain_urls(rows)
    got = {x.page_id: x for x in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string").repartition(3)).collect()}
    assert {i: x.verdict for i, x in got.items()} == {i: v for i, (v, _) in want.items()}
    assert max(abs(got[i].score - s) for i, (_, s) in want.items()) < 1e-8
    assert {want[i][0] for i in range(500, 580)} == {"allow", "block"}


@pytest.mark.parametrize("limit", [url_filter.BROADCAST, 0])
def test_urls_learn_from_all_that_rules_decide(spark, monkeypatch, limit):
    """More than 20,000 urls of a kind, and several of more than 8,000 characters: scores, threshold and verdicts are those of all of them, by either join."""
    monkeypatch.setattr(url_filter, "BROADCAST", limit)
    g = random.Random(5)
    word = lambda of, n=5: "".join(g.choice(of) for _ in range(n))
    rows = [(i, f"http://{word('aeinrst')}.org/fr/{i}") for i in range(26_000)] + [(30_000 + i, f"http://{word('xzqkwe')}.net/{word('xzqk018')}") for i in range(300)]
    rows += [(40_000 + i, f"http://{word('aexz')}.net/{word('qzé日', 9_000)}") for i in range(6)]
    rows += [(50_000 + i, f"http://{word(g.choice(['aeinrst', 'xzqkwe', 'aexz1']))}.info/{word('aexz日')}") for i in range(80)]
    want = plain_urls(rows)
    got = {x.page_id: x for x in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string").repartition(3)).collect()}
    assert {i: x.verdict for i, x in got.items()} == {i: v for i, (v, _) in want.items()}
    assert max(abs(got[i].score - s) for i, (_, s) in want.items()) < 1e-8
    assert {want[i][0] for i in range(50_000, 50_080)} == {"allow", "block"}


def plain_toxicity(texts, labels, bits, folds=5, rounds=80):
    """The probabilities of the chain, document by document with dictionaries: two kinds by a mixture, then the label; earlier probabilities out of fold."""
    import zlib

    sigmoid = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def slots(t):
        words = {w.strip(toxicity.EDGES) for w in t.lower().split()} - {b""}
        return sorted({zlib.crc32(x) % 2**bits for w in words for x in (w, b"4" + w[:4], b"6" + w[:6])})

    own = {d: slots(t) for d, t in texts.items()}
    ids = sorted(labels)
    fold = {d: zlib.crc32(str(d).encode()) % folds for d in ids}

    def fitted(y, extra, use):
        pos, neg = [d for d in use if y[d]], [d for d in use if not y[d]]
        k = len(next(iter(extra.values())))
        if not pos or not neg:
            return {}, [0.0] * k, 30.0 if pos else -30.0
        n = {}
        for d in use:
            for s in own[d]:
                n.setdefault(s, [0.5, 0.5])[0 if y[d] else 1] += 1
        ratio = {s: math.log(a / (len(pos) + 1)) - math.log(b / (len(neg) + 1)) for s, (a, b) in n.items() if a + b >= 4}
        ratio = {s: v for s, v in ratio.items() if abs(v) > 0.7}
        keys = [*ratio, *range(-k, 0), "bias"]
        w, past = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 1e-8)
        for _ in range(rounds):
            slope = {key: 1e-5 * v if key != "bias" else 0.0 for key, v in w.items()}
            for d in use:
                x = {**{s: ratio[s] for s in own[d] if s in ratio}, **dict(zip(range(-k, 0), extra[d], strict=True)), "bias": 1.0}
                miss = (sigmoid(sum(w[key] * v for key, v in x.items())) - y[d]) / len(use)
                for key, v in x.items():
                    slope[key] += miss * v
            for key, v in slope.items():
                past[key] += v * v
                w[key] -= 0.3 * v / math.sqrt(past[key])
        return {s: w[s] * v for s, v in ratio.items()}, [w[j] for j in range(-k, 0)], w["bias"]

    def says(model, d, extra):
        return sigmoid(sum(model[0].get(s, 0.0) for s in own[d]) + sum(a * b for a, b in zip(model[1], extra, strict=True)) + model[2])

    bad = [d for d in ids if labels[d]]
    freq = {}
    for d in ids:
        for s in own[d]:
            freq.setdefault(s, [0, 0])[0 if labels[d] else 1] += 1
    marks = sorted(s for s, (a, b) in freq.items() if a >= 3 and math.log((a + 0.5) / (len(bad) + 1)) - math.log((b + 0.5) / (len(ids) - len(bad) + 1)) > 1.5)
    kind = {d: (0, 0) for d in ids}
    if len(marks) >= 2:
        have = {d: [s for s in own[d] if s in set(marks)] for d in bad}
        first = max(marks, key=lambda s: (freq[s][0], -s))
        apart = {s: sum((1 if first not in have[d] else -1) for d in bad if s in have[d]) for s in marks}
        second = max(marks, key=lambda s: (apart[s], -s))
        share = {d: (0.9, 0.1) if first in have[d] and second not in have[d] else (0.1, 0.9) if second in have[d] and first not in have[d] else (0.5, 0.5) for d in bad}
        some = [d for d in bad if have[d]]
        for _ in range(40):
            count = [dict.fromkeys(marks, 0.5) for _ in range(2)]
            for d in bad:
                for s in have[d]:
                    for j in range(2):
                        count[j][s] += share[d][j]
            total = [sum(c.values()) for c in count]
            prior = [math.log(sum(share[d][j] for d in some) + 1) for j in range(2)]
            for d in some:
                z = [prior[j] + sum(math.log(count[j][s] / total[j]) for s in have[d]) for j in range(2)]
                e = [math.exp(v - max(z)) for v in z]
                share[d] = (e[0] / sum(e), e[1] / sum(e))
        for d in some:
            kind[d] = (1, 0) if share[d][0] >= share[d][1] else (0, 1)
    extra, out = {d: [] for d in ids}, {d: [] for d in texts}
    for y in ({d: kind[d][0] for d in ids}, {d: kind[d][1] for d in ids}, labels):
        parts = [fitted(y, extra, [d for d in ids if fold[d] != f]) for f in range(folds)]
        model = fitted(y, extra, ids)
        held = {d: says(parts[fold[d]], d, extra[d]) for d in ids}
        for d in texts:
            out[d].append(says(model, d, out[d]))
        extra = {d: [*extra[d], held[d]] for d in ids}
    return {d: [0.0] * 3 if not texts[d].split() else p for d, p in out.items()}


def test_toxicity_against_plain(spark):
    """All probabilities of all documents."""
    g = random.Random(14)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, labels = [], {}
    for i in range(140):
        kind = i % 3
        extra = g.sample(["vequa!", "Vequo", "vexed"], 2) if kind == 1 else g.sample(["zonk", "zinker", "ZONK,"], 2) if kind == 2 and i % 2 else []
        rows.append((i, " ".join(g.sample(vocabulary, 15) + extra)))
        if i < 110:
            labels[i] = int(bool(extra))
    rows += [(500, None), (501, "  "), (502, "zonk")]
    want = plain_toxicity({i: (t or "").encode() for i, t in rows}, labels, toxicity.BITS)
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    for i, p in want.items():
        assert [abs(got[i][f"p_{c}"] - v) < 1e-5 for c, v in zip(toxicity.CHAIN, p, strict=True)] == [True] * 3, (i, p, got[i])
        assert got[i].toxic == (got[i].p_toxic >= 0.5)
    assert any(p[0] > 0.5 for p in want.values()) and any(p[1] > 0.5 for p in want.values())
