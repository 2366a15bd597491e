"""The named queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_round_trip
from .common import read
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .importance import importance_resample
from .near_dedup import near_dedup
from .pitman_yor import language_model
from .quality import quality
from .simhash import simhash_dedup
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity
from .url_filter import url_filter
from .whitening import whiten

TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("n_chunks")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).drop("n_spans")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), k=2).drop("chosen")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_quality, op3_bpe, op4_exact_dedup, op5_url_filter, op6_language_model, op7_substring_dedup, op8_near_dedup, op9_toxicity, op10_decontaminate, op11_importance, op12_whitening, op13_simhash)}

#: XXH64's primes.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def simhash_sql(seed: int = 42) -> str:
    """op13 in SQL: XXH64 of each distinct shingle by whole-number arithmetic of 128 bits, bits counted by document, links between all pairs of fingerprints."""
    m = "18446744073709551616::UHUGEINT"
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in PRIMES)
    number = lambda x: f"{x % 2**64}::UHUGEINT"
    times = lambda a, b: f"(({a}) * ({b}) % {m})"
    plus = lambda a, b: f"((({a}) + ({b})) % {m})"
    turned = lambda a, r: f"(({a}) * {2**r}::UHUGEINT % {m} + ({a}) // {2 ** (64 - r)}::UHUGEINT)"
    turn = lambda a, r: f"list_transform([{a}], lambda q: {turned('q', r)})[1]"  # noqa: E731  a is computed once
    mixed = lambda a, w: times(turn(plus(a, times(w, p2)), 31), p1)
    little = lambda at, n: "CAST('0x' || " + " || ".join(f"substr(h, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + " AS UBIGINT)::UHUGEINT"
    lane = lambda j, start: f"list_reduce(list_transform(range(0, n // 32), lambda i: words[4 * i + {j + 1}]), lambda a, w: {mixed('a', 'w')}, {number(start)})"
    merged = lambda v: f"CASE WHEN n >= 32 THEN {plus(times(f'xor(b, {mixed(number(0), v)})', p1), p4)} ELSE b END"
    return rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                              WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM d),
             c AS (SELECT doc_id, g, count(*) AS c FROM s GROUP BY ALL),
             x0 AS (SELECT g, hex(encode(g)) AS h, length(hex(encode(g))) // 2 AS n FROM (SELECT DISTINCT g FROM c)),
             x1 AS (SELECT *, list_transform(range(0, n // 8), lambda i: {little("8 * i", 8)}) AS words FROM x0),
             x2 AS (SELECT *, {lane(0, seed + PRIMES[0] + PRIMES[1])} AS v1, {lane(1, seed + PRIMES[1])} AS v2, {lane(2, seed)} AS v3, {lane(3, seed - PRIMES[0])} AS v4 FROM x1),
             x3 AS (SELECT *, CASE WHEN n >= 32 THEN ({turned("v1", 1)} + {turned("v2", 7)} + {turned("v3", 12)} + {turned("v4", 18)}) % {m} ELSE {number(seed + PRIMES[4])} END AS b FROM x2),
             x4 AS (SELECT * REPLACE ({merged("v1")} AS b) FROM x3), x5 AS (SELECT * REPLACE ({merged("v2")} AS b) FROM x4),
             x6 AS (SELECT * REPLACE ({merged("v3")} AS b) FROM x5), x7 AS (SELECT * REPLACE ({merged("v4")} AS b) FROM x6),
             x8 AS (SELECT g, h, n, list_reduce(words[n // 32 * 4 + 1:], lambda a, w: {plus(times(turn(f"xor(a, {mixed(number(0), 'w')})", 27), p1), p4)}, (b + n::UHUGEINT) % {m}) AS b FROM x7),
             x9 AS (SELECT g, h, n, CASE WHEN n % 8 >= 4 THEN {plus(times(turn(f"xor(b, {times(little('n // 8 * 8', 4), p1)})", 23), p2), p3)} ELSE b END AS b FROM x8),
             xa AS (SELECT g, list_reduce(list_transform(range(n // 4 * 4, n), lambda i: {little("i", 1)}), lambda a, w: {times(turn(f"xor(a, {times('w', p5)})", 11), p1)}, b) AS b FROM x9),
             xb AS (SELECT g, {times(f"xor(b, b // {2**33}::UHUGEINT)", p2)} AS b FROM xa), xc AS (SELECT g, {times(f"xor(b, b // {2**29}::UHUGEINT)", p3)} AS b FROM xb),
             hash AS (SELECT g, CAST(xor(b, b // {2**32}::UHUGEINT) AS UBIGINT) AS b FROM xc),
             bits AS (SELECT doc_id, i, sum(c * ((b >> i) & 1)) * 2 > sum(c) AS one FROM c JOIN hash ON hash.g = c.g, (SELECT unnest(range(0, 64))::UBIGINT AS i) GROUP BY 1, 2),
             p AS (SELECT d.doc_id, coalesce(v, 0::UBIGINT) AS print FROM d LEFT JOIN (SELECT doc_id, bit_or(CASE WHEN one THEN CAST(pow(2, i) AS UBIGINT) ELSE 0::UBIGINT END) AS v FROM bits GROUP BY 1) f ON f.doc_id = d.doc_id),
             f AS (SELECT print, min(doc_id) AS least FROM p GROUP BY 1),
             e AS (SELECT a.print AS x, b.print AS y FROM f a JOIN f b ON a.print <> b.print AND bit_count(CAST(xor(a.print, b.print) AS HUGEINT)) <= 3),
             r AS (SELECT print AS x, print AS y FROM f UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
             k AS (SELECT r.x, min(f.least) AS component_id FROM r JOIN f ON f.print = r.y GROUP BY 1)
        SELECT doc_id, lower(lpad(hex(print), 16, '0')) AS fingerprint, component_id FROM p JOIN k ON k.x = p.print"""


ORACLE: dict[str, str] = {
    "op11_importance": r"""
        WITH t AS (SELECT list_transform(range(0, 256), lambda k: list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k)) AS crc),
             w AS (SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
                   FROM (SELECT 's' AS kind, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
             f AS (SELECT kind, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM w),
             n AS (SELECT kind, doc_id, g, count(*) AS n FROM f GROUP BY ALL),
             u AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM n)),
             c AS (SELECT g, CAST(xor(4294967295, list_reduce(list_transform(range(0, length(h) // 2), lambda i: (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1),
                           lambda s, b: xor(s >> 8, t.crc[xor(s & 255, b) + 1]), 4294967295)) % 10000 AS BIGINT) AS bucket FROM u, t),
             b AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 's'), 0) AS s, coalesce(sum(n) FILTER (kind = 't'), 0) AS t FROM n JOIN c ON c.g = n.g GROUP BY bucket),
             z AS (SELECT sum(s) AS s, sum(t) AS t FROM b),
             k AS (SELECT bucket, CAST(floor(1000 * ln((CAST(b.t AS DOUBLE) + 1) * (CAST(z.s AS DOUBLE) + 10000) / ((CAST(b.s AS DOUBLE) + 1) * (CAST(z.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM b, z),
             m AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM n JOIN c ON c.g = n.g JOIN k ON k.bucket = c.bucket WHERE kind = 's' GROUP BY doc_id),
             r AS (SELECT w.doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
                          CAST('0x' || substr(sha256('7:' || CAST(w.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m ON m.doc_id = w.doc_id WHERE kind = 's'),
             x AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM r),
             o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM x WHERE words >= 20), q AS (SELECT 25 * count(*) // 100 AS quota FROM o)
        SELECT x.doc_id, n_features, weight, score, CASE WHEN place <= quota THEN place END AS rank FROM x LEFT JOIN o ON o.doc_id = x.doc_id, q""",
    "op13_simhash": simhash_sql(),
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s
                   FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
             r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
             g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100
                                            OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM r),
             k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
             p AS (SELECT doc_id, span, min(i) AS lo, max(i) + 100 AS hi FROM k GROUP BY doc_id, span),
             q AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM p),
             e AS (SELECT q.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
                          string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN e.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN e ON d.doc_id = e.doc_id""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s
                   FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
             r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
             c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
             a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
             k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.i) AS kept, count(*) AS n
                   FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.i = c.i WHERE c.i IS NULL GROUP BY a.doc_id)
        SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op8_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
                                                       WHEN len(ws) = 1 THEN [ws[1]] ELSE CAST([] AS VARCHAR[]) END) AS g FROM d),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
                   JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
                   GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
             r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
             c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
}
