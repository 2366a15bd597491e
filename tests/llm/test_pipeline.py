"""The pipeline against plain versions of its stages, and the operators against SQL."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from archivolt.llm import queries
from archivolt.llm.bpe import load_ranks
from archivolt.llm.decontaminate import tile
from archivolt.llm.quality import quality

from . import brute

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@needs_data
def test_pipeline_against_plain_stages(spark):
    import numpy as np
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = {r.doc_id for r in quality(docs).filter("keep").collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect() if r.doc_id in good}
    last = {t: d for d, t in sorted(texts.items())}
    texts = {d: t for d, t in texts.items() if last[t] == d}
    near = brute.near_components(texts, corpus_pipeline.WORDS, corpus_pipeline.SIMILARITY)
    texts = {d: t for d, t in texts.items() if near[d][1] == d}
    items = [r.text.encode().lower().split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    numbers: dict = {}
    number = lambda words: np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)

    def leaked(text):
        own = number(text.lower().split())
        return any(sum(n for _, _, n in tile(own, number(i), min(5, len(i)))) / len(i) >= 0.5 for i in items)

    texts = {d: t for d, t in texts.items() if not leaked(t)}
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(queries.tokenizer_path()), special_tokens={})
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {d: real.encode_ordinary(t.decode()) for d, t in texts.items()}


@needs_data
def test_stages_keep_whole_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    twice = docs.unionAll(docs.filter("doc_id < 20"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, twice, DATA)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and all(rows[r.doc_id] == tuple(r) for r in kept)
        assert stage(spark, docs.limit(0), DATA).count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cur = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r[columns.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


@needs_data
def test_planted_cases(spark):
    """Labels of the given tables: learned operators find them and leave the rest alone."""
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    tox = {r.doc_id: r.toxic for r in queries.op9_toxicity(spark, DATA).collect()}
    assert not any(tox[d] for d, r in labels.items() if r.toxic == 0)
    judged = {r.doc_id: r.keep for r in queries.op2_quality(spark, DATA).collect()}
    assert all(judged[d] for d, r in labels.items() if r.quality == 1)
    assert sum(not judged[d] for d, r in labels.items() if r.quality == 0) >= 0.8 * sum(r.quality == 0 for r in labels.values())


def test_stages_keep_texts_that_share_an_id(spark):
    """Null and reused ids with different texts: only rows equal in both, and those judged copies, go."""
    text = [" ".join(f"w{j}x{i}" for i in range(60)) for j in range(5)]
    rows = [(None, text[0], "a"), (None, text[1], "b"), (None, text[1], "b"), (3, text[2], "c"), (3, text[3], "d"), (3, text[0], "e"), (2, text[3], "f"), (4, None, "g"), (None, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    exact = sorted(corpus_pipeline.exact_stage(spark, docs, "").collect(), key=str)
    assert {r.source for r in exact} == {"b", "c", "d", "e", "g"} and len(exact) == 5
    near = sorted(corpus_pipeline.near_stage(spark, docs, "").collect(), key=str)
    assert {r.source for r in near} == {"a", "b", "c", "f", "g", "h"} and len(near) == 6


def test_columns_of_any_name_and_no_rows(spark, tmp_path):
    """Columns called like those that stages use come out as they went in; of rows that repeat id and text the smallest stays; an empty table goes through."""
    text = [" ".join(f"w{j}x{i}" for i in range(60)) for j in range(3)]
    names = ["key", "digest", "row", "_key", "_digest", "c0", "last", "rep", "least", "size", "kept", "chosen"]
    rows = [(i % 5, text[i % 3], *[f"{n}{i}" for n in names]) for i in range(30)] + [(None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(5)
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = {tuple(r) for r in out.collect()}
        assert got <= set(rows) and got == {tuple(r) for r in stage(spark, docs.repartition(3), "").collect()}
        assert len(got) == 4
        for r in got:  # the first of its copies by the other columns
            assert r == min((x for x in rows if x[:2] == r[:2]), key=str)
    for n in ("documents", "benchmark"):
        key = "doc_id" if n == "documents" else "item_id"
        spark.createDataFrame([], f"{key} long, text string").write.parquet(f"{tmp_path}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoding_fails_where_ids_decode_to_another_text(spark, tmp_path, monkeypatch):
    import base64

    ranks = tmp_path / "ranks"
    ranks.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {97 if i == 98 else i}\n" for i in range(256)))
    monkeypatch.setattr(corpus_pipeline, "tokenizer_path", lambda: str(ranks))
    docs = spark.createDataFrame([(1, "xaax")], "doc_id long, text string")
    other = spark.createDataFrame([(1, "xacx"), (2, "xabx")], "doc_id long, text string")
    with pytest.raises(Exception, match="don't decode"):
        corpus_pipeline.encoding_stage(spark, docs.unionAll(other), "").collect()
