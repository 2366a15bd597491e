"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
Rows that a stage keeps are whole rows of documents.

Defined cases: a null text counts as empty, and empty texts are rejected by the first stage; rows whose id is null or stands on several texts are told apart by their
texts; rows that repeat id and text are one, the smallest by their other columns; columns besides doc_id and text, whatever they are called, go along
unchanged and unread; an empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.bpe import bpe_encode
from archivolt.llm.common import NULL_ID, cut, read
from archivolt.llm.decontaminate import decontamination_filter
from archivolt.llm.exact_dedup import exact_dedup
from archivolt.llm.near_dedup import near_judged
from archivolt.llm.quality import quality_filter
from archivolt.llm.queries import tokenizer_path

WORDS, SIMILARITY = 5, 80


def _kept(docs: DataFrame, judged: DataFrame, flag: str, digest: str, of_text: Column) -> DataFrame:
    """Whole rows of docs that judged keeps, by doc_id and the digest of the text (of_text in docs). Of rows that repeat both one remains: the
    smallest by their other columns, so that a stage that runs again keeps the same."""
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    kept = judged.filter(flag).select(key.alias("key"), F.col(digest).alias("digest")).distinct()
    rows = docs.select(key.alias("key"), of_text.alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = rows.join(kept, ["key", "digest"], "left_semi")
    # only rows that repeat are gathered; a text moves once
    rest = F.struct(*[F.col(f"row.`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")], F.lit(0).alias("last"))
    return own.groupBy("key", "digest").agg(F.min_by("row", rest).alias("row")).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_filter(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of largest doc_id."""
    return _kept(docs, exact_dedup(docs), "kept", "text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity of 0.8 or more) the one of smallest doc_id."""
    return _kept(docs, near_judged(docs, WORDS, SIMILARITY, "pipeline-near"), "chosen", "text_md5", F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of every benchmark item."""
    return decontamination_filter(docs, read(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, offsets."""
    return bpe_encode(docs, tokenizer_path()).select("doc_id", F.size("ids").alias("n_tokens"), "ids", "offsets")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{k}")
    return docs
