"""Exact dedup by content-defined chunk recipes.  DataFrame functions only.

A text is cut where its own characters say so (after a space that follows one of a few letters or a character beyond
ASCII, after punctuation beyond ASCII, or after an empty line; 512 characters on at the earliest and 4,096 at the latest), so texts cut alike wherever they agree.
A chunk's identifier is its 64-bit hash, verified: distinct chunks are gathered once, and a
hash that two different chunks share is extended by the chunks' SHA-256.  Documents are then equal
when their ordered identifier lists are; only these lists move, however long the texts.

Copies are counted per list before any join, and the join back from lists to documents is an
ordinary equi-join, whose hot keys adaptive execution splits.

Defined cases: a null text is empty; all empty texts are equal; a null doc_id counts as the smallest
and comes out as null; rows that repeat an id are copies like any others, and each row that has
keep_id as its id is kept; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, id_out, plain

#: Fixed value: where a chunk ends.
CHUNK = r"(?s).{512,4096}?(?:(?<=[aeinorst\x{80}-\x{10FFFF}] )|(?<=[\p{IsPunctuation}&&[^\x00-\x7F]])|(?<=\n\n))|.{1,4096}"


def chunk_list(text: Column, pattern: str = CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ambiguous_hashes(docs: DataFrame, digest: Callable[[Column], Column], pattern: str) -> DataFrame:
    """Hashes that stand for more than one chunk: each distinct chunk is compared as a whole."""
    pieces = docs.select(F.explode(chunk_list(F.col("text"), pattern)).alias("c"))
    distinct = pieces.select(digest(F.col("c")).alias("h"), "c").distinct()
    return distinct.groupBy("h").count().filter("count > 1").select("h")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64, pattern: str = CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: a row for each row of docs."""
    docs = plain(docs)
    shared = cut(ambiguous_hashes(docs, digest, pattern), "op4-shared")
    text = F.col("text")
    if shared.isEmpty():
        lists = docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.transform(chunk_list(text, pattern), lambda c: digest(c)).alias("recipe"))
    else:
        each = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.sha2(text, 256).alias("text_sha256"), F.posexplode_outer(chunk_list(text, pattern)).alias("at", "c"))
        told = each.withColumn("h", digest(F.col("c"))).join(shared.withColumn("twice", F.lit(True)), "h", "left")
        name = F.concat_ws(":", F.col("h").cast("string"), F.when(F.col("twice"), F.sha2("c", 256)))
        lists = told.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", name.alias("id"))))).alias("ids")).select("doc_id", "text_sha256", F.col("ids.id").alias("recipe"))
    lists = cut(lists, "op4-lists")
    groups = lists.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return lists.join(groups, "recipe").select(
        id_out(), F.nullif("keep_id", F.lit(NULL_ID)).alias("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks")
    )
