"""Shared plumbing: tables, lineage cuts in the shared folder, 64-bit hashing with numpy."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What a null id counts as while it is worked on; it comes out as null again.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns are called; a null text is empty."""
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )


def id_out(name: str = "doc_id"):
    return F.nullif(F.col(name), F.lit(NULL_ID)).alias(name)


_LOCK, _WRITING = threading.Lock(), {}


def _cleaning(spark: SparkSession, step: int) -> None:
    """The setting holds while any table of the session is written by cut(), and is what it was after the last."""
    with _LOCK:
        key = id(spark)
        count, before = _WRITING.get(key, (0, None))
        if step > 0 and not count:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        count += step
        if count:
            _WRITING[key] = (count, before)
            return
        _WRITING.pop(key, None)
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, label: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and an executor's
    loss costs no more than the stage that was running.  The shuffle files that led to it go, and so do
    the tables in done: results of cut() that nothing reads any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _cleaning(spark, 1)
    try:
        df.write.parquet(path)
    finally:
        _cleaning(spark, -1)
    for x in done:
        forget(x)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(table: DataFrame) -> None:
    """Remove what cut() wrote, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that hold this share of all rows are hot: fewer than 1 / HOT_SHARE of them can be.
HOT_SHARE = 0.001


def joined_back(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows with their group's columns. groups: key, size (its rows) and others, one row a key, for all of rows. Hot keys, which are
    few by their share of all rows, meet their rows by broadcast; so no key's rows are gathered in one task."""
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()[0]
    least = max(2, int(total * HOT_SHARE))
    hot = groups.filter(F.col("size") >= least)
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return rows.join(groups, key)
    is_hot = F.col(key).isin(keys)
    return rows.filter(is_hot).join(F.broadcast(hot), key).unionByName(rows.filter(~is_hot).join(groups.filter(F.col("size") < least), key))


def parts(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int, key: list | None = None) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Arrow batches of (doc_id, text) as (ids, texts in UTF-8), at most max_bytes of text at a time (a longer
    text comes alone).  With key, a NumPy record's fields, the columns before the text are those fields."""
    kind = np.dtype(key or np.int64)
    ids: list[np.ndarray] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        if not pa.types.is_large_binary(column.type):
            column = column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
        own = np.empty(batch.num_rows, kind)
        for c in range(batch.num_columns - 1):
            (own[kind.names[c]] if key else own)[:] = batch.column(c).to_numpy(zero_copy_only=False)
        lo = 0
        for i, t in enumerate(column):
            t = t.as_py()
            if size + len(t) > max_bytes and texts:
                yield np.concatenate([*ids, own[lo:i]]), texts
                ids, texts, size, lo = [], [], 0, i
            texts.append(t)
            size += len(t)
        ids.append(own[lo:])
    if texts:
        yield np.concatenate(ids), texts


def smallest_hashes(rows: DataFrame, sample: int, *ties) -> DataFrame:
    """The sample rows of smallest h (a 64-bit hash), exactly.  Counts of h's 4,096 ranges tell how far to look, so only the rows of those
    ranges are sorted, whatever the table's size or the hashes' distribution."""
    of = F.shiftright("h", 52) + F.lit(2048)
    counts = sorted((int(r[0]), r[1]) for r in rows.groupBy(of.alias("range")).count().collect())
    have, last = 0, -1
    for last, n in counts:  # noqa: B007
        have += n
        if have >= sample:
            break
    return rows.filter(of <= last).orderBy("h", *ties).limit(sample)


def filtered(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], np.ndarray]], max_bytes: int) -> DataFrame:
    """The rows of docs whose texts pass, all columns, without a shuffle. make: called once a task, for what says of texts which pass."""
    at = docs.columns.index("text")

    def run(batches):
        keep = make()
        for batch in batches:
            texts, lo, size = [], 0, 0
            for i, t in enumerate(batch.column(at)):
                t = t.as_py() or ""
                texts.append(t if isinstance(t, bytes) else t.encode())
                size += len(texts[-1])
                if size >= max_bytes or i + 1 == batch.num_rows:
                    yield batch.slice(lo, len(texts)).filter(pa.array(np.asarray(keep(texts), bool)))
                    texts, lo, size = [], i + 1, 0

    return docs.mapInArrow(run, docs.schema)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; x is overwritten."""
    x ^= x >> _S
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def doubled(v: np.ndarray, span: int) -> np.ndarray:
    """From hashes of spans at each place (v: one value a place) those of twice as long spans:
    call it with span 1, 2, 4, ...  Places near the end, where no whole span fits, hold junk."""
    out = v * np.uint64(0x9E3779B97F4A7C15 + 2 * span)
    out[: len(v) - span] += v[span:]
    out ^= out >> np.uint64(29)
    out *= _M1
    return out


def spread(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ..., n-1 for each n of lengths, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(starts, lengths)
