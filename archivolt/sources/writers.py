"""Sinks: history, batches that appear as a whole, and published versions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Folders of our own, by application; they go with the process.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is named and everything runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith(("local[", "local,")):
            raise RuntimeError("spark.checkpoint.dir names no folder that executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="archivolt-")
            atexit.register(shutil.rmtree, _OWN[context.applicationId], ignore_errors=True)
        base = "file://" + _OWN[context.applicationId]
    return f"{base.rstrip('/')}/archivolt"


def settled(df: DataFrame) -> DataFrame:
    """df as files in the shared folder: what depends on how rows fell into
    partitions is decided once, and stays decided when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """rows with their number from 0 in the total order of keys. No task sorts everything: ranges are sorted apart and written, and their
    counts (one a range) give each range its first number."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_i", F.monotonically_increasing_id())
    r = settled(r.withColumn("_p", F.shiftright("_i", 33)).withColumn("_i", F.col("_i").bitwiseAND((1 << 33) - 1)))
    before = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return r.join(before, "_p").withColumn(out, F.col("_i") + F.col("_b")).drop("_i", "_p", "_b")


def history(session: DataFrame, items: DataFrame, path: str) -> None:
    """SNK1: the session's header and its items as two sets of CSV files, quoted, with a byte-order mark on the header line's first name."""
    mark = "\ufeff"
    for df, name in ((session, "session"), (items, "items")):
        first = df.columns[0]
        df.withColumnRenamed(first, mark + first).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{path}/{name}")


def session_block(session: DataFrame, items: DataFrame, order: list[str]) -> DataFrame:
    """SNK1 as one block of lines: at, line: the session's names and values, an empty line, then the items' names and values in order, all
    quoted; the first line has the byte-order mark. Write it ordered by at."""
    quoted = lambda df: F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns])
    names = lambda df: ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    spark = session.sparkSession
    lines = numbered(items.withColumn("_line", quoted(items)), order, "_n").select((F.col("_n") + 4).alias("at"), F.col("_line").alias("line"))
    head = spark.createDataFrame([(0, "\ufeff" + names(session)), (2, ""), (3, names(items))], "at long, line string")
    return head.unionByName(session.select(F.lit(1).cast("long").alias("at"), quoted(session).alias("line"))).unionByName(lines)


def history_file(session: DataFrame, items: DataFrame, order: list[str], path: str) -> None:
    """SNK1: session_block() as text. Its parts, in the order of their names, make up the file; lines are sorted in ranges, not in one task."""
    session_block(session, items, order).orderBy("at").select("line").write.mode("overwrite").text(path)


def replace_whole(df: DataFrame, path: str) -> None:
    """SNK2, SRC9: rows are staged in full before the old ones go, and what fails half way leaves the old. Between the two renames there is no table at
    the path: readers that can't wait read a version that stage() and activate() publish."""
    spark = df.sparkSession
    staged, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    fs, target = _fs(spark, path)
    p = lambda s: spark._jvm.org.apache.hadoop.fs.Path(s)
    try:
        df.write.parquet(staged)
    except Exception:
        fs.delete(p(staged), True)
        raise
    if fs.exists(target):
        fs.rename(target, p(old))
    if not fs.rename(p(staged), target):
        fs.rename(p(old), target)
        raise OSError(f"{path} could not be replaced")
    fs.delete(p(old), True)


def upsert(target: DataFrame | None, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace the target's of the same keys."""
    return rows if target is None else target.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def signature(df: DataFrame) -> str:
    """A content hash that doesn't depend on the order of rows."""
    r = df.select(F.xxhash64(*[F.col(c).cast("string") for c in df.columns]).alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return ":".join(str(x) for x in r)


def stage(df: DataFrame, base: str, current: str | None) -> str:
    """SNK3: writes a pending version beside the current one, with a manifest of what it is and what it was built from; its name."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{name}")
    sums = signature(spark.read.parquet(f"{base}/{name}"))
    was = signature(spark.read.parquet(f"{base}/{current}")) if current else ""
    spark.createDataFrame([(name, sums, current or "", was)], "name string, signature string, base string, base_signature string").coalesce(1).write.mode("overwrite").json(f"{base}/pending")
    return name


def activate(spark: SparkSession, base: str, current: str | None) -> str | None:
    """SNK3: the pending version's name if it still is what was staged, on top of what it was built from; else the current one's."""
    fs, p = _fs(spark, f"{base}/pending")
    if not fs.exists(p):
        return current
    m = spark.read.schema("name string, signature string, base string, base_signature string").json(f"{base}/pending").first()
    ok = m["base"] == (current or "") and signature(spark.read.parquet(f"{base}/{m['name']}")) == m["signature"] and (not current or signature(spark.read.parquet(f"{base}/{current}")) == m["base_signature"])
    fs.delete(p, True)
    return m["name"] if ok else current
