"""Streams of changes, reconciled batch by batch; and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.cdc import delta


def snapshots(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1) -> DataFrame:
    """Snapshots written into a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def reconcile_stream(stream: DataFrame, state: Callable[[], DataFrame | None], save: Callable[[DataFrame, DataFrame, int], None], key: str, signature: str, name: str, order: str, checkpoint: str) -> StreamingQuery:
    """Each batch is a whole snapshot. state: what is known; save(changes, snapshot, batch_id): keeps both, the same for a batch that is repeated."""

    def batch(new: DataFrame, batch_id: int) -> None:
        if new.isEmpty():
            return
        known = state()
        old = known if known is not None else new.limit(0)
        save(delta(old, new, key, signature, name, order), new, batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_own(events: DataFrame, expected: DataFrame, seconds: int = 10) -> DataFrame:
    """T2 on streams (path, at): left out is what the program announced (path, at) up to so many seconds before; both sides are bounded by watermarks."""
    e = events.withWatermark("at", f"{seconds} seconds").alias("e")
    x = expected.withWatermark("at", f"{seconds} seconds").alias("x")
    near = F.expr(f"e.path = x.path AND e.at >= x.at AND e.at <= x.at + interval {seconds} seconds")
    return e.join(x, near, "leftOuter").filter("x.path IS NULL").select("e.*")


def tumbling(events: DataFrame, at: str, width: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("events"))


def sliding(events: DataFrame, at: str, width: str, step: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width, step), *keys).agg(F.count(F.lit(1)).alias("events"))


def sessions(events: DataFrame, at: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("events"))
