"""Streams whose operators remember: what is known of paths, and what the program announced.  State lies in the state store, so a query
that starts again from its checkpoint goes on where it was; it needs the RocksDB provider (stateful_session)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import path_key
from ..operators.cdc import ADDED, HIT, MODIFIED, REMOVED

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L = T.StringType(), T.LongType()
CHANGE = _struct(kind=_S, key=_S, signature=_S, name=_S, pos=_L, ms=_L)
#: Of the paths of a share: column by column, so that a share is read and written at once.
_KNOWN = _struct(key=T.ArrayType(_S), signature=T.ArrayType(_S), name=T.ArrayType(_S), pos=T.ArrayType(_L), ms=T.ArrayType(_L))
#: Fixed for a checkpoint: shares that all paths are dealt into. What stands for a pos that is null.
SHARES, NO_POS = 1_024, -(1 << 63)
_SAID = _struct(key=T.ArrayType(_S), ms=T.ArrayType(_L))
_HELD = _struct(key=T.ArrayType(_S), ms=T.ArrayType(_L), event=T.ArrayType(_S))


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams may keep such state; the caller's own settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")  # timers fire when time has gone on, without a further row
    if zone := spark.conf.get("spark.sql.session.timeZone", None):
        own.conf.set("spark.sql.session.timeZone", zone)
    # a store is opened and written for each partition in each batch, whatever the batch holds: two a core are enough
    most = max(12, 2 * spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.shuffle.partitions", str(min(most, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return own


def _share(key: Column | str, shares: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shares)).alias("share")


def _lists(rows: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """Rows as tuples, without those of a null key, which only move the time on."""
    return (r for part in rows for r in zip(*(part[c].tolist() for c in columns), strict=True) if r[0] is not None)


class _Known(StatefulProcessor):
    """What is known of the paths of one share: signature and name, and when each was last seen. Calls on the state are for a share, not for a path; its one timer
    is for the path that was seen longest ago."""

    def __init__(self, lease_ms: int | None):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _KNOWN)

    def _load(self) -> dict[str, tuple]:
        now = self.known.get()
        return {k: tuple(rest) for k, *rest in zip(*now, strict=True)} if now else {}

    def _save(self, known: dict[str, tuple]) -> None:
        if not known:
            self.known.clear()
            return
        self.known.update((list(known), *map(list, zip(*known.values(), strict=True))))
        if self.lease_ms:
            due = min(x[3] for x in known.values()) + self.lease_ms
            if not any(t <= due for t in self.handle.listTimers()):
                self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = list(_lists(rows, "key", "ms", "gone", "pos", "signature", "name"))
        if not new:
            return
        known, out = self._load(), []
        for path, ms, gone, pos, signature, name in sorted(new, key=lambda r: (r[1], not r[2], r[3])):
            now = known.get(path)
            if now and ms <= now[3]:  # a repeated announcement, or one that a newer one overtook
                continue
            if gone:
                if now:
                    out.append((REMOVED, path, *now[:3], ms))
                    del known[path]
                continue
            out.append((ADDED if now is None else HIT if now[0] == signature else MODIFIED, path, signature, name, pos, ms))
            known[path] = (signature, name, pos, ms)
        if out:
            self._save(known)
            yield pd.DataFrame(out, columns=CHANGE.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - self.lease_ms
        known = self._load()
        out = [(REMOVED, path, *x[:3], x[3] + self.lease_ms) for path, x in known.items() if x[3] <= passed]
        self._save({path: x for path, x in known.items() if x[3] > passed})
        if out:
            yield pd.DataFrame(out, columns=CHANGE.names)

    def close(self) -> None:
        pass


def changes_of_paths(events: DataFrame, late: str, lease_ms: int | None = None, shares: int = SHARES) -> DataFrame:
    """Kind (Added, CacheHit, Modified, Removed), key, signature, name, pos, ms: a row for each sighting of a path and each loss.
    events: a stream of key, signature, name, pos, gone, at; whole snapshots or single changes, in any order within `late`. A path goes when an event says
    so, or, with a lease, when it wasn't seen for that long in event time: a timer fires, and what is gone is told without a new listing.
    Rows of a null key only move the time on. Of a path's events at one time the first counts. shares: the state is kept for so many shares of the paths (by hash),
    and a batch reads and writes the shares that it touches."""
    rows = events.withWatermark("at", late).select(_share("key", shares), "key", F.unix_millis("at").alias("ms"), "gone", F.coalesce("pos", F.lit(NO_POS)).alias("pos"), "signature", "name", "at")
    out = rows.groupBy("share").transformWithStateInPandas(_Known(lease_ms), CHANGE, "Append", "EventTime")
    return out.withColumn("pos", F.nullif("pos", F.lit(NO_POS)))


class _Announced(StatefulProcessor):
    """Of the paths of one share: when the program announced changes of its own, and events that wait until no announcement can come any more; what a batch brings is
    kept as one entry, column by column. The share's one timer is for what is due first."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getListState("said", _SAID)
        self.held = handle.getListState("held", _HELD)

    def _wake(self, said: list[tuple], held: list[tuple]) -> None:
        if said or held:
            self.handle.registerTimer(min([x[1] + self.keep_ms for x in said] + [x[1] for x in held]))

    @staticmethod
    def _columns(rows: list[tuple]) -> tuple:
        return tuple(map(list, zip(*rows, strict=True)))

    @staticmethod
    def _rows(state) -> list[tuple]:
        return [r for entry in state.get() for r in zip(*entry, strict=True)] if state.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        said, held = [], []
        for r in _lists(rows, "key", "ms", "event"):
            said.append(r[:2]) if r[2] is None else held.append(r)
        for state, new in ((self.said, said), (self.held, held)):
            if new:
                state.appendValue(self._columns(new))
        self._wake(said, held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        said, held = self._rows(self.said), self._rows(self.held)
        by_path: dict[str, list[int]] = {}
        for path, ms in sorted(said, key=lambda x: x[1]):
            by_path.setdefault(path, []).append(ms)

        def own(path: str, ms: int) -> bool:
            """The last announcement before the event is the one that may still hold."""
            at = by_path.get(path, ())
            last = bisect_right(at, ms)
            return last > 0 and at[last - 1] + self.keep_ms >= ms

        out = [event for path, ms, event in held if ms <= passed and not own(path, ms)]
        # an announcement lives as long as it can concern an event that is still to come
        live, wait = [x for x in said if x[1] + self.keep_ms > passed], [x for x in held if x[1] > passed]
        for state, rest, before in ((self.said, live, said), (self.held, wait, held)):
            if len(rest) < len(before):
                state.put([self._columns(rest)]) if rest else state.clear()
        self._wake(live, wait)
        if out:
            yield pd.DataFrame({"event": out})

    def close(self) -> None:
        pass


def others_changes_stream(events: DataFrame, expected: DataFrame, seconds: int, late: str, shares: int = SHARES) -> DataFrame:
    """Of a stream of events (path, at and others) those that the program didn't announce itself (expected: path, at) at most so many seconds before. An
    event waits until the watermark has passed it, so an announcement that comes after it, within `late`, still takes it out; an announcement is
    forgotten by event time, when no event can come that it concerns. Rows of a null path only move the time on. shares: as in changes_of_paths."""
    a = events.select(path_key("path").alias("key"), "at", F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("event"), F.col("path").isNull().alias("tick"))
    a = a.select(F.when(~F.col("tick"), F.col("key")).alias("key"), "at", "event")
    b = expected.select(path_key("path").alias("key"), "at", F.lit(None).cast("string").alias("event"))
    rows = a.unionByName(b).withWatermark("at", late).select(_share("key", shares), "key", F.unix_millis("at").alias("ms"), "event", "at")
    out = rows.groupBy("share").transformWithStateInPandas(_Announced(seconds * 1000), _struct(event=_S), "Append", "EventTime")
    return out.select(F.from_json("event", events.schema).alias("e")).select("e.*")
