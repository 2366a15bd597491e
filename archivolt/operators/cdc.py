"""Reconciling a snapshot of files with what was known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import in_scope
from ..functions.text import path_key, rename_signature

HIT, MODIFIED, MOVED, RENAMED, ADDED, REMOVED = "CacheHit", "Modified", "Moved", "Renamed", "Added", "Removed"


def delta(old: DataFrame, new: DataFrame, key: str, signature: str, name: str, order: str, scope: DataFrame | None = None) -> DataFrame:
    """Kind, old_key, new_key: a row for each of new, and for each of old that is gone.

    A signature relocates if exactly one missing old row has it; the first new row in order takes it.  That is an aggregate on either
    side and one equi-join, not a loop.  scope: the keys of old within which rows may have moved (all if none)."""
    o = old.select(F.col(key).alias("old_key"), F.col(signature).alias("_os"), F.col(name).alias("_on"))
    n = new.select(F.col(key).alias("new_key"), F.col(signature).alias("_ns"), F.col(name).alias("_nn"), F.col(order).alias("_order"))
    both = o.join(n, F.col("old_key") == F.col("new_key"), "full")
    same = both.filter("old_key IS NOT NULL AND new_key IS NOT NULL").select(F.when(F.col("_os") == F.col("_ns"), HIT).otherwise(MODIFIED).alias("kind"), "old_key", "new_key")
    missing, fresh = both.filter("new_key IS NULL").select("old_key", "_os", "_on"), both.filter("old_key IS NULL").select("new_key", "_ns", "_nn", "_order")
    may = missing if scope is None else missing.join(scope.select(F.col(key).alias("old_key")), "old_key", "left_semi")
    single = may.groupBy("_os").agg(F.count(F.lit(1)).alias("_c"), F.min("old_key").alias("old_key"), F.min("_on").alias("_on")).filter("_c = 1")
    first = fresh.groupBy("_ns").agg(F.min_by(F.struct("new_key", "_nn"), F.struct("_order", "new_key")).alias("_f"))
    moved = single.join(first, F.col("_os") == F.col("_ns")).select(F.when(F.col("_on") == F.col("_f._nn"), MOVED).otherwise(RENAMED).alias("kind"), "old_key", F.col("_f.new_key").alias("new_key"))
    added = fresh.join(moved.select("new_key"), "new_key", "left_anti").select(F.lit(ADDED).alias("kind"), F.lit(None).cast(old.schema[key].dataType).alias("old_key"), "new_key")
    gone = missing.join(moved.select("old_key"), "old_key", "left_anti").select(F.lit(REMOVED).alias("kind"), "old_key", F.lit(None).cast(new.schema[key].dataType).alias("new_key"))
    return same.unionByName(moved).unionByName(added).unionByName(gone)


def relocated(changes: DataFrame, scan: str) -> DataFrame:
    """C3 of changes that came path by path (kind, key, signature, name, pos and the scan they belong to): scan, kind, old_key, new_key, as delta() has them.
    Within a scan a signature relocates if exactly one lost path has it; the first new one in order takes it."""
    gone = changes.filter(F.col("kind") == REMOVED).groupBy(scan, "signature").agg(F.count(F.lit(1)).alias("_c"), F.min("key").alias("old_key"), F.min("name").alias("_on")).filter("_c = 1")
    first = changes.filter(F.col("kind") == ADDED).groupBy(scan, "signature").agg(F.min_by(F.struct("key", "name"), F.struct("pos", "key")).alias("_f"))
    moved = gone.join(first, [scan, "signature"]).select(scan, F.when(F.col("_on") == F.col("_f.name"), MOVED).otherwise(RENAMED).alias("kind"), "old_key", F.col("_f.key").alias("new_key"))
    key = F.col("key")
    old, new = F.when(F.col("kind") != ADDED, key), F.when(F.col("kind") != REMOVED, key)
    rest = changes.join(moved.select(scan, F.explode(F.array(F.struct(F.lit(REMOVED).alias("kind"), F.col("old_key").alias("key")), F.struct(F.lit(ADDED).alias("kind"), F.col("new_key").alias("key")))).alias("m")).select(scan, "m.*"), [scan, "kind", "key"], "left_anti")
    return rest.select(scan, "kind", old.alias("old_key"), new.alias("new_key")).unionByName(moved)


def with_signature(files: DataFrame) -> DataFrame:
    """key and signature of files (full_path, file_size, last_write_utc, creation_utc, extension)."""
    return files.withColumn("key", path_key("full_path")).withColumn("signature", rename_signature("file_size", "last_write_utc", "creation_utc", "extension"))


def counters(changes: DataFrame) -> DataFrame:
    """A14."""
    return changes.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


def invalidated(changes: DataFrame) -> DataFrame:
    """old_key, plan, recognition, facts: what a change makes stale."""
    k = F.col("kind")
    return changes.filter(F.col("old_key").isNotNull() & (k != HIT)).select("old_key", F.lit(True).alias("plan"), k.isin(RENAMED, REMOVED).alias("recognition"), k.isin(RENAMED, REMOVED).alias("facts"))


def scoped(members: DataFrame, files: DataFrame, seen: DataFrame, scope: str, known: bool, shallow: bool, safe: bool = False) -> tuple[DataFrame, DataFrame]:
    """Memberships and files after a scan of one scope.  members: scope_key, file_id.  seen: file_id.
    An unknown scope removes nothing.  A known one loses what wasn't seen; such files go altogether, whatever other scopes hold them, unless the
    scan was shallow (or safe asks to keep what others hold)."""
    now = seen.select(F.lit(scope).alias("scope_key"), "file_id")
    if not known:
        return members.unionByName(now).distinct(), files
    lost = members.filter(F.col("scope_key") == scope).join(seen.select("file_id"), "file_id", "left_anti").select("file_id")
    kept = members.filter(F.col("scope_key") != scope)
    if shallow or safe:
        gone = lost.join(kept.select("file_id").distinct(), "file_id", "left_anti")
    else:
        gone = lost
    return kept.join(gone, "file_id", "left_anti").unionByName(now).distinct(), files.join(gone, "file_id", "left_anti")


def scoped_many(members: DataFrame, files: DataFrame, seen: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C5, C6 for many scopes scanned at once: memberships and files afterwards. members, seen: scope_key, file_id; scopes: scope_key, known, shallow, safe.
    An unknown scope removes nothing. A known one loses what it didn't see; such a file goes altogether, whatever other scopes hold it, unless the scan
    was shallow or safe and some scope still holds it; a file that any of the scans saw stays."""
    keys = ["scope_key", "file_id"]
    now = seen.select(*keys).distinct()
    lost = members.join(scopes.filter("known").select("scope_key", (F.col("shallow") | F.col("safe")).alias("soft")), "scope_key").join(now, keys, "left_anti")
    held = members.join(lost.select(*keys), keys, "left_anti")
    hard = lost.filter("NOT soft").select("file_id")
    soft = lost.filter("soft").select("file_id").join(held.select("file_id"), "file_id", "left_anti")
    gone = hard.unionByName(soft).distinct().join(now.select("file_id"), "file_id", "left_anti")
    return held.join(gone, "file_id", "left_anti").unionByName(now).distinct(), files.join(gone, "file_id", "left_anti")


def shallow_children(files: DataFrame, directory: str, root: str) -> DataFrame:
    """C4: what a shallow scan may find moved: direct children alone."""
    return files.filter(in_scope(F.col(directory), F.lit(root), recursive=False))


def session(files: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first files of a session."""
    return files.orderBy(*order).limit(most)


def session_plans(members: DataFrame, files: DataFrame, plans: DataFrame, session_id, config: str, dependent: bool = False) -> DataFrame:
    """The plans of a session's files (members: session_id, file_id; files: file_id and others; plans: file_id, config_key and others) that were made under a
    configuration, or, dependent, under any that goes on from it with what it depends on. The session and the configuration are tested before
    anything is joined."""
    mark = f"{config}|AuthorDependency="
    fits = F.startswith("config_key", F.lit(mark)) if dependent else F.col("config_key") == config
    own = members.filter(F.col("session_id") == session_id).select("file_id")
    return own.join(files, "file_id").join(plans.filter(fits), "file_id")


def newest_sessions(sessions: DataFrame, at: str, key: str, most: int = 16) -> DataFrame:
    """The newest sessions; a bounded list that others are purged by."""
    return sessions.orderBy(F.desc(at), F.desc(key)).limit(most)


def applied(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files after the program's own moves (old_path, new_path), the last of each path counting. moves has seq."""
    last = moves.groupBy(path_key("old_path").alias("_k")).agg(F.max_by("new_path", "seq").alias("_to"))
    return files.withColumn("_k", path_key("full_path")).join(last, "_k", "left").withColumn("full_path", F.coalesce("_to", "full_path")).drop("_k", "_to")


def replaced(old: DataFrame, new: DataFrame, root: str, stamp_changed: bool) -> DataFrame:
    """A destination tree is replaced as a whole, if its stamp changed."""
    return old if not stamp_changed else old.filter(F.col("root") != root).unionByName(new)


def differences(index: DataFrame, listing: DataFrame, column: str) -> DataFrame:
    """Side, path: what only one of two listings has."""
    a, b = index.select(path_key(column).alias("path")).distinct(), listing.select(path_key(column).alias("path")).distinct()
    return a.join(b, "path", "left_anti").select(F.lit("index").alias("side"), "path").unionByName(b.join(a, "path", "left_anti").select(F.lit("listing").alias("side"), "path"))


def others_changes(events: DataFrame, expected: DataFrame, seconds: int = 10) -> DataFrame:
    """Events (path, at) that the program didn't cause itself (expected: path, at) within so many seconds before."""
    e = expected.select(path_key("path").alias("_k"), F.col("at").alias("_at"))
    ev = events.withColumn("_k", path_key("path"))
    return ev.join(e, (ev["_k"] == e["_k"]) & (ev["at"] >= e["_at"]) & (ev["at"] <= e["_at"] + F.make_dt_interval(secs=F.lit(seconds))), "left_anti").drop("_k")
