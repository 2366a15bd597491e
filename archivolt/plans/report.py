"""What a plan comes to: filters, counts, totals, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.readers import first_per_key

#: Which statuses a filter shows; the first that fits a row is its class.
CLASSES = {"duplicate": ("Duplicate", "TargetExists"), "ambiguous": ("Ambiguous", "Choice"), "new": ("NewAuthor", "NewAuthorReuse"), "matched": ("Matched", "Manual", "AlreadyInTarget"), "excluded": ("Excluded",)}
ATTENTION = ("Ambiguous", "Choice", "Duplicate", "TargetExists", "Unrecognized", "Error")
MODES = {"Exact": "matched", "NewAuthor": "new", "Ambiguous": "ambiguous", "Unrecognized": "unrecognized"}


def view_class(status: Column) -> Column:
    """The one class a row is counted in."""
    return reduce(lambda c, kv: c.when(status.isin(*kv[1]), kv[0]), CLASSES.items(), F.when(F.lit(False), "")).otherwise("unrecognized")


def view(rows: DataFrame, name: str, status: str = "status") -> DataFrame:
    """P6."""
    if name == "all":
        return rows
    if name == "attention":
        return rows.filter(F.col(status).isin(*ATTENTION))
    return rows.filter(view_class(F.col(status)) == name)


def mode(name: str, status: Column) -> Column:
    """P9."""
    return F.lit(True) if name == "Global" else view_class(status) == MODES[name]


def filter_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row of counters; all and attention overlap the others."""
    c = view_class(F.col(status))
    n = lambda x, a: F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(a)
    return rows.agg(F.count(F.lit(1)).alias("all_rows"), n(F.col(status).isin(*ATTENTION), "attention"), *[n(c == k, k) for k in (*CLASSES, "unrecognized")])


def text_search(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Every term in some column, case aside."""
    for term in query.lower().split():
        rows = rows.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term)) for c in columns]))
    return rows


def safety_totals(rows: DataFrame, size: str, source_volume: str, target_volume: str, missing: str, target: str) -> DataFrame:
    """What a move would come to."""
    twice = rows.groupBy(F.lower(target).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("duplicate_targets"))
    cross = F.col(source_volume) != F.col(target_volume)
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(cross, F.col(size)).otherwise(0)), F.lit(0)).alias("cross_bytes"), F.coalesce(F.sum(F.col(missing).cast("long")), F.lit(0)).alias("missing"))
    return sums.join(twice, F.lit(True))  # one row and one row


def round_summary(rows: DataFrame, round_: str, status: str, hit: str) -> DataFrame:
    """Rounds of a simulation."""
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(round_).agg(F.count(F.lit(1)).alias("files"), n(F.col(hit)).alias("hits"), n(~F.col(hit)).alias("recalculated"), n(view_class(F.col(status)) == "matched").alias("matched"), n(view_class(F.col(status)) == "unrecognized").alias("unrecognized"))


def latest_first(rows: DataFrame, at: str, position: str, most: int | None = None) -> DataFrame:
    """O1: newest first, what has no time last, ties as they came."""
    out = rows.orderBy(F.desc_nulls_last(at), position)
    return out if most is None else out.limit(most)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """O2: a page of a total order; its size is clamped to 1..500."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def pages(count: Column, size: int) -> Column:
    """A20."""
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("long")


def by_priority(rows: DataFrame, status: str, order: list[str], then: list, most: int) -> DataFrame:
    """O3."""
    rank = reduce(lambda c, kv: c.when(F.col(status) == kv[1], kv[0]), enumerate(order), F.when(F.lit(False), 0)).otherwise(len(order))
    return rows.orderBy(rank, *then).limit(most)


def first_spelling(rows: DataFrame, name: str, position: str) -> DataFrame:
    """Of names that differ by case the first."""
    return first_per_key(rows.select(F.lower(name).alias("_k"), name, position), ["_k"], [position, name]).select(name, position)


def top_per_key(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """O4, O5."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def latest_lookup(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """P10: the newest row of each key."""
    rest = [c for c in rows.columns if c not in (*keys, at)]
    return rows.groupBy(*keys).agg(F.max(at).alias(at), *[F.max_by(c, F.struct(at, c)).alias(c) for c in rest])


def fresh(rows: DataFrame, at: str, now: Column, status: str, cooldown: dict[str, int], default: int) -> DataFrame:
    """P10: rows still within their status's cooldown (minutes) before now."""
    minutes = reduce(lambda c, kv: c.when(F.col(status) == kv[0], kv[1]), cooldown.items(), F.when(F.lit(False), 0)).otherwise(default)
    return rows.filter(F.unix_timestamp(now) - F.unix_timestamp(at) < minutes * 60)


def listing_union(user: DataFrame, public: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """All of the user's rows, then one page of the public ones; equal rows of both stay."""
    return user.withColumn("source_rank", F.lit(0)).unionByName(page(public, order, offset, limit).withColumn("source_rank", F.lit(1)))


def newest(rows: DataFrame, at: str, key: str, most: int = 1000) -> DataFrame:
    """The newest rows; the limit is the feature."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(most)
