"""Plans: where files go, what stands against it, and what of an earlier plan still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.writers import numbered, settled

MOVABLE = ("Matched", "NewAuthor", "NewAuthorReuse", "Manual")


def group_of_new(k: Column, highest: int, occupied: int, most: int) -> Column:
    """L1: the group of the k-th new identity (from 0): groups fill up one after another from the highest one."""
    if most <= 0:
        raise ValueError("a group holds at least one")
    top = max(1, highest)
    return F.when(F.lit(occupied < most), F.lit(top) + F.floor((F.lit(occupied) + k) / most)).otherwise(F.lit(top + 1) + F.floor(k / most)).cast("long")


def occupancy(folders: DataFrame, number: str) -> tuple[int, int]:
    """The highest group and how many it holds."""
    r = folders.groupBy(number).count().orderBy(F.desc(number)).limit(1).collect()
    return (r[0][0], r[0][1]) if r else (1, 0)


def allocated(files: DataFrame, identity: str, order: str, highest: int, occupied: int, most: int) -> DataFrame:
    """L1-L3: identity, first, slot, group_number: new identities in the order in which files first name them."""
    first = files.groupBy(identity).agg(F.min(order).alias("first"))
    return numbered(first, ["first", identity], "slot").withColumn("group_number", group_of_new(F.col("slot"), highest, occupied, most))


def new_statuses(files: DataFrame, identity: str, order: str) -> DataFrame:
    """L2: the first file of a new identity makes it, the others reuse it."""
    first = files.groupBy(identity).agg(F.min(order).alias("_f"))
    return files.join(first, identity).withColumn("status", F.when(F.col(order) == F.col("_f"), "NewAuthor").otherwise("NewAuthorReuse")).drop("_f")


def linked_identities(files: DataFrame, file: str, order: str, norms: str, trace: list | None = None) -> DataFrame:
    """H1, L2: file, identity for files that match no folder: a file takes over the identity that an earlier file of a shared norm planned.
    As the sequential rule has it: a planned identity has the norms of the file that made it; a file belongs to the earliest such file
    that shares a norm with it, and makes an identity itself if there is none.

    A round settles at once all files that no open file precedes in any of their norms: they are makers, and what shares a norm with a maker is taken. A
    file that exactly one open file precedes is a maker exactly if that one isn't: such files point to it, and pointers are doubled until they leave the chain, so a chain
    costs the logarithm of its length. Of each norm only the two earliest open files are looked at, found by aggregation, so a norm that many files share is
    no join of them. trace gets a word for each round and each doubling."""
    tell = trace.append if trace is not None else lambda _: None
    n = settled(files.select(F.col(file).alias("f"), F.struct(F.col(order).alias("o"), F.col(file).alias("f")).alias("at"), F.explode(norms).alias("norm")).distinct())
    open_, makers = n.select("f").distinct(), n.select("f", "norm").limit(0)
    while not open_.isEmpty():
        tell("round")
        live = n.join(open_, "f", "left_semi")
        first = live.groupBy("norm").agg(F.min("at").alias("one"))
        second = live.join(first, "norm").filter("at > one").groupBy("norm").agg(F.min("at").alias("two"))
        rows = live.join(first, "norm").join(second, "norm", "left")
        before = F.collect_set(F.when(F.col("at") > F.col("one"), F.col("one.f")))
        status = settled(rows.groupBy("f").agg(before.alias("before"), F.max(F.coalesce(F.col("at") > F.col("two"), F.lit(False))).alias("many")))
        roots = status.filter(F.size("before") == 0).select("f")
        # whether a file is a maker follows from the one it points to, turned around at each step
        chain = settled(status.filter((F.size("before") == 1) & ~F.col("many")).select("f", F.element_at("before", 1).alias("to"), F.lit(True).alias("turned")))
        while not chain.join(chain.select(F.col("f").alias("to")), "to", "left_semi").isEmpty():
            tell("doubling")
            ahead = chain.select(F.col("f").alias("to"), F.col("to").alias("_to"), F.col("turned").alias("_turned"))
            chain = settled(chain.join(ahead, "to", "left").select("f", F.coalesce("_to", "to").alias("to"), F.when(F.col("_to").isNull(), F.col("turned")).otherwise(F.col("turned") != F.col("_turned")).alias("turned")))
        ended = chain.join(roots.select(F.col("f").alias("to")), "to", "left_semi")
        new = settled(roots.unionByName(ended.filter("NOT turned").select("f")))
        by = n.join(new, "f", "left_semi").select("f", "norm")
        makers = settled(makers.unionByName(by))
        near = n.join(by.select("norm").distinct(), "norm", "left_semi").select("f")
        open_ = settled(open_.join(near, "f", "left_anti").join(ended.select("f"), "f", "left_anti").join(new, "f", "left_anti"))
    whose = makers.join(n.select("f", "at").distinct(), "f").select("norm", F.col("at").alias("maker"))
    taken = n.join(whose, "norm").filter("maker <= at").groupBy("f").agg(F.min("maker").alias("maker"))
    return taken.select(F.col("f").alias(file), F.col("maker.f").alias("identity"))


def canonical_label(files: DataFrame, groups: DataFrame, artist: str, society: str) -> DataFrame:
    """L4: "group (artist)" if exactly one related group has the society's norm among its own; else, and where there is no group or no society, the artist.
    groups: artist, group_norm, group_id, group_name, a row for each norm of a group; a group without a name is called by the society's text, if files have society_name."""
    pairs = files.select(artist, society).distinct()
    hit = pairs.join(groups, [artist]).filter(F.col("group_norm") == F.col(society)).groupBy(artist, society).agg(F.countDistinct("group_id").alias("_n"), F.min("group_name").alias("_g"))
    called = F.nullif(F.trim("_g"), F.lit(""))
    if "society_name" in files.columns:
        called = F.coalesce(called, "society_name")
    label = F.when((F.col("_n") == 1) & called.isNotNull(), F.concat(called, F.lit(" ("), "artist_name", F.lit(")"))).otherwise(F.col("artist_name"))
    return files.join(hit, [artist, society], "left").select(*files.columns, label.alias("label"))


def terminal_state(source: Column, target: Column, exists: Column) -> Column:
    """L5."""
    return F.when(F.lower(source) == F.lower(target), "AlreadyInTarget").when(exists, "TargetExists").otherwise("Movable")


def batch_conflicts(rows: DataFrame, source: str, target: str) -> DataFrame:
    """A10: rows whose target more than one distinct source has, and how many. Counted per target first; only the targets that conflict join back."""
    key = F.lower(target)
    several = rows.groupBy(key.alias("_k")).agg(F.countDistinct(F.lower(source)).alias("sources")).filter("sources > 1")
    return rows.join(several, key == F.col("_k")).drop("_k")


def conflict_sources(rows: DataFrame, source: str, target: str) -> DataFrame:
    """A10: rows whose target more than one distinct source has, with the list of these sources, in order."""
    key = F.lower(target)
    pairs = rows.groupBy(key.alias("_k"), F.lower(source).alias("_s")).agg(F.min(source).alias("_source"))
    listed = pairs.groupBy("_k").agg(F.array_sort(F.collect_list("_source")).alias("sources")).filter(F.size("sources") > 1)
    return rows.join(listed, key == F.col("_k")).drop("_k")


def identity_key(canonical: Column, entity: Column, name: Column, compat: bool = True) -> Column:
    """L3: what a new folder is for: an alias group's canonical name, an entity, or the name itself."""
    has = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""
    return F.when(has(canonical), F.concat(F.lit("alias:"), normalize(canonical, compat))).when(has(entity), F.concat(F.lit("entity:"), entity.cast("string"))).otherwise(F.concat(F.lit("name:"), normalize(name, compat)))


def first_per_target(rows: DataFrame, target: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """The first row of each target is carried out, unless the target is there."""
    first = rows.groupBy(F.lower(target).alias("_k")).agg(F.min(order).alias("_f"))
    out = rows.join(first, (F.lower(target) == F.col("_k")) & (F.col(order) == F.col("_f")), "left").withColumn("executed", F.col("_f").isNotNull()).drop("_k", "_f")
    if existing is not None:
        there = existing.select(F.lower(target).alias("_e")).distinct()
        out = out.join(there, F.lower(target) == F.col("_e"), "left").withColumn("executed", F.col("executed") & F.col("_e").isNull()).drop("_e")
    return out


def merged_cache(cached: DataFrame, stale: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """Cached rows that hold, and recomputed ones for the rest."""
    return cached.join(stale.select(key), key, "left_anti").join(recomputed.select(key), key, "left_anti").unionByName(recomputed)


def still_valid(cached: DataFrame, facts: DataFrame, keys: list[str], deny: tuple[str, ...] = ("Error", "Cancelled")) -> DataFrame:
    """Cached results whose fingerprint and versions are today's, and whose status may be kept."""
    return cached.filter(~F.col("status").isin(*deny)).join(facts.select(*keys), keys, "left_semi")


def same_preview(a: DataFrame, b: DataFrame) -> bool:
    """L11."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def replanned(rows: DataFrame, edited: DataFrame, recompute, key: str, author_norm: str) -> DataFrame:
    """The rows that an edit touches (the edited row, rows of the same author, movable ones) computed anew and put back."""
    norms = rows.join(edited.select(key), key, "left_semi").select(author_norm).distinct()
    touched = rows.join(norms, author_norm, "left_semi").select(key).unionByName(edited.select(key)).unionByName(rows.filter(F.col("status").isin(*MOVABLE)).select(key)).distinct()
    new = recompute(rows.join(touched, key, "left_semi"))
    return rows.join(touched, key, "left_anti").unionByName(new.select(rows.columns))


def restored(session: DataFrame, types: list[str], depth: int, extension: str = "extension", level: str = "depth") -> DataFrame:
    """An earlier session's rows that today's settings still allow."""
    return session.filter(F.lower(extension).isin([t.lower() for t in types]) & (F.col(level) <= depth))


def lcg_sample(rows: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """A sample that looks shuffled and is the same every time. The sampling is the feature."""
    return rows.orderBy(((F.col(key) * 1103515245) + seed) % 2147483647, key).limit(most)


def synthetic(spark, files: int, authors: int, changed: int = 0) -> DataFrame:
    """File, author, name, size, changed: a made-up library; of changed files every files/changed-th one."""
    i = F.col("id")
    name = F.when(i % 3 == 0, F.concat(F.lit("["), F.concat(F.lit("author"), i % authors), F.lit("] work "), i)).when(i % 3 == 1, F.concat(F.lit("[circle"), i % authors, F.lit(" (author"), i % authors, F.lit(")] work "), i)).otherwise(F.concat(F.lit("(C99) [author"), i % authors, F.lit("] work "), i))
    mark = F.lit(False) if not changed else (F.floor((i + 1) * changed / files) > F.floor(i * changed / files))
    return spark.range(files).select(i.alias("file"), (i % authors).alias("author"), F.concat(name, F.lit(".zip")).alias("name"), (F.lit(1024) + F.pmod(i * 7919, F.lit(1 << 20))).alias("size"), mark.alias("changed"))


def early_stop(rows: DataFrame, mode: Column, most: int) -> DataFrame:
    """The first rows of a mode; the limit is the feature."""
    return rows.filter(mode).limit(most)
