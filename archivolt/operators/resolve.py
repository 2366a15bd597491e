"""From candidate names to entities and folders.  A cascade is one long table of (candidate, stage, targets): the first stage that
fires is a minimum, and how many targets it has is counted by name, not pair by pair."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, structured_parts, work_score
from ..sources.writers import settled

FOUND, AMBIGUOUS, NOT_FOUND = "Matched", "Ambiguous", "NotFound"


def norm_join(left: DataFrame, right: DataFrame, key: str, target: str, on: Sequence[str] = ("norm",)) -> DataFrame:
    """Key, target: by shared norms, and by role where on has it."""
    return left.select(key, *on).distinct().join(right.select(target, *on).distinct(), list(on)).select(key, target).distinct()


def alike(rows: DataFrame, key: str, on: Sequence[str] = ("norm",)) -> tuple[DataFrame, DataFrame]:
    """Keys of the same names as one: key, _set; and the names of each set (key, on), where the set's number stands for the key."""
    return _alike(settled(rows.groupBy(key).agg(_names(on))), key)


def _names(on: Sequence[str]) -> Column:
    return F.array_sort(F.collect_set(F.struct(*on))).alias("_names")


def _alike(own: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    sets = settled(own.select("_names").distinct().withColumn("_set", F.monotonically_increasing_id()))
    return own.join(sets, "_names").select(key, "_set"), sets.select(F.col("_set").alias(key), F.explode("_names").alias("_r")).select(key, "_r.*")


def counted(hits: DataFrame, held: DataFrame, key: str, target: str) -> DataFrame:
    """key, targets, target (the least) of distinct hits (key, target) whose targets are sets. held: target, _set."""
    sizes = held.groupBy("_set").agg(F.count(F.lit(1)).alias("_n"), F.min(target).alias("_t"))
    return hits.withColumnRenamed(target, "_set").join(sizes, "_set").groupBy(key).agg(F.sum("_n").alias("targets"), F.min("_t").alias(target))


def of_members(found: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """What was found for sets, for each of their keys. asked: key, _set."""
    return asked.join(found.withColumnRenamed(key, "_set"), "_set").select(found.columns)


def reached(names: DataFrame, index: DataFrame, key: str, target: str, on: Sequence[str] = ("norm",)) -> DataFrame:
    """Key, targets, target: how many targets norm_join finds for a key, and the least of them, without making the pairs. Targets are counted by name. Only of
    keys that find some by several names are the targets compared, keys of the same names being one, and so are targets of the same names."""
    held = index.select(target, *on).distinct()
    sizes = held.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(target).alias("_t"))
    found = names.join(sizes, list(on)).groupBy(key).agg(F.max("_n").alias("targets"), F.min("_t").alias(target), _names(on))
    found = settled(found.withColumn("_names", F.when(F.size("_names") > 1, F.col("_names"))))
    one = found.filter("_names IS NULL").drop("_names")
    several = found.filter("_names IS NOT NULL").select(key, "_names")
    if several.isEmpty():
        return one
    (asked, sets), (owners, classes) = _alike(several, key), alike(held, target, on)
    return one.unionByName(of_members(counted(norm_join(sets, classes, key, target, on), owners, key, target), asked, key))


def first_stage(stages: Sequence[tuple[DataFrame, str]], key: str, target: str) -> DataFrame:
    """Key, stage, status, target, targets.  stages: key, targets, target (the least of them), in order, each with what several targets mean (Choice or
    Ambiguous)."""
    long = reduce(DataFrame.unionByName, [c.select(key, F.struct(F.lit(i).alias("stage"), F.col("targets"), F.col(target).alias("_t"), F.lit(m).alias("_many")).alias("_s")) for i, (c, m) in enumerate(stages, 1)])
    hit = long.groupBy(key).agg(F.min("_s").alias("_s")).select(key, "_s.*")
    return hit.select(key, "stage", F.when(F.col("targets") == 1, FOUND).otherwise(F.col("_many")).alias("status"), F.when(F.col("targets") == 1, F.col("_t")).alias(target), "targets")


def cascade(stages: Sequence[tuple[DataFrame, str]], key: str, target: str) -> DataFrame:
    """first_stage() of hits (key, target)."""
    return first_stage([(h.groupBy(key).agg(F.countDistinct(target).alias("targets"), F.min(target).alias(target)), m) for h, m in stages], key, target)


#: The roles in which a folder's index holds a norm.
DIRECT, SOCIETY, CREATOR, SEGMENT, GENERIC, CAUTIOUS = range(6)


def role_cascade(names: DataFrame, index: DataFrame, entities: DataFrame, identity_names: DataFrame, key: str, target: str) -> DataFrame:
    """Key, stage, status, target, targets: a name as a whole, as a society, as a creator, as a segment of a society's name, in its generic form; then by the
    entity that it names, whose every name is looked for in all these roles; then cautiously. One role after another: the first that finds anything decides, one
    folder being a match and several a choice. An entity that isn't the only one of its name ends the search as ambiguous; one without folders doesn't.
    names: key, norm; index: target, role, norm; entities: key, status, entity_id; identity_names: entity_id, norm."""
    of = lambda *roles: index.filter(F.col("role").isin(*roles)).select(target, "norm")
    stages = [reached(names, of(r), key, target) for r in (DIRECT, SOCIETY, CREATOR, SEGMENT, GENERIC)]
    of_entity = norm_join(identity_names, of(DIRECT, SOCIETY, CREATOR, SEGMENT, GENERIC), "entity_id", target)
    stages += [reached(entities.filter(F.col("status") == FOUND), of_entity, key, target, ["entity_id"]), reached(names, of(CAUTIOUS), key, target)]
    hits = first_stage([(s, "Choice") for s in stages], key, target)
    unsure = entities.filter(F.col("status") == AMBIGUOUS).select(key, F.lit(True).alias("_unsure")).distinct()
    r = hits.join(unsure, key, "full")
    late = F.coalesce("_unsure", F.lit(False)) & (F.coalesce("stage", F.lit(len(stages))) > GENERIC + 1)
    kind = hits.schema[target].dataType
    return r.select(key, F.when(late, GENERIC + 2).otherwise(F.col("stage")).alias("stage"), F.when(late, AMBIGUOUS).otherwise(F.col("status")).alias("status"), F.when(late, F.lit(None).cast(kind)).otherwise(F.col(target)).alias(target), F.when(late, 0).otherwise(F.col("targets")).alias("targets"))


def structured_hits(society: DataFrame, creator: DataFrame, key: str, target: str) -> DataFrame:
    """Targets of either side; where both sides share some, only those."""
    both = society.join(creator, [key, target])
    return both.unionByName(society.unionByName(creator).distinct().join(both.select(key).distinct(), key, "left_anti"))


def combined(files: DataFrame, file: str, target: str) -> DataFrame:
    """File, status, target from its candidates (file, status, target, known: whether the KB alone knows it, cautious, position).
    A candidate that the KB knows uniquely decides; else any ambiguity does; else one target is a match and several are a choice; what is
    only cautious counts if nothing else was found."""
    r = files.withColumn("_hard", (F.col(target).isNotNull() & ~F.col("cautious")).cast("int"))
    a = r.groupBy(file).agg(
        F.min_by(target, F.when(F.col("known") & F.col(target).isNotNull(), F.col("position"))).alias("_known"),
        F.min(F.when(F.col("known") & F.col(target).isNotNull(), F.col("position"))).alias("_at"),
        F.max((F.col("status") == AMBIGUOUS).cast("int")).alias("_unsure"),
        F.countDistinct(F.when(F.col("_hard") == 1, F.col(target))).alias("_n"),
        F.min(F.when(F.col("_hard") == 1, F.col(target))).alias("_t"),
        F.countDistinct(F.when(F.col("cautious"), F.col(target))).alias("_cn"),
        F.min(F.when(F.col("cautious"), F.col(target))).alias("_ct"),
    )
    status = F.when(F.col("_at").isNotNull(), FOUND).when(F.col("_unsure") == 1, AMBIGUOUS).when(F.col("_n") == 1, FOUND).when(F.col("_n") > 1, "Choice").when(F.col("_cn") == 1, FOUND).when(F.col("_cn") > 1, "Choice").otherwise(NOT_FOUND)
    return a.select(file, status.alias("status"), F.when(F.col("_at").isNotNull(), F.col("_known")).when(F.col("_unsure") == 1, None).when(F.col("_n") == 1, F.col("_t")).when((F.col("_n") == 0) & (F.col("_cn") == 1), F.col("_ct")).alias(target))


def decided_names(names: DataFrame, holders: DataFrame, decisions: DataFrame) -> DataFrame:
    """Kind, norm, status, entity_id.  names: kind, norm.  holders: kind, norm, entity_id, user_confirmed.  decisions: kind, norm, entity_id, decision.
    A confirmed decision is the answer, a disabled one that there is none, a pending or independent one that it is open; else a
    single holder, or the single one that a person confirmed, is."""
    own = decisions.groupBy("kind", "norm").agg(F.min_by(F.struct("decision", "entity_id"), F.struct(F.when(F.col("decision") == "Disabled", 0).when(F.col("decision") == "Confirmed", 1).otherwise(2), "entity_id")).alias("_d"))
    held = holders.groupBy("kind", "norm").agg(
        F.countDistinct("entity_id").alias("_n"), F.min("entity_id").alias("_e"), F.countDistinct(F.when(F.col("user_confirmed"), F.col("entity_id"))).alias("_cn"), F.min(F.when(F.col("user_confirmed"), F.col("entity_id"))).alias("_ce")
    )
    r = names.join(own, ["kind", "norm"], "left").join(held, ["kind", "norm"], "left")
    d, n, cn = F.col("_d.decision"), F.coalesce("_n", F.lit(0)), F.coalesce("_cn", F.lit(0))
    open_ = d.isin("Pending", "Independent")
    status = F.when(d == "Confirmed", FOUND).when(d == "Disabled", NOT_FOUND).when(open_, AMBIGUOUS).when(n == 0, NOT_FOUND).when((n == 1) | (cn == 1), FOUND).otherwise(AMBIGUOUS)
    entity = F.when(d == "Confirmed", F.col("_d.entity_id")).when((d == "Disabled") | open_, None).when(n == 1, F.col("_e")).when(cn == 1, F.col("_ce"))
    return r.select("kind", "norm", F.coalesce(status, F.lit(NOT_FOUND)).alias("status"), entity.alias("entity_id"))


def user_first(user: DataFrame, public: DataFrame, keys: list[str]) -> DataFrame:
    """The user library's answer, and where it has none the public one's."""
    p = public.select(*keys, F.col("status").alias("_s"), F.col("entity_id").alias("_e"))
    r = user.join(p, keys, "full")
    none = F.coalesce("status", F.lit(NOT_FOUND)) == NOT_FOUND
    return r.select(*keys, F.when(none, F.coalesce("_s", F.lit(NOT_FOUND))).otherwise(F.col("status")).alias("status"), F.when(none, F.col("_e")).otherwise(F.col("entity_id")).alias("entity_id"), F.when(none, "public").otherwise("user").alias("library"))


def structured_entities(queries: DataFrame, groups: DataFrame, artists: DataFrame, relation: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Key, status, artist_id: artists of the creator's name that belong to a group of the society's name.  A tie goes to the only one with
    an alias "society (creator)" whose society is a norm of the query's or of its groups; else to the one whose aliases contain more of the
    creator's norms (of two characters or more), at least two.  queries: key, society, creator (norms).  groups: norm, group_id.  artists: norm,
    artist_id.  aliases: artist_id, alias (as written).  What several keys ask alike is resolved once."""
    asked = settled(queries.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("society", "creator"))).alias("_asked")))
    once = settled(asked.select("_asked").distinct().withColumn("_q", F.monotonically_increasing_id()))
    own = once.select("_q", F.explode("_asked").alias("r")).select("_q", "r.society", "r.creator")
    found = _structured_entities(own, groups, artists, relation, "_q", aliases)
    return asked.join(once.join(found, "_q"), "_asked").select(key, "status", "artist_id")


def _structured_entities(queries: DataFrame, groups: DataFrame, artists: DataFrame, relation: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    society = queries.select(key, F.col("society").alias("norm")).distinct()
    g = society.join(groups, "norm").select(key, "group_id").distinct()
    a = queries.select(key, F.col("creator").alias("norm")).distinct().join(artists, "norm").select(key, "artist_id").distinct()
    hit = a.join(relation.select("artist_id", "group_id"), "artist_id").join(g, [key, "group_id"], "left_semi").select(key, "artist_id").distinct()
    top = hit.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("artist_id").alias("_one"))
    ties = hit.join(top.filter("_n > 1").select(key), key, "left_semi")
    context = society.unionByName(g.join(groups, "group_id").select(key, "norm")).distinct()
    written = aliases.select("artist_id", normalize(structured_parts("alias", compat=False)["society"], compat=False).alias("norm")).filter("norm <> ''").distinct()
    structured = ties.join(written, "artist_id").join(context, [key, "norm"], "left_semi").groupBy(key).agg(F.countDistinct("artist_id").alias("_sn"), F.min("artist_id").alias("_s"))
    names = aliases.select("artist_id", normalize("alias", compat=False).alias("_alias")).distinct()
    evidence = queries.select(key, "creator").filter(F.length("creator") >= 2).distinct()
    score = ties.join(names, "artist_id").join(evidence, key).filter(F.contains("_alias", F.col("creator"))).groupBy(key, "artist_id").agg(F.countDistinct("creator").alias("_norms"))
    most = score.groupBy(key).agg(F.max("_norms").alias("_top"))
    best = score.join(most, key).filter("_norms = _top AND _top >= 2").groupBy(key).agg(F.count(F.lit(1)).alias("_ties"), F.min("artist_id").alias("_best"))
    r = top.join(structured, key, "left").join(best, key, "left")
    artist = F.when(F.col("_n") == 1, F.col("_one")).when(F.col("_sn") == 1, F.col("_s")).when(F.col("_ties") == 1, F.col("_best"))
    return r.select(key, F.when(artist.isNotNull(), FOUND).otherwise(AMBIGUOUS).alias("status"), artist.alias("artist_id"))


def overlaid(entity: DataFrame, alias: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases with bound overrides: names replaced, aliases added, names disabled, whatever their form.  overrides: entity_id, canonical_name, added_aliases, disabled_names."""
    o = overrides.select(F.col("entity_id").alias("id"), F.col("canonical_name").alias("_c"))
    names = entity.join(o, "id", "left").withColumn("canonical_name", F.coalesce(F.when(F.trim("_c") != "", F.col("_c")), "canonical_name")).drop("_c")
    off = overrides.select("entity_id", F.explode("disabled_names").alias("name")).select("entity_id", normalize("name").alias("norm")).distinct()
    on = overrides.select("entity_id", F.explode("added_aliases").alias("name")).select("entity_id", normalize("name").alias("norm"))
    return names, alias.select("entity_id", "norm").unionByName(on).filter("norm <> ''").distinct().join(off, ["entity_id", "norm"], "left_anti")


def overlaid_relations(relation: DataFrame, overrides: DataFrame) -> DataFrame:
    """artist_id, group_id, source, confirmed: the public relations, and those that bound overrides add and haven't disabled; a user's own group has its id
    negated, so it is none of the public ones. overrides: entity_id, user_groups (circle_id, user_confirmed, disabled)."""
    public = relation.select("artist_id", "group_id", F.lit("Public").alias("source"), F.lit(True).alias("confirmed"))
    own = overrides.select("entity_id", F.explode("user_groups").alias("g")).filter("NOT coalesce(g.disabled, false)")
    return public.unionByName(own.select(F.col("entity_id").alias("artist_id"), (-F.col("g.circle_id")).alias("group_id"), F.lit("User").alias("source"), F.coalesce("g.user_confirmed", F.lit(False)).alias("confirmed"))).distinct()


def bound(overrides: DataFrame, keys: DataFrame, version: str) -> DataFrame:
    """Overrides with entity_id: by stable key, else by the id they had in this version of the database; never by both at once, so no OR joins.
    A key that two entities have binds neither."""
    once = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("entity_id").alias("_by_key")).filter("_n = 1").select(F.col("key").alias("public_entity_key"), "_by_key")
    ids = keys.select(F.col("entity_id").alias("original_public_id")).distinct().withColumn("_by_id", F.col("original_public_id"))
    r = overrides.join(once, "public_entity_key", "left").join(ids, "original_public_id", "left")
    keyed = F.coalesce("public_entity_key", F.lit("")) != ""
    return r.withColumn("entity_id", F.when(keyed, F.col("_by_key")).when(F.col("database_version") == version, F.col("_by_id"))).drop("_by_key", "_by_id")


def remapped(children: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Ids: old_id, new_id."""
    m = ids.select(F.col("old_id").alias(column), "new_id")
    return children.join(m, column).withColumn(column, F.col("new_id")).drop("new_id").select(children.columns)


def name_conflicts(public: DataFrame, user: DataFrame) -> DataFrame:
    """Kind, norm, public_ids, user_ids: names that both libraries hold, for different entities.  Both: kind, norm, entity_id."""
    side = lambda r, c: r.groupBy("kind", "norm").agg(F.countDistinct("entity_id").alias(f"{c}_ids"), F.min("entity_id").alias(f"_{c}"))
    both = side(public, "public").join(side(user, "user"), ["kind", "norm"])
    return both.filter("public_ids > 1 OR user_ids > 1 OR _public <> _user").select("kind", "norm", "public_ids", "user_ids")


def relations(user: DataFrame, overrides: DataFrame, labels: DataFrame) -> DataFrame:
    """artist_id, group_id, source, label: the user's relations, then those nested in overrides, unlike rows kept apart."""
    nested = overrides.select(F.col("entity_id").alias("artist_id"), F.explode("user_groups").alias("g")).select("artist_id", "g.group_id", F.lit("override").alias("source"))
    both = user.select("artist_id", "group_id", F.lit("user").alias("source")).unionByName(nested)
    return both.join(labels.select(F.col("id").alias("group_id"), F.col("canonical_name").alias("label")), "group_id", "left").select("artist_id", "group_id", "source", F.coalesce("label", F.lit("")).alias("label"))


def online_confirmed(results: DataFrame, key: str) -> DataFrame:
    """Key, status, candidate: confirmed if exactly one exact candidate scores 90 and nothing speaks against it. results: key, candidate, exact, score, conflict, likely_group."""
    r = results.filter(~F.col("likely_group"))
    a = r.groupBy(key).agg(F.countDistinct(F.when(F.col("exact"), F.col("candidate"))).alias("_n"), F.max_by("candidate", F.when(F.col("exact"), F.col("score"))).alias("candidate"), F.max(F.when(F.col("exact"), F.col("score"))).alias("_s"), F.max(F.col("conflict").cast("int")).alias("_c"))
    ok = (F.col("_n") == 1) & (F.col("_s") >= 90) & (F.col("_c") == 0)
    return a.select(key, F.when(ok, "Confirmed").otherwise("Candidate").alias("status"), F.when(ok, F.col("candidate")).alias("candidate"))


def bridged(evidence: DataFrame, key: str) -> DataFrame:
    """Key, identity, works, score, bridge from evidence (key, identity, work, in_title, structured, tag_in_title), one row a work. An identity that
    only the search's aliases lead to counts if two works or more show it and no other identity of the key was reached that way; an identity that the
    titles' structure confirms in two works or more, and alone, scores at least 92."""
    e = evidence.filter(F.col("in_title") | F.col("tag_in_title"))
    each = e.groupBy(key, "identity").agg(F.countDistinct(F.lower("work")).alias("works"), F.max((~F.col("in_title")).cast("int")).alias("_alias"), F.max(((F.col("structured") & F.col("tag_in_title")) | ~F.col("in_title")).cast("int")).alias("_title"))
    all_ = each.groupBy(key).agg(F.sum("_alias").alias("_aliases"), F.sum("_title").alias("_titles"))
    r = each.join(all_, key).filter((F.col("_alias") == 0) | ((F.col("works") >= 2) & (F.col("_aliases") == 1)))
    sure = (F.col("_title") == 1) & (F.col("works") >= 2) & (F.col("_titles") == 1)
    score = work_score(F.col("works"), F.lit(True))
    return r.select(key, "identity", "works", F.when(sure, F.greatest(F.lit(92), score)).otherwise(score).alias("score"), F.when(sure & (F.col("_alias") == 1), "alias").when(sure, "title").otherwise("search").alias("bridge"))


def classic_first(classic: DataFrame, scored: DataFrame, manual: DataFrame, key: str, target: str) -> DataFrame:
    """A person's assignment, else the cascade, else the scores."""
    pick = lambda d, s: d.filter(F.col(target).isNotNull()).select(key, F.struct(F.col(target), F.lit(s).alias("by")).alias(f"_{s}"))
    r = pick(manual, "manual").join(pick(classic, "classic"), key, "full").join(pick(scored, "scored"), key, "full")
    return r.select(key, F.coalesce("_manual", "_classic", "_scored").alias("r")).select(key, f"r.{target}", "r.by")


def parents(authors: DataFrame, groups: DataFrame, number: str) -> DataFrame:
    """Folders of authors with their group's; those without one are left out."""
    return authors.join(groups, number)


def status_code(status: Column, evidence: Column) -> Column:
    """the outcome to show, in order of precedence."""
    order = ["Excluded", "Error", "TargetExists", "AlreadyInTarget", "Duplicate", "Deferred", "Manual", "NewAuthor", "NewAuthorReuse", "Choice", "Ambiguous", "Matched"]
    out = F.when(F.lit(False), "")
    for s in order:
        out = out.when(status == s, F.when((F.lit(s) == "Matched") & (evidence == "Cautious"), "MatchedCautious").otherwise(F.lit(s)))
    return out.otherwise("Unrecognized")


def by_alias_group(names: DataFrame, groups: DataFrame, folders: DataFrame, key: str, target: str) -> DataFrame:
    """Key, status, target: a name of one alias group stands for the folders of that group; one of several groups is ambiguous.
    names: key, norm.  groups: norm, canonical.  folders: canonical, target."""
    own = names.join(groups, "norm").groupBy(key).agg(F.countDistinct("canonical").alias("_g"), F.min("canonical").alias("canonical"))
    hit = own.join(folders, "canonical", "left").groupBy(key, "_g").agg(F.countDistinct(target).alias("_n"), F.min(target).alias("_t"))
    status = F.when(F.col("_g") > 1, AMBIGUOUS).when(F.col("_n") == 1, FOUND).when(F.col("_n") > 1, "Choice").otherwise(NOT_FOUND)
    return hit.select(key, status.alias("status"), F.when((F.col("_g") == 1) & (F.col("_n") == 1), F.col("_t")).alias(target))


def public(names: DataFrame, holders: DataFrame, key: str) -> DataFrame:
    """Key, status, entity_id: the distinct entities that any of a name's norms has; one is found, several are ambiguous.
    names: key, norm.  holders: norm, entity_id."""
    hit = norm_join(names, holders, key, "entity_id").groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("entity_id").alias("_e"))
    out = names.select(key).distinct().join(hit, key, "left")
    status = F.when(F.col("_n") == 1, FOUND).when(F.col("_n") > 1, AMBIGUOUS).otherwise(NOT_FOUND)
    return out.select(key, status.alias("status"), F.when(F.col("_n") == 1, F.col("_e")).alias("entity_id"))


def event_first(prefix_entities: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Key, as_event: a prefix that a person confirmed as a name is one, whatever its syntax says. prefix_entities: key, user_confirmed.  events: key."""
    own = prefix_entities.groupBy(key).agg(F.max(F.col("user_confirmed").cast("int")).alias("_c"))
    return events.select(key).distinct().join(own, key, "left").select(key, (F.coalesce("_c", F.lit(0)) == 0).alias("as_event"))
