"""The knowledge base: evidence in, identities, aliases and relations out.  Each step of the merge is a join or an
aggregation over whole tables; nothing is probed row by row."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import norm as norm_of
from ..functions.text import is_non_ascii, normalize
from ..sources.readers import first_per_key
from ..sources.writers import numbered, settled

IMPORTED = "imported"
#: Which provider a source's names belong to, and how the keys of its names begin; names of other sources belong to "Archive:<source>".
PROVIDERS = {"nh-metadata-archive": "nHentai", "eh-current": "E-Hentai", "eh-tag-aggregate": "E-Hentai"}
KEY_PREFIXES = {"nHentai": "nhentai:", "E-Hentai": "ehentai:"}
KINDS = ("Artist", "Group")
AGGREGATE = "eh-tag-aggregate"
LONGEST = 300
#: What a base may lack of its columns, and with what they are filled.
ENTITY_EXTRAS = {"eh_artist_tag": "", "nh_artist_tag": "", "nh_group_tag": "", "eh_namespace": "", "eh_tag": "", "verification_source": "Unverified", "source_id": None}
SOURCED = {"source_id": None}


def newest_per_work(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of each key's greatest version.  The maxima are found first, then joined: no correlated subquery."""
    top = rows.groupBy(*keys).agg(F.max(version).alias("_top"))
    return rows.join(top, keys).filter(F.col(version) == F.col("_top")).drop("_top")


def with_dimension(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, name: str) -> DataFrame:
    """A left join whose missing names are empty."""
    d = dim.select(F.col(dim_key).alias(key), name)
    return facts.join(d, key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def imported_evidence(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence of files that are imported."""
    ok = files.filter(F.col("state") == IMPORTED).select("source_id", F.col("path").alias("source_file"))
    return evidence.join(ok, ["source_id", "source_file"])


def incoming(evidence: DataFrame, works: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """M2, A1: source_id, kind, norm, name, pretty, pretty_norm, works, provider, external_key.
    Evidence counts from the newest file of each work, of the files that are imported (files: all others are as if they weren't there; without
    it all are); for the tag aggregate, which has no works, from all."""
    if files is not None:
        evidence, works = imported_evidence(evidence, files), imported_evidence(works, files)
    newest = works.groupBy("source_id", "gallery_id").agg(F.max("source_file").alias("_newest"))
    rows = evidence.join(newest, ["source_id", "gallery_id"], "left").filter((F.col("source_id") == AGGREGATE) | (F.col("source_file") == F.col("_newest")))
    norm, given = F.col("normalized_name"), F.nullif(F.coalesce("pretty_name", F.lit("")), F.lit(""))
    own = F.nullif("normalized_pretty", F.lit("")) if "normalized_pretty" in evidence.columns else F.nullif(normalize(given), F.lit(""))
    out = rows.filter(F.col("entity_type").isin(*KINDS) & (F.length(norm) >= 1) & (F.length(norm) <= LONGEST)).groupBy("source_id", F.col("entity_type").alias("kind"), norm.alias("norm"))
    out = out.agg(F.min("name").alias("name"), F.min(F.coalesce(given, "name")).alias("pretty"), F.min(F.coalesce(own, norm)).alias("pretty_norm"), F.countDistinct("gallery_id").alias("works"))
    of = lambda values, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    out = out.withColumn("provider", F.coalesce(of(PROVIDERS, F.col("source_id")), F.concat(F.lit("Archive:"), "source_id")))
    prefix = F.coalesce(of(KEY_PREFIXES, F.col("provider")), F.concat(F.lit("archive:"), "source_id", F.lit(":")))
    return out.withColumn("external_key", F.concat(prefix, F.lower("kind"), F.lit(":"), "norm"))


def pair_weights(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, source: str, work: str) -> DataFrame:
    """Source, a, b, weight: works in which a and b occur together, by source. Either side has a name of a work once."""
    return left.join(right, on).groupBy(source, a, b).agg(F.count(work).alias("weight"))


def newest_pairs(rows: DataFrame, source: str, work: str, version: str, a: str, b: str) -> DataFrame:
    """J3, J4, A2 in one pass over rows that name both sides: source, a, b, weight, from the greatest version of each work. A work's names are gathered
    with their versions (as many as the work has), those of older ones go, and what is left is paired within the work."""
    names = lambda c: F.collect_set(F.struct(F.col(version).alias("v"), F.col(c).alias("n")))
    own = rows.groupBy(source, work).agg(F.max(version).alias("_top"), names(a).alias("_a"), names(b).alias("_b"))
    new = lambda c: F.transform(F.filter(F.col(c), lambda x: (x["v"] == F.col("_top")) & x["n"].isNotNull()), lambda x: x["n"])
    pairs = own.select(source, F.explode(new("_a")).alias(a), new("_b").alias("_b")).select(source, a, F.explode("_b").alias(b))
    return pairs.groupBy(source, a, b).agg(F.count(F.lit(1)).alias("weight"))


def max_weights(weights: DataFrame, a: str, b: str) -> DataFrame:
    """A3: over sources."""
    return weights.groupBy(a, b).agg(F.max("weight").alias("weight"))


def ambiguous(rows: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Keys that stand for more than one entity."""
    return rows.groupBy(*keys).agg(F.countDistinct(entity).alias("entities")).filter("entities > 1")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What target lacks is added."""
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti"))


def upsert_max(target: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The greatest value of either; other columns are the target's where it has the key."""
    rest = [c for c in target.columns if c not in (*keys, value)]
    both = target.withColumn("_own", F.lit(0)).unionByName(rows.withColumn("_own", F.lit(1)))
    picks = [F.min_by(F.col(c), F.struct("_own", F.col(c))).alias(c) for c in rest]
    return both.groupBy(*keys).agg(F.max(value).alias(value), *picks).select(*target.columns)


def without(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """NOT EXISTS, NOT IN."""
    return target.join(gone.select(*keys).distinct(), keys, "left_anti")


def smallest_source(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Of rows that compete for a key those of the smallest source."""
    low = rows.groupBy(*keys).agg(F.min(source).alias("_low"))
    return rows.join(low, keys).filter(F.col(source) == F.col("_low")).drop("_low")


@dataclass(frozen=True)
class Kb:
    """The tables of a knowledge base; conflicts are rebuilt by each merge. A base's entities may lack the columns of ENTITY_EXTRAS, its identities and
    aliases their source_id."""

    entity: DataFrame  # id, canonical_name, roman_name, norm, kind, external_id, verified, and ENTITY_EXTRAS
    identity: DataFrame  # provider, kind, norm, entity_id, tag, works, source_id
    alias: DataFrame  # entity_id, norm, alias, alias_type, source_id
    relation: DataFrame  # artist_id, group_id, weight
    relation_source: DataFrame | None = None  # source_id, artist_id, group_id, weight
    conflict: DataFrame | None = None  # source_id, kind, norm, name, reason, works
    source: DataFrame | None = None  # id, source_key


def assigned(base: Kb, rows: DataFrame) -> DataFrame:
    """M3-M5: rows with entity_id and conflict. A provider's own identity comes first; a name that several entities hold at other
    providers is a conflict; then the external key decides."""
    own = base.identity.select("provider", "kind", "norm", F.col("entity_id").alias("_own"))
    anyone = base.identity.groupBy("kind", "norm").agg(F.countDistinct("entity_id").alias("_holders"))
    external = base.entity.filter("external_id <> ''").groupBy(F.col("external_id").alias("external_key"), "kind").agg(F.min("id").alias("_ext"))
    out = rows.join(own, ["provider", "kind", "norm"], "left").join(anyone, ["kind", "norm"], "left").join(external, ["external_key", "kind"], "left")
    conflict = F.col("_own").isNull() & (F.coalesce("_holders", F.lit(0)) > 1)
    return out.withColumn("conflict", conflict).withColumn("entity_id", F.coalesce("_own", F.when(~conflict, F.col("_ext")))).drop("_own", "_holders", "_ext")


def created(base: Kb, rows: DataFrame, source: DataFrame) -> DataFrame:
    """M6: an entity for each (provider, kind, norm) that has none, as its smallest source has it, called by its pretty name; ids follow the largest there
    is, in order of source, kind and norm. source: id, source_key."""
    new = rows.filter("entity_id IS NULL AND NOT conflict")
    first = first_per_key(new.select("provider", "kind", "norm", "source_id", "name", "pretty", "pretty_norm", "external_key"), ["provider", "kind", "norm"], ["source_id", "name"])
    top = base.entity.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    rows = numbered(first, ["source_id", "kind", "norm", "provider"], "_n").join(source.select(F.col("id").alias("_source"), F.col("source_key").alias("source_id")), "source_id", "left")
    tag = lambda provider, kind=None: F.when((F.col("provider") == provider) & ((F.col("kind") == kind) if kind else F.lit(True)), F.col("name")).otherwise("")
    eh = F.col("provider") == "E-Hentai"
    return rows.select(
        (F.lit(top + 1) + F.col("_n")).alias("id"), F.col("pretty").alias("canonical_name"), F.col("pretty").alias("roman_name"), F.col("pretty_norm").alias("norm"), "kind", F.col("external_key").alias("external_id"), F.lit(False).alias("verified"),
        tag("E-Hentai", "Artist").alias("eh_artist_tag"), tag("nHentai", "Artist").alias("nh_artist_tag"), tag("nHentai", "Group").alias("nh_group_tag"), F.when(eh, F.lower("kind")).otherwise("").alias("eh_namespace"), tag("E-Hentai").alias("eh_tag"),
        F.when(eh, "OfflineDatabase").otherwise("Unverified").alias("verification_source"), F.col("_source").alias("source_id"),
    )


def filled(rows: DataFrame, extras: dict) -> DataFrame:
    """rows with the columns of extras that they lack."""
    return rows.withColumns({c: F.lit(v).cast("long" if v is None else "string") for c, v in extras.items() if c not in rows.columns})


def merge(base: Kb, evidence: DataFrame, works: DataFrame, files: DataFrame) -> Kb:
    """The base with what imported evidence adds. Run again on its own result it adds nothing (M15); a withdrawn file's evidence
    is gone when the base is merged anew (M18)."""
    files = settled(files)  # few rows, asked for in every step
    known = base.source if base.source is not None else base.entity.sparkSession.createDataFrame([], "id long, source_key string")
    source = settled(registered(known, files))
    by_source = source.select(F.col("id").alias("_source"), F.col("source_key").alias("source_id"))
    base = replace(base, entity=filled(base.entity, ENTITY_EXTRAS), identity=filled(base.identity, SOURCED), alias=filled(base.alias, SOURCED))
    rows = settled(assigned(base, incoming(evidence, works, files)))
    new = settled(created(base, rows, source))
    # what was just made is found by its key, like what was there
    made = new.select(F.col("external_id").alias("external_key"), "kind", F.col("id").alias("_new"))
    full = rows.join(made, ["external_key", "kind"], "left").withColumn("entity_id", F.coalesce("entity_id", F.when(~F.col("conflict"), F.col("_new")))).drop("_new")
    several = rows.filter("conflict").select("source_id", "kind", "norm", "name", F.lit("Multiple provider identities").alias("reason"), "works")
    apart = ambiguous(full.filter("entity_id IS NOT NULL"), ["kind", "norm"], "entity_id")
    crossed = full.filter("entity_id IS NOT NULL").join(apart, ["kind", "norm"], "left_semi").select("source_id", "kind", "norm", "name", F.lit("Cross-source identity ambiguity").alias("reason"), "works")
    conflict = crossed.unionByName(several.join(crossed, ["source_id", "kind", "norm"], "left_anti"))
    placed = full.filter("entity_id IS NOT NULL AND NOT conflict").join(by_source, "source_id", "left")
    first = F.struct("source_id", "name")
    own = placed.groupBy("provider", "kind", "norm").agg(F.min_by("entity_id", first).alias("entity_id"), F.min_by("name", first).alias("tag"), F.max("works").alias("works"), F.min_by("_source", first).alias("source_id"))
    identity = upsert_max(base.identity, own.select(base.identity.columns), ["provider", "kind", "norm"], "works")
    name = lambda norm, alias, kind, at: placed.select("entity_id", F.col(norm).alias("norm"), F.col(alias).alias("alias"), F.lit(kind).alias("alias_type"), F.col("_source").alias("source_id"), F.lit(at).alias("_at"), F.col("source_id").alias("_key"))
    names = name("norm", "name", "provider_tag", 0).unionByName(name("pretty_norm", "pretty", "roman", 1))
    names = first_per_key(names, ["entity_id", "norm"], ["_at", "_key", "alias"])
    alias = insert_ignore(base.alias, names.select(base.alias.columns), ["entity_id", "norm"])
    entity = base.entity.unionByName(new)
    for kind, column in (("Artist", "nh_artist_tag"), ("Group", "nh_group_tag")):
        tags = placed.filter((F.col("provider") == "nHentai") & (F.col("kind") == kind)).select(F.col("entity_id").alias("id"), "name")
        entity = filled_tags(entity, tags, column, F.col("kind") == kind)
    # relations: artist and group of the same work, in its newest imported file
    ok, ok_works = imported_evidence(evidence, files), imported_evidence(works, files)
    in_work = ok.filter(F.col("source_id") != AGGREGATE).join(placed.select("source_id", F.col("kind").alias("entity_type"), F.col("norm").alias("normalized_name"), "entity_id"), ["source_id", "entity_type", "normalized_name"])
    in_work = in_work.join(ok_works.groupBy("source_id", "gallery_id").agg(F.max("source_file").alias("source_file")), ["source_id", "gallery_id", "source_file"])
    side = lambda kind, c: in_work.filter(F.col("entity_type") == kind).select("source_id", "gallery_id", F.col("entity_id").alias(c)).distinct()
    weights = pair_weights(side("Artist", "artist_id"), side("Group", "group_id"), ["source_id", "gallery_id"], "artist_id", "group_id", "source_id", "gallery_id").filter("artist_id <> group_id")
    relation = upsert_max(base.relation, max_weights(weights, "artist_id", "group_id").select(base.relation.columns), ["artist_id", "group_id"], "weight")
    by = weights.select("source_id", "artist_id", "group_id", "weight")
    if base.relation_source is not None:
        by = upsert_max(base.relation_source.select(by.columns), by, ["source_id", "artist_id", "group_id"], "weight")
    return replace(base, entity=entity, identity=identity, alias=alias, relation=relation, relation_source=by, conflict=conflict, source=source)


def filled_tags(entity: DataFrame, names: DataFrame, column: str, only: Column | None = None) -> DataFrame:
    """Empty tags take the smallest name, of all entities or of those that only says. names: id, name."""
    low = names.groupBy("id").agg(F.min("name").alias("_tag"))
    tag = F.coalesce(F.nullif(column, F.lit("")), "_tag", F.lit(""))
    return entity.join(low, "id", "left").withColumn(column, tag if only is None else F.when(only, tag).otherwise(F.col(column))).drop("_tag").select(entity.columns)


def dangling(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children without a parent."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that aren't unique."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def wrong_relations(kb: Kb) -> DataFrame:
    """Relations that don't lead from an artist to a group."""
    kind = lambda c: kb.entity.select(F.col("id").alias(c), F.col("kind").alias(f"_{c}"))
    r = kb.relation.join(kind("artist_id"), "artist_id", "left").join(kind("group_id"), "group_id", "left")
    return r.filter("_artist_id IS DISTINCT FROM 'Artist' OR _group_id IS DISTINCT FROM 'Group' OR artist_id = group_id").select(kb.relation.columns)


def replace_file(rows: DataFrame, new: DataFrame | None, source_id: str, source_file: str) -> DataFrame:
    """A file's rows are replaced as a whole, or withdrawn."""
    rest = rows.filter((F.col("source_id") != source_id) | (F.col("source_file") != source_file))
    return rest if new is None else rest.unionByName(new)


def revalidated(evidence: DataFrame, resolved: DataFrame) -> DataFrame:
    """Status and entity_key anew, each distinct name resolved once. resolved: entity_type, normalized_name, name, status, entity_key."""
    keys = ["entity_type", "normalized_name", "name"]
    return evidence.drop("status", "entity_key").join(resolved.select(*keys, "status", "entity_key"), keys, "left").withColumn("status", F.coalesce("status", F.lit("Unresolved"))).withColumn("entity_key", F.coalesce("entity_key", F.lit("")))


def provider_results(library: DataFrame, results: DataFrame) -> DataFrame:
    """Library entries with blanks filled from a provider's result of the same (provider, external_id), where exactly one entry has it and
    no person confirmed it. Both: provider, external_id, canonical_name, roman_name; library also id, user_confirmed."""
    one = library.groupBy("provider", "external_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    new = first_per_key(results.select("provider", "external_id", F.col("canonical_name").alias("_c"), F.col("roman_name").alias("_r")), ["provider", "external_id"], ["_c", "_r"])
    out = library.join(one, ["provider", "external_id"], "left").join(new, ["provider", "external_id"], "left")
    fill = lambda c, n: F.when(F.col("user_confirmed") | F.col("_n").isNull(), F.col(c)).otherwise(F.coalesce(F.nullif(c, F.lit("")), n, F.lit("")))
    return out.withColumn("canonical_name", fill("canonical_name", "_c")).withColumn("roman_name", fill("roman_name", "_r")).select(library.columns)


def profile(names: DataFrame, kind: str, name: str) -> DataFrame:
    """By kind the rows, and those whose name has non-ASCII characters."""
    return names.groupBy(kind).agg(F.count(F.lit(1)).alias("rows"), F.sum(is_non_ascii(name).cast("long")).alias("non_ascii"))


def stable_keys(identity: DataFrame) -> DataFrame:
    """entity_id, key: the smallest of an entity's provider keys."""
    return identity.groupBy("entity_id").agg(F.min(F.concat_ws(":", "provider", "kind", "norm")).alias("key"))


def listed(rows: DataFrame, keys: list[str], value: str, out: str, sep: str = ", ", order: str | None = None) -> DataFrame:
    """Distinct values of each key as one string, in order."""
    return rows.select(*keys, value).distinct().groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), sep).alias(out))


def searched(entity: DataFrame, alias: DataFrame, text: str, offset: int = 0, limit: int = 50, identity: DataFrame | None = None) -> DataFrame:
    """A page of the entities whose norm, alias or provider's tag is LIKE the normalised text, by kind and name; without a text the newest of all. As
    in LIKE, % and _ in the text stand for any characters; the page size is clamped to 1..500. entity: id, kind, canonical_name, norm;
    alias: entity_id, norm; identity: entity_id, norm."""
    page = lambda rows: rows.offset(max(0, offset)).limit(min(500, max(1, limit)))
    wanted = norm_of(text)
    if not wanted:
        return page(entity.orderBy(F.desc("id")))
    like = F.lower("norm").like("%" + wanted.replace("\\", "\\\\") + "%")
    hit = entity.filter(like).select("id")
    for rows in (alias, identity):
        if rows is not None:
            hit = hit.unionByName(rows.filter(like).select(F.col("entity_id").alias("id")))
    kind = [c for c in ("kind",) if c in entity.columns]
    return page(entity.join(hit.distinct(), "id", "left_semi").orderBy(*kind, "canonical_name", "id"))


def related_groups(relation: DataFrame, entity: DataFrame) -> DataFrame:
    """artist_id, group_id, weight, group_name: one step along the relation; order by (artist_id, weight desc, group_id) to list them."""
    return relation.join(entity.select(F.col("id").alias("group_id"), F.col("canonical_name").alias("group_name")), "group_id").select("artist_id", "group_id", "weight", "group_name")


def evidence_counts(evidence: DataFrame, works: DataFrame) -> DataFrame:
    """source_id, works, files, names, resolved: distinct counts over compound keys."""
    w = works.groupBy("source_id").agg(F.countDistinct("gallery_id").alias("works"), F.countDistinct("source_file").alias("files"))
    e = evidence.groupBy("source_id").agg(F.countDistinct("entity_type", "normalized_name").alias("names"), F.countDistinct(F.when(F.col("status") == "Matched", F.struct("entity_type", "normalized_name"))).alias("resolved"))
    return w.join(e, "source_id", "full").select("source_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("works", "files", "names", "resolved")])


def evidence_sample(evidence: DataFrame, works: DataFrame, order: list[str], most: int) -> DataFrame:
    """Evidence with its work's titles, empty where the work is unknown, the statuses of order first, newest files first; the limit is the feature."""
    keys = ["source_id", "source_file", "gallery_id"]
    rows = evidence.join(works.select(*keys, "japanese_title", "english_title"), keys, "left").fillna("", ["japanese_title", "english_title"])
    rank = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        rank = F.when(F.col("status") == s, i).otherwise(rank)
    return rows.orderBy(rank, F.desc("source_file"), "source_id", "gallery_id", "normalized_name").limit(most)


def registered(sources: DataFrame, files: DataFrame) -> DataFrame:
    """M1: sources with those of imported files that it lacks; new ids follow the largest. Sources are few: one row for each provider."""
    new = files.filter(F.col("state") == IMPORTED).select(F.col("source_id").alias("source_key")).distinct().join(sources, "source_key", "left_anti")
    top = sources.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    rows = numbered(new, ["source_key"], "id")
    return sources.select("id", "source_key").unionByName(rows.select((F.lit(top + 1) + F.col("id")).cast(sources.schema["id"].dataType).alias("id"), "source_key"))
