"""What online providers found, taken into a user's library as one batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK, normalize, pretty_tag
from ..sources.readers import first_per_key
from ..sources.writers import numbered, settled
from .kb import insert_ignore

#: How evidence is labelled, in this order; providers whose group names are tags; how surely an author is known.
LABELS = (("EhTagTranslation/", "EhTagTranslation"), ("EhTagDb/", "EhTagDb"), ("E-Hentai/", "E-Hentai"), ("nHentai/", "nHentai"))
GROUP_TAGGERS = ("nhentai", "evidencechain")
TITLED, EXACT_TAG = "EHTitleBridge", "EHTagExact"
PRESERVED, FOUND = "preserved user-confirmed identity", "unique exact artist identity"


@dataclass(frozen=True)
class Library:
    authors: DataFrame  # id, canonical_name, roman_name, eh_artist_tag, nh_artist_tag, source, external_id, entity_type, verification_source, eh_namespace, eh_tag, verified, user_confirmed
    aliases: DataFrame  # author_id, alias, alias_type, source
    circles: DataFrame  # id, canonical_name, eh_group_tag, nh_group_tag, source
    author_circles: DataFrame  # author_id, circle_id, source
    lookups: DataFrame  # provider, query, query_norm, status, author_id, checked_utc, detail


def _given(c: str | Column) -> Column:
    """The text, or null where it is blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", c)


def _has(prefix: str) -> Column:
    return F.coalesce(F.exists("evidence", lambda x: F.startswith(F.lower(x), F.lit(prefix.lower()))), F.lit(False))


def _labelled(results: DataFrame) -> DataFrame:
    """Results that can be artists, with their label and the name that they give."""
    label = F.concat_ws(" + ", *[F.when(_has(p), F.lit(name)) for p, name in LABELS])
    able = lambda c, what: _given(c).isNull() | (F.lower(c) == what)
    rows = results.withColumn("label", F.coalesce(_given(label), "provider", F.lit(""))).filter(able("entity_type", "artist") & able("namespace", "artist") & ~F.contains(F.lower("label"), F.lit("ehtagtranslation")))
    known = F.filter(F.transform(F.coalesce("other_names", F.array().cast("array<string>")), pretty_tag), lambda x: x.rlike(CJK))
    name = F.when(F.col("query").rlike(CJK), F.trim("query")).when(F.size(known) > 0, F.try_element_at(known, F.lit(1))).otherwise(F.coalesce(_given(pretty_tag("tag")), F.trim("query")))
    return rows.withColumn("name", name).withColumn("eh", _has("E-Hentai/")).withColumn("nh", _has("nHentai/")).withColumn("titled", _has("E-Hentai/TitleSearch"))


def _found(rows: DataFrame, authors: DataFrame) -> DataFrame:
    """seq, author_id: the one author whom a result's external id or tag names; none where several do. Each way is a join of its own."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    a = authors.filter("entity_type = 'Artist'").select(F.col("id").alias("author_id"), low("external_id").alias("ax"), low("source").alias("as"), low("eh_artist_tag").alias("ae"), low("nh_artist_tag").alias("an"), low("eh_tag").alias("at"), F.col("eh_namespace").alias("ns"))
    r = rows.select("seq", low("external_id").alias("x"), low("label").alias("l"), low("tag").alias("t"))
    ext, tag = r.filter("trim(x) <> ''"), r.filter("trim(t) <> ''")
    eh, nh = F.contains("l", F.lit("e-hentai")), F.contains("l", F.lit("nhentai"))
    ways = [
        ext.join(a, (ext["x"] == a["ax"]) & (ext["l"] == a["as"])), tag.filter(eh).join(a, F.col("t") == a["ae"]), tag.filter(nh & ~eh).join(a, F.col("t") == a["an"]),
        tag.join(a.filter("ns IS DISTINCT FROM 'group'"), (tag["t"] == F.col("at")) & (tag["l"] == F.col("as"))),
    ]
    hits = ways[0].select("seq", "author_id")
    for w in ways[1:]:
        hits = hits.unionByName(w.select("seq", "author_id"))
    return hits.distinct().groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("author_id").alias("author_id")).filter("n = 1").drop("n")


def merged(library: Library, results: DataFrame) -> Library:
    """The library with a batch of results (seq, provider, query, external_id, tag, namespace, entity_type, evidence, other_names, group_name, checked_utc).

    A result belongs to the one author whom its external id or tag names in the library as it was; else to a new one, which results of the same label and external
    id (or tag) make once. An author whom a person confirmed, or whom better evidence verified, stays as it is: only the lookup is noted. For the rest
    blanks are filled by the first result, and source, kind and tag are the last one's. Names become aliases, groups are found or made by their norm."""
    rows = settled(_labelled(results))
    found = rows.join(_found(rows, library.authors), "seq", "left")
    key = F.concat_ws("\n", F.lower("label"), F.coalesce(F.lower(_given("external_id")), F.concat(F.lit("tag:"), F.lower(_given("tag"))), F.concat(F.lit("seq:"), "seq")))
    fresh = found.filter("author_id IS NULL").select("seq", key.alias("key"))
    top = library.authors.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    made = numbered(fresh.groupBy("key").agg(F.min("seq").alias("first")), ["first"], "n").select("key", (F.lit(top + 1) + F.col("n")).alias("new_id"))
    found = found.join(fresh.join(made, "key").select("seq", "new_id"), "seq", "left")
    held = library.authors.select(F.col("id").alias("author_id"), F.col("user_confirmed").alias("_sure"), (F.col("verified") | F.col("verification_source").isin(EXACT_TAG, TITLED)).alias("_known"), F.contains(F.lower("source"), F.lit("e-hentai")).alias("_eh"))
    rows = found.join(held, "author_id", "left").withColumn("kept", F.coalesce(F.col("_sure") | (F.col("_known") & F.col("_eh") & ~F.contains(F.lower("label"), F.lit("e-hentai"))), F.lit(False)))
    rows = settled(rows.withColumn("author_id", F.coalesce("author_id", "new_id")).drop("new_id", "_sure", "_known", "_eh"))
    live = rows.filter("NOT kept")
    # authors
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("seq")))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    tag = _given("tag")
    new = live.groupBy(F.col("author_id").alias("id")).agg(
        first(_given("name")).alias("r_name"), first(_given(pretty_tag("tag"))).alias("r_roman"), first(F.when(F.col("eh") & (F.lower("namespace") == "artist"), tag)).alias("r_eh"), first(F.when(F.col("nh"), tag)).alias("r_nh"),
        first(F.coalesce("external_id", F.lit(""))).alias("r_ext"), last(_given("label")).alias("r_source"), last(_given("entity_type")).alias("r_type"), last(_given("namespace")).alias("r_ns"), last(tag).alias("r_tag"), F.max_by("titled", "seq").alias("r_titled"),
    )
    a = library.authors.join(new, "id", "full")
    blank = lambda own, other: F.coalesce(_given(own), other, F.lit(""))
    over = lambda other, own, default="": F.coalesce(other, own, F.lit(default))
    verified = F.when(F.col("r_titled"), TITLED).when(~F.col("r_titled"), EXACT_TAG)
    authors = a.select(
        "id", blank("canonical_name", F.col("r_name")).alias("canonical_name"), blank("roman_name", F.col("r_roman")).alias("roman_name"), blank("eh_artist_tag", F.col("r_eh")).alias("eh_artist_tag"), blank("nh_artist_tag", F.col("r_nh")).alias("nh_artist_tag"),
        over(F.col("r_source"), F.col("source")).alias("source"), F.coalesce("external_id", "r_ext", F.lit("")).alias("external_id"), over(F.col("r_type"), F.col("entity_type"), "Artist").alias("entity_type"), over(verified, F.col("verification_source")).alias("verification_source"),
        over(F.col("r_ns"), F.col("eh_namespace"), "artist").alias("eh_namespace"), over(F.col("r_tag"), F.col("eh_tag")).alias("eh_tag"), F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce("user_confirmed", F.lit(False)).alias("user_confirmed"),
    )
    # aliases: each form once, the first kind of it counting
    pair = lambda kind, name: F.struct(F.lit(kind).alias("alias_type"), name.alias("alias"))
    others = F.flatten(F.transform(F.coalesce("other_names", F.array().cast("array<string>")), lambda x: F.array(pair("other_name", x), pair("other_name", pretty_tag(x)))))
    names = live.select("author_id", "seq", F.col("label").alias("source"), F.posexplode(F.concat(F.array(pair("query", F.col("query")), pair("provider_tag", F.col("tag")), pair("roman", pretty_tag("tag"))), others)).alias("at", "x"))
    names = names.select("author_id", "seq", "at", "source", "x.alias_type", F.trim("x.alias").alias("alias")).withColumn("norm", normalize("alias")).filter("norm <> ''")
    names = first_per_key(names, ["author_id", "norm"], ["seq", "at"])
    aliases = insert_ignore(library.aliases.withColumn("norm", normalize("alias")), names.select(*library.aliases.columns, "norm"), ["author_id", "norm"]).drop("norm")
    # groups
    wanted = live.withColumn("norm", normalize("group_name")).filter("norm <> ''")
    have = library.circles.select("id", F.explode(F.array("canonical_name", "eh_group_tag", "nh_group_tag")).alias("n")).select("id", normalize("n").alias("norm")).filter("norm <> ''").groupBy("norm").agg(F.min("id").alias("circle_id"))
    lacking = first_per_key(wanted.join(have, "norm", "left_anti").select("norm", "seq", "group_name", "provider"), ["norm"], ["seq"])
    most = library.circles.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    lacking = settled(numbered(lacking, ["seq"], "n").withColumn("id", F.lit(most + 1) + F.col("n")))
    circles = library.circles.unionByName(lacking.select("id", pretty_tag("group_name").alias("canonical_name"), F.lit("").alias("eh_group_tag"), F.when(F.lower("provider").isin(*GROUP_TAGGERS), F.col("group_name")).otherwise("").alias("nh_group_tag"), F.coalesce("provider", F.lit("")).alias("source")))
    every = have.unionByName(lacking.select("norm", F.col("id").alias("circle_id")))
    related = first_per_key(wanted.join(every, "norm").select("author_id", "circle_id", "seq", F.coalesce("provider", F.lit("")).alias("source")), ["author_id", "circle_id"], ["seq"])
    author_circles = insert_ignore(library.author_circles, related.select(library.author_circles.columns), ["author_id", "circle_id"])
    # lookups
    noted = rows.withColumn("query_norm", normalize("query")).filter("query_norm <> ''").withColumn("_p", F.lower(F.coalesce("provider", F.lit(""))))
    noted = noted.groupBy("_p", "query_norm").agg(F.max_by(F.struct("provider", "query", "author_id", "checked_utc", F.when(F.col("kept"), PRESERVED).otherwise(FOUND).alias("detail")), "seq").alias("r"))
    old = library.lookups.withColumn("_p", F.lower(F.coalesce("provider", F.lit("")))).join(noted, ["_p", "query_norm"], "left_anti").select(library.lookups.columns)
    lookups = old.unionByName(noted.select("query_norm", F.lit("resolved").alias("status"), "r.*").select(library.lookups.columns))
    return Library(authors, aliases, circles, author_circles, lookups)
