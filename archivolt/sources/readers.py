"""Readers: delimited evidence, tag dumps, listings, libraries, logs, manifests, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import first_spelling, normalize, split_names, text_of

MAX_FIELD = 4 * 1024 * 1024
#: Columns a monthly file must have, and those it may have.
REQUIRED, OPTIONAL = ("ID", "ARTIST", "GROUP_NAME"), ("JP_TITLE", "EN_TITLE")
CREATOR_NAMESPACES = {"artist": "artist", "group": "group", "circle": "group"}


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """SRC1: quoted fields, doubled quotes, line breaks within quotes; a field that never closes is an error."""
    reader = spark.read.option("header", True).option("multiLine", True).option("sep", sep).option("quote", '"').option("escape", '"')
    return reader.option("mode", "FAILFAST").option("nullValue", "\x00").option("emptyValue", "").option("maxCharsPerColumn", MAX_FIELD).csv(path)


def monthly_file(spark: SparkSession, path: str, source_id: str, source_file: str) -> DataFrame:
    """SRC2: source_id, source_file, gallery_id, artist_raw, group_raw, japanese_title, english_title.
    Headers in any case, with or without a byte-order mark; only positive whole ids; of repeated ids the first row."""
    raw = delimited(spark, path)
    have = {c.replace("﻿", "").strip().upper(): c for c in raw.columns}
    missing = [c for c in REQUIRED if c not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    pick = lambda c: F.coalesce(F.col(f"`{have[c]}`"), F.lit("")) if c in have else F.lit("")
    rows = raw.select(F.trim(pick("ID")).alias("gallery_id"), *[pick(c).alias(n) for c, n in (("ARTIST", "artist_raw"), ("GROUP_NAME", "group_raw"), ("JP_TITLE", "japanese_title"), ("EN_TITLE", "english_title"))])
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).filter(F.expr("try_cast(gallery_id AS bigint) > 0"))
    return first_per_key(rows, ["gallery_id"], ["_at"]).drop("_at").select(F.lit(source_id).alias("source_id"), F.lit(source_file).alias("source_file"), "*")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: an aggregation with partial results, so a hot key is reduced before it moves."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def entity_evidence(works: DataFrame) -> DataFrame:
    """Names of works as evidence: source_id, source_file, gallery_id, entity_type, name, normalized_name."""
    side = lambda column, kind: works.select("source_id", "source_file", "gallery_id", F.lit(kind).alias("entity_type"), F.explode(split_names(column)).alias("name"))
    both = side("artist_raw", "Artist").unionByName(side("group_raw", "Group"))
    both = both.withColumn("normalized_name", normalize("name")).filter((F.length("normalized_name") > 0) & (F.length("normalized_name") <= 300))
    return first_per_key(both, ["source_id", "source_file", "gallery_id", "entity_type", "normalized_name"], ["name"])


def tag_aggregate(tags: DataFrame) -> DataFrame:
    """SRC3: gallery_id (made up), entity_type, name from (namespace, tag)."""
    ns = F.lower(F.trim(text_of("namespace")))
    rows = tags.select(ns.alias("ns"), F.trim(text_of("tag")).alias("name")).filter(F.col("ns").isin(*CREATOR_NAMESPACES) & (F.col("name") != ""))
    rows = rows.withColumn("ns", F.when(F.col("ns") == "circle", "group").otherwise(F.col("ns")))
    return rows.select(F.concat_ws(":", F.lit("tag"), "ns", "name").alias("gallery_id"), F.initcap("ns").alias("entity_type"), "name").distinct()


def discover_link_tables(tables: dict[str, DataFrame]) -> tuple[str, dict[str, str], str, dict[str, str]]:
    """SRC4: which of a dump's tables holds the tags and which the links, by column names: (tag table, its columns, link table, its columns)."""

    def pick(df: DataFrame, wanted: dict[str, tuple[str, ...]], optional=()) -> dict[str, str] | None:
        low = {c.lower(): c for c in df.columns}
        found = {k: next((low[n] for n in names if n in low), None) for k, names in wanted.items()}
        return found if all(v for k, v in found.items() if k not in optional) else None

    links = {n: p for n, t in tables.items() if (p := pick(t, {"tag": ("tag_id", "tagid", "tid"), "gallery": ("gallery_id", "galleryid", "gid")}))}
    tags = {n: p for n, t in tables.items() if n not in links and (p := pick(t, {"id": ("tag_id", "tagid", "id"), "name": ("name", "tag", "value"), "namespace": ("namespace", "type", "category")}, ("namespace",)))}
    if not links or not tags:
        raise ValueError("no tag table or no link table found")
    t, k = sorted(tags)[0], sorted(links)[0]
    return t, tags[t], k, links[k]


def gallery_dump(tables: dict[str, DataFrame]) -> DataFrame:
    """SRC4: gallery_id, title, title_jpn, artists, groups: one row for each gallery with a creator, expunged ones apart."""
    t, tc, k, kc = discover_link_tables(tables)
    raw = F.lower(F.coalesce(F.col(tc["namespace"]).cast("string"), F.lit(""))) if tc["namespace"] else F.lit("")
    whole = F.col(tc["name"]).cast("string")
    coded = whole.rlike(r"^[A-Za-z]+:")
    ns = F.when((raw == "") & coded, F.lower(F.regexp_extract(whole, r"^([A-Za-z]+):", 1))).otherwise(raw)
    name = F.trim(F.when((raw == "") & coded, F.regexp_replace(whole, r"^[A-Za-z]+:", "")).otherwise(whole))
    tags = tables[t].select(F.col(tc["id"]).alias("_tag"), ns.alias("_ns"), name.alias("_name")).filter(F.col("_ns").isin(*CREATOR_NAMESPACES) & (F.col("_name") != ""))
    rows = tables[k].select(F.col(kc["tag"]).alias("_tag"), F.col(kc["gallery"]).cast("string").alias("gallery_id")).join(tags, "_tag")
    collect = lambda *which: first_spelling(F.array_sort(F.collect_set(F.when(F.col("_ns").isin(*which), F.col("_name")))))
    out = rows.groupBy("gallery_id").agg(collect("artist").alias("artists"), collect("group", "circle").alias("groups"))
    if "gallery" in tables:
        g = tables["gallery"]
        has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in g.columns else F.lit("")
        g = g.select(F.col("gid").cast("string").alias("gallery_id"), has("title").alias("title"), has("title_jpn").alias("title_jpn"), F.lower(has("expunged")).isin("1", "true").alias("_gone"))
        out = out.join(g, "gallery_id", "left").filter(~F.coalesce("_gone", F.lit(False))).drop("_gone")
    else:
        out = out.withColumn("title", F.lit("")).withColumn("title_jpn", F.lit(""))
    return out.select("gallery_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("title_jpn", F.lit("")).alias("title_jpn"), "artists", "groups")


def listing(spark: SparkSession, root: str, extensions: list[str], recursive: bool = True) -> DataFrame:
    """SRC6, SRC7: path, length, modified of files below root; contents are never read, and the extensions become a glob the listing applies."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(e.lstrip("*.").lower() for e in extensions) + "}")
    return reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"))


def manifest(tree: DataFrame, prefix: str, suffix: str, most: int = 64 << 20) -> DataFrame:
    """SRC8: files of a listed tree that may be fetched. tree: path, type, sha, size."""
    ok = F.startswith("path", F.lit(prefix)) & F.endswith("path", F.lit(suffix)) & (F.col("type") == "blob") & F.col("size").between(1, most) & F.lower("sha").rlike("^[0-9a-f]{40}$")
    return tree.filter(ok).select("path", F.lower("sha").alias("sha"), "size")


S, B, L = T.StringType(), T.BooleanType(), T.LongType()


def _list(*fields: tuple[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


LIBRARY = T.StructType(
    [
        T.StructField("authors", _list(("id", L), ("canonical_name", S), ("roman_name", S), ("source", S), ("external_id", S), ("entity_type", S), ("verified", B), ("user_confirmed", B), ("public_entity_key", S), ("provider_identities", T.ArrayType(S)))),
        T.StructField("aliases", _list(("author_id", L), ("alias", S), ("alias_type", S), ("source", S), ("disabled", B))),
        T.StructField("circles", _list(("id", L), ("canonical_name", S), ("roman_name", S), ("user_confirmed", B))),
        T.StructField("circle_aliases", _list(("circle_id", L), ("alias", S), ("alias_type", S), ("source", S), ("disabled", B))),
        T.StructField("author_circles", _list(("author_id", L), ("circle_id", L), ("source", S), ("user_confirmed", B), ("disabled", B))),
        T.StructField("name_decisions", _list(("name", S), ("entity_type", S), ("entity_id", L), ("status", S))),
        T.StructField("public_overrides", _list(("id", S), ("public_entity_key", S), ("database_version", S), ("original_public_id", L), ("entity_type", S), ("canonical_name", S), ("added_aliases", T.ArrayType(S)), ("disabled_names", T.ArrayType(S)), ("original_names", T.ArrayType(S)), ("user_groups", _list(("circle_id", L), ("group_id", L), ("name", S), ("user_confirmed", B), ("disabled", B))), ("status", S))),
        T.StructField("legacy_alias_groups", _list(("id", S), ("canonical", S), ("names", T.ArrayType(S)), ("author_id", L))),
        T.StructField("lookup_cache", _list(("provider", S), ("query", S), ("query_norm", S), ("status", S), ("author_id", L), ("checked_utc", S), ("detail", S))),
    ]
)


def broken_references(lists: dict[str, DataFrame]) -> DataFrame:
    """SRC9: list, id: rows of a library's lists that refer to an author or circle that isn't there; a library with any isn't saved."""
    authors, circles = (lists[n].select(F.col("id").alias("_id")) for n in ("authors", "circles"))
    of = (("aliases", "author_id", authors), ("circle_aliases", "circle_id", circles), ("author_circles", "author_id", authors), ("author_circles", "circle_id", circles))
    out = [lists[n].select(F.lit(n).alias("list"), F.col(c).alias("id")).join(to, F.col("id") == F.col("_id"), "left_anti") for n, c, to in of]
    return reduce(DataFrame.unionByName, out)


def library_faults(lists: dict[str, DataFrame]) -> DataFrame:
    """SRC9: list, fault, id: what forbids saving a library. id: an entry's id is missing, not positive, blank or there twice; null: an entry is null; reference: it
    refers to an author or circle that isn't there (decisions only where they are confirmed, alias groups only where they name an author); list: an
    override lacks one of its lists; name: an alias group has no canonical name, no list of names or a blank one."""
    authors, circles = (lists[n].filter("id > 0").select(F.col("id").alias("_id")).distinct() for n in ("authors", "circles"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    found = []

    def add(name: str, fault: str, rows: DataFrame, key) -> None:
        found.append(rows.select(F.lit(name).alias("list"), F.lit(fault).alias("fault"), key.cast("string").alias("id")))

    def references(name: str, rows: DataFrame, key: str, to: DataFrame) -> None:
        add(name, "reference", rows.filter("NOT absent").select(F.col(key).alias("id")).join(to, F.col("id") == F.col("_id"), "left_anti"), F.col("id"))

    # an entry that is null comes out as a row whose every field is null
    of = {n: rows.withColumn("absent", F.forall(F.array(*[F.col(c).isNull() for c in rows.columns]), lambda x: x)) for n, rows in lists.items()}
    for name in ("authors", "aliases", "circles", "circle_aliases", "author_circles", "name_decisions", "public_overrides", "legacy_alias_groups"):
        add(name, "null", of[name].filter("absent"), F.lit(None))
    for name, ids in (("authors", True), ("circles", True), ("public_overrides", False), ("legacy_alias_groups", False)):
        rows = of[name].filter("NOT absent")
        add(name, "id", rows.filter((F.coalesce(F.col("id"), F.lit(0)) <= 0) if ids else blank("id")), F.col("id"))
        add(name, "id", rows.groupBy("id").count().filter("count > 1"), F.col("id"))
    for name, key, to in (("aliases", "author_id", authors), ("circle_aliases", "circle_id", circles), ("author_circles", "author_id", authors), ("author_circles", "circle_id", circles)):
        references(name, of[name], key, to)
    confirmed = of["name_decisions"].filter("status = 'Confirmed'")
    references("name_decisions", confirmed.filter("entity_type = 'Artist'"), "entity_id", authors)
    references("name_decisions", confirmed.filter("entity_type IS DISTINCT FROM 'Artist'"), "entity_id", circles)
    over = of["public_overrides"].filter("NOT absent")
    add("public_overrides", "list", over.filter("added_aliases IS NULL OR disabled_names IS NULL OR original_names IS NULL OR user_groups IS NULL"), F.col("id"))
    own = over.select(F.explode("user_groups").alias("g"))
    references("public_overrides", own.select(F.col("g.circle_id").alias("circle_id"), F.lit(False).alias("absent")), "circle_id", circles)
    groups = of["legacy_alias_groups"].filter("NOT absent")
    add("legacy_alias_groups", "name", groups.filter(blank("canonical") | F.col("names").isNull() | F.exists("names", lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")), F.col("id"))
    references("legacy_alias_groups", groups.filter("author_id > 0"), "author_id", authors)
    return reduce(DataFrame.unionByName, found).distinct()


def library(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC9: a user library as a table for each of its lists."""
    whole = spark.read.schema(LIBRARY).option("multiLine", True).json(path)
    return {f.name: whole.select(F.explode(f.name).alias("r")).select("r.*") for f in LIBRARY.fields}


def legacy_aliases(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: line (numbered through the whole file), canonical, alias, position from "canonical|alias|..." lines; comments, and lines of one name, apart."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("v")).filter("v <> '' AND NOT startswith(v, '#')")
    return alias_groups(lines)


def prepared(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: lines of a source as text, whatever codec its name says (.gz and .zst are the readers' own); a database container is
    refused by its first bytes, since it has to be exported first."""
    head = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 15).alias("head"))
    if not head.filter(F.col("head") == F.encode(F.lit("SQLite format 3"), "utf-8")).isEmpty():
        raise ValueError(f"{path} is a database: export its tables first")
    return spark.read.text(path)


def filtered_listing(index: DataFrame, root: str, extensions: list[str], recursive: bool = True) -> DataFrame:
    """SRC7: rows of an index of files (directory, name, extension, ...) below root. Both conditions are plain comparisons of columns, so the index's reader gets them."""
    below = F.col("directory").startswith(root.rstrip("/") + "/")
    out = index.filter(((F.col("directory") == root.rstrip("/")) | below) if recursive else F.col("directory") == root.rstrip("/"))
    return out.filter(F.col("extension").isin([e.lstrip("*.").lower() for e in extensions])) if extensions else out


def alias_groups(lines: DataFrame) -> DataFrame:
    """SRC10 on lines (line, v)."""
    names = F.filter(F.transform(F.split("v", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(names, lambda x: normalize(x, compat=False))
    distinct = F.filter(names, lambda x, i: F.array_position(keys, F.element_at(keys, (i + 1).cast("int"))) == i + 1)
    return lines.select("line", distinct.alias("n")).filter("size(n) >= 2").select("line", F.element_at("n", 1).alias("canonical"), F.posexplode("n").alias("position", "alias"))


#: Headers after which lines are entries, and how an entry's time is written.
LOG_FORMATS, LOG_TIME = ("#GL3", "#GL4"), r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$"


def performance_log(lines: DataFrame, column: str = "value", most: int = 1000, file: str = "file", line: str = "line") -> DataFrame:
    """SRC12: file, line, time and a map of K=V of the last entries, most at most.  A line is an entry if the last header before it in its file (a line
    that starts with #GL) is one of LOG_FORMATS, and if it starts with a time; comments and the rest are skipped.  A key written twice keeps its
    last value.  lines: file and line number (a log is read in order), and column."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    header = F.when(F.startswith(text, F.lit("#GL")), text.isin(*LOG_FORMATS))
    w = Window.partitionBy(file).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.select(file, line, text.alias("_t"), F.last(header, ignorenulls=True).over(w).alias("_open")).filter(F.coalesce("_open", F.lit(False)) & ~F.startswith("_t", F.lit("#")))
    time = F.split_part(F.col("_t"), F.lit("|"), F.lit(1))
    rows = rows.filter(time.rlike(LOG_TIME) & F.try_to_timestamp(time, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")).isNotNull())
    pairs = F.filter(F.slice(F.split("_t", r"\|"), 2, 1 << 20), lambda p: F.instr(p, "=") > 1)
    last = F.reverse(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([^=]*)=", 1).alias("k"), F.regexp_replace(p, r"^[^=]*=", "").alias("v"))))
    keys = F.transform(last, lambda e: e["k"])
    once = F.filter(last, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    return rows.select(file, line, time.alias("time"), F.map_from_entries(once).alias("values")).orderBy(F.desc(file), F.desc(line)).limit(most)


def metric(values: str, key: str, kind: str = "bigint", default: int = 0) -> Column:
    """SRC12's typed getters."""
    return F.coalesce(F.expr(f"try_cast({values}['{key}'] AS {kind})"), F.lit(default))


def gallery_ids(html: Column, most: int = 25) -> Column:
    """SRC13: the first distinct (id, token) pairs in a page's links, as "id/token"."""
    found = F.regexp_extract_all(html, F.lit(r"/g/(\d+)/([0-9a-fA-F]+)"), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, "^/g/", "")))), 1, most)


