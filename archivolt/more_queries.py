"""More named queries: the merge as a whole, resolution stage by stage, names and rules, plans, snapshots, sources and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import grammar, naming, rules, text
from .operators import cdc, incremental, kb, providers, resolve, scoring
from .plans import planning, report
from .queries import DELTA_SQL, WORK_SQL, evidence, order_snapshots, query, statuses, STATUS_SQL, t, urls, URL_SQL, work_rows
from .sources import readers, versions, writers
from .streaming import changes, stateful


def folder(spark, name: str) -> str:
    return f"{writers.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- the merge

#: The statements of a merge, over orders as works, months of shipping as files (those of December, often a work's newest, aren't imported), return flags as sources
#: of three providers, suppliers as artists with a pretty name of full-width digits or none, brands as groups; and an aggregate of supplier names.
MERGE_SQL = f"""{WORK_SQL}, w2 AS (SELECT CASE source_id WHEN 'N' THEN 'nh-metadata-archive' WHEN 'A' THEN 'eh-current' ELSE 'csv-r' END AS source_id, gallery_id, source_file, l_suppkey, p_brand FROM w),
             files AS (SELECT DISTINCT source_id, source_file, CASE WHEN source_file LIKE '%-12' THEN 'pending' ELSE 'imported' END AS state FROM w2 UNION ALL SELECT 'eh-tag-aggregate', 'tags', 'imported' UNION ALL SELECT 'gone-source', 'x', 'withdrawn'),
             ev AS (SELECT w2.source_id, source_file, gallery_id, 'Artist' AS kind, s_name AS name, lower(s_name) AS norm,
                           CASE WHEN s_suppkey % 3 = 0 THEN translate(s_name, '0123456789', '０１２３４５６７８９') || chr(12288) || '改' ELSE '' END AS pretty, CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) || ' 改' ELSE '' END AS pretty_norm
                    FROM w2 JOIN supplier ON s_suppkey = l_suppkey
                    UNION ALL SELECT source_id, source_file, gallery_id, 'Group', p_brand, lower(p_brand), '', '' FROM w2
                    UNION ALL SELECT 'eh-tag-aggregate', 'tags', -s_suppkey, 'Artist', upper(s_name), lower(s_name), '', '' FROM supplier WHERE s_suppkey % 5 = 0
                    UNION ALL SELECT source_id, source_file, gallery_id, 'Parody', 'x', 'x', '', '' FROM w2),
             sources AS (SELECT row_number() OVER (ORDER BY source_id) AS id, source_id AS source_key FROM (SELECT DISTINCT source_id FROM files WHERE state = 'imported')),
             incoming AS (SELECT e.source_id, e.kind, e.norm,
                                 CASE WHEN e.source_id = 'nh-metadata-archive' THEN 'nHentai' WHEN e.source_id IN ('eh-current', 'eh-tag-aggregate') THEN 'E-Hentai' ELSE 'Archive:' || e.source_id END AS provider,
                                 CASE WHEN e.source_id = 'nh-metadata-archive' THEN 'nhentai:' WHEN e.source_id IN ('eh-current', 'eh-tag-aggregate') THEN 'ehentai:' ELSE 'archive:' || e.source_id || ':' END || lower(e.kind) || ':' || e.norm AS external_key,
                                 min(e.name) AS name, min(coalesce(nullif(e.pretty, ''), e.name)) AS pretty, min(coalesce(nullif(e.pretty_norm, ''), e.norm)) AS pretty_norm, count(DISTINCT e.gallery_id) AS works
                          FROM ev e JOIN files f ON f.source_id = e.source_id AND f.source_file = e.source_file
                               LEFT JOIN (SELECT w2.source_id, gallery_id, max(w2.source_file) AS newest FROM w2 JOIN files f2 ON f2.source_id = w2.source_id AND f2.source_file = w2.source_file WHERE f2.state = 'imported' GROUP BY 1, 2) m
                                 ON m.source_id = e.source_id AND m.gallery_id = e.gallery_id
                          WHERE f.state = 'imported' AND e.kind IN ('Artist', 'Group') AND length(e.norm) BETWEEN 1 AND 300 AND (e.source_id = 'eh-tag-aggregate' OR e.source_file = m.newest) GROUP BY 1, 2, 3, 4, 5),
             base_identity AS (SELECT 'E-Hentai' AS provider, lower(s_name) AS norm, s_suppkey AS id FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'Other', lower(s_name), s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 8 = 0),
             base_entity AS (SELECT s_suppkey AS id, 'Artist' AS kind, lower(s_name) AS norm, s_name AS canonical_name, '' AS external_id FROM supplier WHERE s_suppkey % 4 = 0
                             UNION ALL SELECT s_suppkey + 1000000, 'Artist', lower(s_name), s_name, '' FROM supplier WHERE s_suppkey % 8 = 0
                             UNION ALL SELECT s_suppkey + 2000000, 'Artist', lower(s_name), s_name, 'nhentai:artist:' || lower(s_name) FROM supplier WHERE s_suppkey % 6 = 1),
             one AS (SELECT i.*, b.id AS own, b.id IS NULL AND coalesce(h.holders, 0) > 1 AS conflict FROM incoming i LEFT JOIN base_identity b ON i.kind = 'Artist' AND b.provider = i.provider AND b.norm = i.norm
                       LEFT JOIN (SELECT norm, count(DISTINCT id) AS holders FROM base_identity GROUP BY 1) h ON i.kind = 'Artist' AND h.norm = i.norm),
             two AS (SELECT one.* EXCLUDE (own), coalesce(own, CASE WHEN NOT conflict THEN x.id END) AS id FROM one LEFT JOIN base_entity x ON x.external_id = one.external_key AND x.kind = one.kind),
             fresh AS (SELECT row_number() OVER (ORDER BY source_id, kind, norm) + (SELECT max(id) FROM base_entity) AS id, * EXCLUDE (id) FROM two WHERE id IS NULL AND NOT conflict
                         AND NOT EXISTS (SELECT 1 FROM two o WHERE o.provider = two.provider AND o.kind = two.kind AND o.norm = two.norm AND o.source_id < two.source_id AND NOT o.conflict AND o.id IS NULL)),
             p AS (SELECT two.* EXCLUDE (id), coalesce(two.id, CASE WHEN NOT two.conflict THEN fresh.id END) AS id FROM two LEFT JOIN fresh ON fresh.external_key = two.external_key AND fresh.kind = two.kind),
             nh AS (SELECT id, kind, min(name) AS tag FROM p WHERE provider = 'nHentai' AND id IS NOT NULL AND NOT conflict GROUP BY 1, 2),
             every_entity AS (SELECT id, kind, norm, canonical_name, external_id, '' AS eh_artist_tag, '' AS nh_artist_tag, '' AS nh_group_tag, '' AS eh_namespace, '' AS eh_tag, 'Unverified' AS verification_source, CAST(NULL AS BIGINT) AS source_id FROM base_entity
                         UNION ALL SELECT f.id, f.kind, f.pretty_norm, f.pretty, f.external_key, CASE WHEN f.kind = 'Artist' AND provider = 'E-Hentai' THEN name ELSE '' END, CASE WHEN f.kind = 'Artist' AND provider = 'nHentai' THEN name ELSE '' END,
                                CASE WHEN f.kind = 'Group' AND provider = 'nHentai' THEN name ELSE '' END, CASE WHEN provider = 'E-Hentai' THEN lower(f.kind) ELSE '' END, CASE WHEN provider = 'E-Hentai' THEN name ELSE '' END,
                                CASE WHEN provider = 'E-Hentai' THEN 'OfflineDatabase' ELSE 'Unverified' END, s.id FROM fresh f JOIN sources s ON s.source_key = f.source_id),
             entities AS (SELECT e.* REPLACE (CASE WHEN e.kind = 'Artist' AND e.nh_artist_tag = '' THEN coalesce(nh.tag, '') ELSE e.nh_artist_tag END AS nh_artist_tag,
                                              CASE WHEN e.kind = 'Group' AND e.nh_group_tag = '' THEN coalesce(nh.tag, '') ELSE e.nh_group_tag END AS nh_group_tag) FROM every_entity e LEFT JOIN nh ON nh.id = e.id AND nh.kind = e.kind),
             own AS (SELECT provider, kind, p.norm, min_by(p.id, p.source_id) AS id, min_by(name, p.source_id) AS tag, max(works) AS works, min_by(s.id, p.source_id) AS source_id FROM p JOIN sources s ON s.source_key = p.source_id WHERE p.id IS NOT NULL AND NOT conflict GROUP BY 1, 2, 3),
             identities AS (SELECT coalesce(b.provider, own.provider) AS provider, coalesce(own.kind, 'Artist') AS kind, coalesce(b.norm, own.norm) AS norm, coalesce(b.id, own.id) AS entity_id, CASE WHEN b.id IS NULL THEN own.tag ELSE '' END AS tag,
                                   coalesce(own.works, 0) AS works, CASE WHEN b.id IS NULL THEN own.source_id END AS source_id FROM base_identity b FULL JOIN own ON own.kind = 'Artist' AND own.provider = b.provider AND own.norm = b.norm),
             named AS (SELECT id, norm, name AS alias, 'provider_tag' AS alias_type, 0 AS rank, source_id FROM p WHERE id IS NOT NULL AND NOT conflict UNION ALL SELECT id, pretty_norm, pretty, 'roman', 1, source_id FROM p WHERE id IS NOT NULL AND NOT conflict),
             aliases AS (SELECT entity_id, norm, alias, alias_type, s.id AS source_id FROM (SELECT id AS entity_id, norm, alias, alias_type, source_id AS key, row_number() OVER (PARTITION BY id, norm ORDER BY rank, source_id, alias) AS n FROM named) JOIN sources s ON s.source_key = key WHERE n = 1),
             newest AS (SELECT w2.source_id, gallery_id, max(w2.source_file) AS source_file FROM w2 JOIN files f2 ON f2.source_id = w2.source_id AND f2.source_file = w2.source_file WHERE f2.state = 'imported' GROUP BY 1, 2),
             known AS MATERIALIZED (SELECT DISTINCT source_id, kind, norm, id FROM p WHERE id IS NOT NULL AND NOT conflict),
             side AS MATERIALIZED (SELECT DISTINCT e.source_id, e.gallery_id, e.kind, k.id FROM ev e JOIN newest n ON n.source_id = e.source_id AND n.gallery_id = e.gallery_id AND n.source_file = e.source_file
                                   JOIN known k ON k.source_id = e.source_id AND k.kind = e.kind AND k.norm = e.norm WHERE e.source_id <> 'eh-tag-aggregate'),
             ws AS (SELECT a.source_id, a.id AS artist_id, g.id AS group_id, count(DISTINCT a.gallery_id) AS weight FROM side a JOIN side g ON a.source_id = g.source_id AND a.gallery_id = g.gallery_id
                    WHERE a.kind = 'Artist' AND g.kind = 'Group' AND a.id <> g.id GROUP BY 1, 2, 3),
             relations AS (SELECT artist_id, group_id, max(weight) AS weight FROM ws GROUP BY 1, 2)"""


def merge_input(spark, d) -> tuple[kb.Kb, DataFrame, DataFrame, DataFrame]:
    """A base of identities and entities, evidence, works, and files of which those of December aren't imported."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", F.lower("s_name").alias("norm"))
    key = F.col("l_suppkey")
    kept = ((key % 4 == 0, 0, F.lit("")), (key % 8 == 0, 1_000_000, F.lit("")), (key % 6 == 1, 2_000_000, F.concat(F.lit("nhentai:artist:"), "norm")))
    entity = reduce(DataFrame.unionByName, [s.filter(which).select((key + add).alias("id"), F.col("s_name").alias("canonical_name"), F.lit("").alias("roman_name"), "norm", F.lit("Artist").alias("kind"), external.alias("external_id"), F.lit(False).alias("verified")) for which, add, external in kept])
    identity = reduce(DataFrame.unionByName, [s.filter(which).select(F.lit(provider).alias("provider"), F.lit("Artist").alias("kind"), "norm", (key + add).alias("entity_id"), F.lit("").alias("tag"), F.lit(0).cast("long").alias("works")) for (which, add, _), provider in zip(kept[:2], ("E-Hentai", "Other"), strict=True)])
    empty = lambda schema: spark.createDataFrame([], schema)
    base = kb.Kb(entity, identity, empty("entity_id long, norm string, alias string, alias_type string"), empty("artist_id long, group_id long, weight long"))
    w = work_rows(spark, d).withColumn("source_id", F.when(F.col("source_id") == "N", "nh-metadata-archive").when(F.col("source_id") == "A", "eh-current").otherwise("csv-r")).drop("l_partkey").join(s.drop("norm"), "l_suppkey")
    pretty = F.when(key % 3 == 0, F.concat(F.translate("s_name", "0123456789", "０１２３４５６７８９"), F.lit("　改"))).otherwise("")
    row = lambda rows, kind, name, pretty=F.lit(""): rows.select("source_id", "source_file", "gallery_id", F.lit(kind).alias("entity_type"), name.alias("name"), F.lower(name).alias("normalized_name"), pretty.alias("pretty_name"))
    tags = s.filter(key % 5 == 0).select(F.lit(kb.AGGREGATE).alias("source_id"), F.lit("tags").alias("source_file"), (-key).alias("gallery_id"), "s_name")
    e = reduce(DataFrame.unionByName, [row(w, "Artist", F.col("s_name"), pretty), row(w, "Group", F.col("p_brand")), row(tags, "Artist", F.upper("s_name")), row(w, "Parody", F.lit("x"))])
    files = w.select("source_id", F.col("source_file").alias("path")).distinct().withColumn("state", F.when(F.endswith("path", F.lit("-12")), "pending").otherwise("imported"))
    files = files.unionByName(spark.createDataFrame([(kb.AGGREGATE, "tags", "imported"), ("gone-source", "x", "withdrawn")], "source_id string, path string, state string"))
    return base, e, w.select("source_id", "gallery_id", "source_file"), files


def merged(spark, d) -> kb.Kb:
    return kb.merge(*merge_input(spark, d))


@query(f"WITH {MERGE_SQL} SELECT * FROM entities")
def merge_entities(spark, d):
    """Entities after the merge, the new ones numbered in order, called by their pretty names, with their providers' tags."""
    return merged(spark, d).entity.drop("roman_name", "verified")


@query(f"WITH {MERGE_SQL} SELECT * FROM identities")
def merge_identities(spark, d):
    """M10."""
    return merged(spark, d).identity


@query(f"WITH {MERGE_SQL} SELECT * FROM aliases")
def merge_aliases(spark, d):
    """M11."""
    return merged(spark, d).alias


@query(f"WITH {MERGE_SQL} SELECT * FROM relations")
def merge_relations(spark, d):
    """Pairs of resolved artists and groups."""
    return merged(spark, d).relation


@query(f"WITH {MERGE_SQL} SELECT * FROM ws")
def merge_relation_sources(spark, d):
    """By source."""
    return merged(spark, d).relation_source.select("source_id", "artist_id", "group_id", "weight")


@query(f"WITH {MERGE_SQL} SELECT * FROM sources")
def merge_registered(spark, d):
    """M1: sources of imported files, registered by the merge."""
    return merged(spark, d).source


@query(f"""WITH {MERGE_SQL}, apart AS (SELECT kind, norm FROM p WHERE id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT id) > 1)
           SELECT p.source_id, p.kind, p.norm, p.name, 'Cross-source identity ambiguity' AS reason, p.works FROM p JOIN apart ON apart.kind = p.kind AND apart.norm = p.norm WHERE p.id IS NOT NULL
           UNION ALL SELECT source_id, kind, norm, name, 'Multiple provider identities', works FROM p WHERE conflict""")
def merge_conflicts(spark, d):
    """M8 M9."""
    return merged(spark, d).conflict


COUNTS = ("entities", "identities", "aliases", "relations")


@query(f"WITH {MERGE_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS first, count(*) AS again FROM {n}" for n in COUNTS))
def merge_again(spark, d):
    """Merging the same evidence into the result adds nothing."""
    base, *rest, files = merge_input(spark, d)
    rest.append(writers.settled(files))
    one = kb.merge(base, *rest)
    one = kb.Kb(*[writers.settled(x) for x in (one.entity, one.identity, one.alias, one.relation)])
    two = kb.merge(one, *rest)
    counts = [a.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("first")).join(b.agg(F.count(F.lit(1)).alias("again")), F.lit(True)) for n, a, b in zip(COUNTS, (one.entity, one.identity, one.alias, one.relation), (two.entity, two.identity, two.alias, two.relation), strict=True)]
    return reduce(DataFrame.unionByName, counts)


@query("""WITH n AS (SELECT DISTINCT event_type AS k FROM events WHERE event_type <> 'error' AND event_type <> 'click')
          SELECT 1 AS id, 'click' AS source_key UNION ALL SELECT 7, 'gone' UNION ALL SELECT 7 + row_number() OVER (ORDER BY k), k FROM n""")
def merge_sources(spark, d):
    """M1: sources of imported files that aren't registered yet."""
    known = spark.createDataFrame([(1, "click"), (7, "gone")], "id long, source_key string")
    files = t(spark, d, "events").select(F.col("event_type").alias("source_id"), F.when(F.col("event_type") == "error", "failed").otherwise("imported").alias("state"))
    return kb.registered(known, files)


@query("""WITH n AS (SELECT c_nationkey AS id, min(c_name) AS tag FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
          SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN n_name ELSE coalesce(tag, '') END AS tag FROM nation LEFT JOIN n ON n.id = n_nationkey""")
def merge_fill_tags(spark, d):
    """Empty tags take the smallest name."""
    entity = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 1, F.col("n_name")).otherwise("").alias("tag"))
    names = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"))
    return kb.filled_tags(entity, names, "tag")


@query("""WITH k AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 12 THEN 'Artist' ELSE 'Group' END AS kind FROM customer), r AS (SELECT DISTINCT o_custkey AS artist_id, (o_custkey * 7 + o_orderkey) % 1600 AS group_id FROM orders)
          SELECT r.artist_id, r.group_id FROM r LEFT JOIN k a ON a.id = r.artist_id LEFT JOIN k g ON g.id = r.group_id
          WHERE a.kind IS DISTINCT FROM 'Artist' OR g.kind IS DISTINCT FROM 'Group' OR r.artist_id = r.group_id""")
def merge_wrong_relations(spark, d):
    """M16."""
    entity = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") < 12, "Artist").otherwise("Group").alias("kind"))
    relation = t(spark, d, "orders").select(F.col("o_custkey").alias("artist_id"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1600).alias("group_id")).distinct()
    return kb.wrong_relations(kb.Kb(entity, entity, entity, relation))


@query(f"""WITH {WORK_SQL}, f AS (SELECT max(source_file) AS f FROM w), k AS (SELECT * FROM w, f WHERE NOT (source_id = 'N' AND source_file = f)),
           r AS (SELECT source_id, source_file FROM k UNION ALL SELECT 'N', f FROM f) SELECT source_id, source_file, count(*) AS "rows" FROM r GROUP BY 1, 2""")
def merge_replace_file(spark, d):
    """A file's rows are replaced as a whole."""
    e, w = evidence(spark, d)
    w = w.select("source_id", "gallery_id", "source_file")
    last = w.agg(F.max("source_file")).first()[0]
    new = spark.createDataFrame([("N", 0, last)], w.schema)
    return kb.replace_file(w, new, "N", last).groupBy("source_id", "source_file").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH w AS (SELECT l_returnflag AS s, CAST(l_orderkey AS VARCHAR) AS g, strftime(l_shipdate, '%Y') AS f, l_suppkey, p_brand, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey),
               k AS (SELECT * FROM w WHERE NOT (s = 'N' AND f = '1997') AND NOT (s = 'A' AND f = '1996' AND l_orderkey % 2 = 1)), n AS (SELECT s, g, max(f) AS f FROM k GROUP BY 1, 2), c AS (SELECT k.* FROM k JOIN n USING (s, g, f))
          SELECT a.s AS source_id, CAST(a.l_suppkey AS VARCHAR) AS artist, b.p_brand AS "group", count(DISTINCT a.g) AS weight FROM c a JOIN c b ON a.s = b.s AND a.g = b.g GROUP BY 1, 2, 3""")
def merge_incremental(spark, d):
    """Years of shipping as files that come, go and are replaced; only the works of the changed ones are paired again."""
    rows = work_rows(spark, d).withColumn("source_file", F.substring("source_file", 1, 4)).withColumn("gallery_id", F.col("gallery_id").cast("string"))
    both = F.array(F.struct(F.lit("Artist").alias("kind"), F.col("l_suppkey").cast("string").alias("norm")), F.struct(F.lit("Group").alias("kind"), F.col("p_brand").alias("norm")))
    e = rows.select("source_id", "source_file", "gallery_id", F.explode(both).alias("n")).select("source_id", "source_file", "gallery_id", "n.*").distinct()
    store = incremental.PairStore(spark, folder(spark, "pairs"))
    last = F.col("source_file") == "1998"
    store.change(e.filter(~last))
    store.change(e.filter(last), [("N", "1997")])
    store.change(e.filter((F.col("source_id") == "A") & (F.col("source_file") == "1996") & (F.col("gallery_id").cast("long") % 2 == 0)))
    store.change(withdrawn=[("nobody", "1990")])
    return store.by_source()


@query("""SELECT 1 AS version, c_mktsegment AS segment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total FROM customer WHERE c_custkey % 2 = 0 GROUP BY 2
          UNION ALL SELECT 2, c_mktsegment, count(*), CAST(sum(CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_nationkey END) AS BIGINT) FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 GROUP BY 2
          UNION ALL SELECT 3, c_mktsegment, count(*), CAST(sum(CASE WHEN c_custkey % 5 = 0 THEN -2 WHEN c_custkey % 3 = 0 THEN -1 ELSE c_nationkey END) AS BIGINT) FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 GROUP BY 2""")
def published_versions(spark, d):
    """SNK2 SNK3 J14: two writers upsert into one base; the second is refused, and applies its rows to what the first has published. Readers of each version see what it was."""
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    mark = lambda k, v: c.filter(F.col("c_custkey") % k == 0).withColumn("c_nationkey", F.lit(v))
    table = versions.Versions(spark, folder(spark, "published"))
    one = table.publish(c.filter("c_custkey % 2 = 0"), 0)
    pinned = table.table(one)
    two = table.publish(writers.upsert(table.table(one), mark(3, -1), ["c_custkey"]), one)
    try:
        table.publish(writers.upsert(table.table(one), mark(5, -2), ["c_custkey"]), one)
        raise RuntimeError("two writers made the same version")
    except versions.Conflict:
        table.publish(writers.upsert(table.table(two), mark(5, -2), ["c_custkey"]), two)
    seen = [pinned, table.table(two), table.table()]
    return reduce(DataFrame.unionByName, [x.groupBy(F.lit(i + 1).alias("version"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_nationkey").cast("long").alias("total")) for i, x in enumerate(seen)])


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'Matched' ELSE 'Unresolved' END AS status, CASE WHEN o_custkey % 3 = 0 THEN 'k' || (o_custkey % 700) ELSE '' END AS entity_key FROM orders""")
def merge_revalidate(spark, d):
    """Each distinct name is resolved once, and evidence takes the answer."""
    o = t(spark, d, "orders")
    e = o.select("o_orderkey", F.lit("Artist").alias("entity_type"), (F.col("o_custkey") % 2100).cast("string").alias("normalized_name"), F.concat(F.lit("n"), F.col("o_custkey") % 2100).alias("name"), F.lit("old").alias("status"), F.lit("old").alias("entity_key"))
    n = e.select("entity_type", "normalized_name", "name").distinct().filter("normalized_name % 3 = 0")
    found = n.withColumn("status", F.lit("Matched")).withColumn("entity_key", F.concat(F.lit("k"), F.col("normalized_name").cast("long") % 700))
    return kb.revalidated(e, found).select("o_orderkey", "status", "entity_key")


@query("""WITH l AS (SELECT c_custkey AS id, c_mktsegment AS provider, CAST(c_custkey // 2 AS VARCHAR) AS ext, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS cn, c_custkey % 5 = 0 AS ok FROM customer),
               n AS (SELECT provider, ext FROM l GROUP BY 1, 2 HAVING count(*) = 1), r AS (SELECT 'BUILDING' AS provider, CAST(s_suppkey AS VARCHAR) AS ext, s_name FROM supplier)
          SELECT l.id, CASE WHEN l.ok OR n.ext IS NULL OR l.cn <> '' THEN l.cn ELSE coalesce(r.s_name, '') END AS canonical_name FROM l LEFT JOIN n ON n.provider = l.provider AND n.ext = l.ext LEFT JOIN r ON r.provider = l.provider AND r.ext = l.ext""")
def merge_provider_results(spark, d):
    """Blanks are filled where exactly one entry has the provider's key and no person confirmed it."""
    c = t(spark, d, "customer")
    library = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("provider"), F.floor(F.col("c_custkey") / 2).cast("string").alias("external_id"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("canonical_name"), F.lit("").alias("roman_name"), (F.col("c_custkey") % 5 == 0).alias("user_confirmed"))
    results = t(spark, d, "supplier").select(F.lit("BUILDING").alias("provider"), F.col("s_suppkey").cast("string").alias("external_id"), F.col("s_name").alias("canonical_name"), F.lit("").alias("roman_name"))
    return kb.provider_results(library, results).select("id", "canonical_name")


@query("""WITH r AS (SELECT o_custkey * 2 AS ext, min(o_orderkey) AS seq FROM orders GROUP BY 1), m AS (SELECT max(c_custkey) AS top FROM customer),
               n AS (SELECT ext, row_number() OVER (ORDER BY seq) + top AS id FROM r, m WHERE ext > top)
          SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN r.ext IS NULL OR c_custkey % 5 = 0 THEN '' ELSE 'T ' || ext END ELSE c_name END AS canonical_name, CASE WHEN r.ext IS NULL OR c_custkey % 5 = 0 THEN '' ELSE 'T_' || ext END AS eh_artist_tag,
                 CAST(c_custkey AS VARCHAR) AS external_id FROM customer LEFT JOIN r ON r.ext = c_custkey UNION ALL SELECT id, 'T ' || ext, 'T_' || ext, CAST(ext AS VARCHAR) FROM n""")
def provider_merge(spark, d):
    """Results find the one author of their id, or make it once; confirmed ones stay."""
    c, o, k = t(spark, d, "customer"), t(spark, d, "orders"), F.col("c_custkey")
    text_, none = F.lit(""), F.array().cast("array<string>")
    authors = c.select(k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("canonical_name"), text_.alias("roman_name"), text_.alias("eh_artist_tag"), text_.alias("nh_artist_tag"), F.lit("E-Hentai").alias("source"), k.cast("string").alias("external_id"), F.lit("Artist").alias("entity_type"), text_.alias("verification_source"), F.lit("artist").alias("eh_namespace"), text_.alias("eh_tag"), F.lit(False).alias("verified"), (k % 5 == 0).alias("user_confirmed"))
    empty = lambda schema: spark.createDataFrame([], schema)
    library = providers.Library(authors, empty("author_id long, alias string, alias_type string, source string"), empty("id long, canonical_name string, eh_group_tag string, nh_group_tag string, source string"), empty("author_id long, circle_id long, source string"), empty("provider string, query string, query_norm string, status string, author_id long, checked_utc string, detail string"))
    ext = (F.col("o_custkey") * 2).cast("string")
    results = o.select(F.col("o_orderkey").alias("seq"), F.lit("E-Hentai").alias("provider"), text_.alias("query"), ext.alias("external_id"), F.concat(F.lit("T_"), ext).alias("tag"), F.lit("artist").alias("namespace"), F.lit("Artist").alias("entity_type"), F.array(F.lit("E-Hentai/Tag")).alias("evidence"), none.alias("other_names"), text_.alias("group_name"), F.lit("now").alias("checked_utc"))
    return providers.merged(library, results).authors.select("id", "canonical_name", "eh_artist_tag", "external_id")


# --- joins


@query("SELECT c_custkey, coalesce(n_name, '') AS n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2")
def dimension_join(spark, d):
    """J1."""
    return kb.with_dimension(t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "nation").filter("n_regionkey <> 2"), "c_nationkey", "n_nationkey", "n_name").select("c_custkey", "n_name")


@query("""SELECT l_returnflag AS source_id, strftime(l_shipdate, '%Y-%m') AS source_file, count(*) AS n FROM lineitem WHERE strftime(l_shipdate, '%m') <> '12' GROUP BY 1, 2""")
def imported_evidence(spark, d):
    """J2."""
    e, w = evidence(spark, d)
    files = w.select("source_id", F.col("source_file").alias("path")).distinct().withColumn("state", F.when(F.endswith("path", F.lit("-12")), "pending").otherwise("imported"))
    return kb.imported_evidence(e.filter("entity_type = 'Artist'"), files).groupBy("source_id", "source_file").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey AS gallery_id, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS japanese_title, l_linestatus AS status, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
          ORDER BY CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END, strftime(l_shipdate, '%Y-%m-%d') DESC, l_returnflag, gallery_id, l_linenumber, l_suppkey LIMIT 200""")
def evidence_sample(spark, d):
    """The limit is the feature."""
    li = t(spark, d, "lineitem")
    e = li.select(F.col("l_returnflag").alias("source_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("source_file"), F.col("l_orderkey").alias("gallery_id"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("normalized_name"), "l_suppkey")
    works = e.select("source_id", "source_file", "gallery_id").distinct().join(t(spark, d, "orders").filter("o_orderkey % 4 <> 0"), F.col("o_orderkey") == F.col("gallery_id"))
    works = works.select("source_id", "source_file", "gallery_id", F.col("o_orderpriority").alias("japanese_title"), F.lit("").alias("english_title"))
    return kb.evidence_sample(e, works, ["O", "F"], 200).select("gallery_id", "japanese_title", "status", "l_suppkey")


@query("""WITH m AS (SELECT l_suppkey, min(l_returnflag) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber FROM lineitem JOIN m ON m.l_suppkey = lineitem.l_suppkey AND f = l_returnflag""")
def smallest_source(spark, d):
    """J9."""
    return kb.smallest_source(t(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0")
def replaced_rows(spark, d):
    """J14."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return writers.upsert(o.filter("id % 2 = 0").withColumn("v", F.lit("old")), o.filter("id % 3 = 0").withColumn("v", F.lit("new")), ["id"])


ROLES_SQL = """q AS (SELECT o_orderkey AS id, CAST(c_nationkey AS VARCHAR) AS society, CAST(o_custkey % 40 AS VARCHAR) AS creator FROM orders JOIN customer ON c_custkey = o_custkey),
               r AS (SELECT s_suppkey AS folder, CAST(s_nationkey AS VARCHAR) AS society, CAST(s_suppkey % 40 AS VARCHAR) AS creator FROM supplier)"""


def role_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    """Names by role (1 society, 2 creator): of orders, and of folders."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    name = lambda role, c: F.struct(F.lit(role).alias("role"), c.cast("string").alias("norm"))
    both = lambda rows, key, society, creator: rows.select(key, F.explode(F.array(name(1, F.col(society)), name(2, creator))).alias("r")).select(key, "r.*")
    q = both(o.withColumnRenamed("o_orderkey", "id"), "id", "c_nationkey", F.col("o_custkey") % 40)
    s = t(spark, d, "supplier").withColumnRenamed("s_suppkey", "folder")
    return q, both(s, "folder", "s_nationkey", F.col("folder") % 40)


@query(f"WITH {ROLES_SQL}, j AS (SELECT id, folder FROM q JOIN r ON q.society = r.society UNION SELECT id, folder FROM q JOIN r ON q.creator = r.creator) SELECT id, count(*) AS folders, min(folder) AS first FROM j GROUP BY 1")
def role_join(spark, d):
    """A society meets societies and a creator creators."""
    q, r = role_rows(spark, d)
    return resolve.reached(q, r, "id", "folder", ["role", "norm"]).select("id", F.col("targets").alias("folders"), F.col("folder").alias("first"))


@query(f"""WITH {ROLES_SQL}, s AS (SELECT DISTINCT id, folder FROM q JOIN r ON q.society = r.society), c AS (SELECT DISTINCT id, folder FROM q JOIN r ON q.creator = r.creator),
               both_ AS (SELECT s.id, s.folder FROM s JOIN c ON s.id = c.id AND s.folder = c.folder), one AS (SELECT * FROM s UNION SELECT * FROM c), h AS (SELECT * FROM both_ UNION ALL SELECT * FROM one WHERE id NOT IN (SELECT id FROM both_)),
               flat AS (SELECT DISTINCT q.id, 1000000 + r.folder AS folder FROM q JOIN r ON q.society || ' ' || q.creator = r.society || ' ' || r.creator WHERE r.folder % 5 = 0),
               l AS (SELECT id, 1 AS stage, folder FROM flat UNION ALL SELECT id, 2, folder FROM h), m AS (SELECT id, min(stage) AS stage FROM l GROUP BY 1)
          SELECT l.id, l.stage, CASE WHEN count(DISTINCT folder) = 1 THEN 'Matched' WHEN l.stage = 1 THEN 'Ambiguous' ELSE 'Choice' END AS status, CASE WHEN count(DISTINCT folder) = 1 THEN min(folder) END AS folder, count(DISTINCT folder) AS targets
          FROM l JOIN m ON l.id = m.id AND l.stage = m.stage GROUP BY 1, 2""")
def resolve_structured_stages(spark, d):
    """E3 E4: "society creator" as one name first, then what either side or both lead to."""
    q, r = role_rows(spark, d)
    side = lambda rows, role: rows.filter(F.col("role") == role).drop("role")
    flat = lambda rows, key: side(rows, 1).withColumnRenamed("norm", "s").join(side(rows, 2).withColumnRenamed("norm", "c"), key).select(key, F.concat_ws(" ", "s", "c").alias("norm"))
    asked, sets = resolve.alike(q, "id", ["role", "norm"])
    owners, held = resolve.alike(r, "folder", ["role", "norm"])
    one = resolve.reached(flat(sets, "id"), flat(r.filter("folder % 5 = 0"), "folder"), "id", "folder").withColumn("folder", F.col("folder") + 1_000_000)
    hits = [resolve.norm_join(side(sets, k), side(held, k), "id", "folder") for k in (1, 2)]
    two = resolve.counted(resolve.structured_hits(*hits, "id", "folder"), owners, "id", "folder")
    return resolve.of_members(resolve.first_stage([(one, "Ambiguous"), (two, "Choice")], "id", "folder"), asked, "id")


@query("""WITH k AS (SELECT c_custkey AS id, c_custkey % 90 AS entity FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT s_suppkey % 90 AS entity, lower(s_name) AS norm FROM supplier),
               f AS (SELECT s_suppkey AS folder, lower(s_name) AS norm FROM supplier WHERE s_suppkey % 3 = 0), one AS (SELECT DISTINCT k.id, folder FROM k JOIN n ON n.entity = k.entity JOIN f ON f.norm = n.norm),
               c AS (SELECT DISTINCT c_custkey AS id, s_suppkey + 1000 AS folder FROM customer JOIN supplier ON replace(lower(c_name), 'customer', '') = replace(lower(s_name), 'supplier', '')),
               l AS (SELECT id, 1 AS stage, folder FROM one UNION ALL SELECT id, 2, folder FROM c), m AS (SELECT id, min(stage) AS stage FROM l GROUP BY 1)
          SELECT l.id, l.stage, CASE WHEN count(DISTINCT folder) = 1 THEN 'Matched' ELSE 'Choice' END AS status, CASE WHEN count(DISTINCT folder) = 1 THEN min(folder) END AS folder, count(DISTINCT folder) AS targets
          FROM l JOIN m ON l.id = m.id AND l.stage = m.stage GROUP BY 1, 2""")
def resolve_entity_then_cautious(spark, d):
    """Folders by the names of the entity that the knowledge base knows; then by cautious forms."""
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    known = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 90).alias("entity"))
    names = s.select((F.col("s_suppkey") % 90).alias("entity"), F.lower("s_name").alias("norm"))
    folders = s.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("folder"), F.lower("s_name").alias("norm"))
    one = resolve.reached(known, resolve.norm_join(names, folders, "entity", "folder"), "id", "folder", ["entity"])
    cautious = lambda name, word, left, right: text.normalize_cautious(F.concat(F.lit(left), F.replace(F.lower(name), F.lit(word), F.lit("x・")), F.lit(right)), compat=False)
    two = resolve.reached(c.select(F.col("c_custkey").alias("id"), cautious("c_name", "customer", "「", "」").alias("norm")), s.select((F.col("s_suppkey") + 1000).alias("folder"), cautious("s_name", "supplier", "", ".").alias("norm")), "id", "folder")
    return resolve.first_stage([(one, "Choice"), (two, "Choice")], "id", "folder")


@query("""WITH g AS (SELECT p_partkey AS id, replace(p_brand, '#', '') AS name FROM part), n AS (SELECT DISTINCT name FROM g),
               a AS (SELECT id, name, unnest(list_distinct(list_transform(range(1, length(replace(name, ' ', ''))), lambda i: substr(replace(name, ' ', ''), CAST(i AS BIGINT), 2)))) AS gram FROM g),
               b AS (SELECT name AS folder, unnest(list_distinct(list_transform(range(1, length(replace(name, ' ', ''))), lambda i: substr(replace(name, ' ', ''), CAST(i AS BIGINT), 2)))) AS gram FROM n),
               h AS (SELECT id, folder, count(*) AS hits FROM a JOIN b ON a.gram = b.gram GROUP BY 1, 2), s AS (SELECT c_custkey + 1000000 AS id FROM customer WHERE c_custkey <= 9)
          SELECT id, folder, hits FROM h UNION ALL SELECT s.id, n.name, 0 FROM s, n""")
def blocking_uncapped(spark, d):
    """All pairs of names that share a pair of characters; names of one character meet the stated list of brands."""
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("name"))
    right = p.select(F.col("name").alias("folder")).distinct().withColumn("folder_name", F.col("folder"))
    short = t(spark, d, "customer").filter("c_custkey <= 9").select((F.col("c_custkey") + 1_000_000).alias("id"), F.col("c_custkey").cast("string").alias("name"))
    return scoring.with_short_names(scoring.blocked(p, right, "id", "name", "folder", "folder_name", top=None), short, right, "id", "name", "folder")


@query("""WITH k AS (SELECT c_custkey AS e, 'k' || (c_custkey % 1400) AS key FROM customer), once AS (SELECT key, min(e) AS e FROM k GROUP BY 1 HAVING count(*) = 1),
               v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'k' || (o_custkey % 1400) END AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'v2' ELSE 'v1' END AS version, o_custkey + 100 AS old FROM orders)
          SELECT v.id, CASE WHEN v.key <> '' THEN once.e WHEN version = 'v2' THEN c.c_custkey END AS entity_id FROM v LEFT JOIN once ON once.key = v.key LEFT JOIN customer c ON c.c_custkey = v.old""")
def bind_overrides(spark, d):
    """By stable key, else by the id of this version."""
    keys = t(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("k"), F.col("c_custkey") % 1400).alias("key"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("k"), F.col("o_custkey") % 1400)).alias("public_entity_key"), F.when(F.col("o_orderkey") % 2 == 0, "v2").otherwise("v1").alias("database_version"), (F.col("o_custkey") + 100).alias("original_public_id"))
    return resolve.bound(o, keys, "v2").select("id", "entity_id")


@query("SELECT o_orderkey, o_custkey + 5000 AS o_custkey FROM orders WHERE o_custkey % 4 <> 1")
def remap_ids(spark, d):
    """J22."""
    ids = t(spark, d, "customer").filter("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 5000).alias("new_id"))
    return resolve.remapped(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 3")
def parent_folders(spark, d):
    """Authors whose group has no folder are left out."""
    groups = t(spark, d, "nation").filter("n_regionkey <> 3").select(F.col("n_nationkey").alias("number"), "n_name")
    return resolve.parents(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("number")), groups, "number").select("c_custkey", "n_name")


@query("""SELECT o_custkey AS artist_id, c_nationkey AS group_id, 'user' AS source, n_name AS label FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
          UNION ALL SELECT s_suppkey, s_nationkey, 'override', n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT s_suppkey, s_nationkey + 100, 'override', '' FROM supplier""")
def relation_listing(spark, d):
    """The user's relations, then those nested in overrides."""
    user = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_custkey").alias("artist_id"), F.col("c_nationkey").alias("group_id"))
    overrides = t(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.array(F.struct(F.col("s_nationkey").alias("group_id")), F.struct((F.col("s_nationkey") + 100).alias("group_id"))).alias("user_groups"))
    return resolve.relations(user, overrides, t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("canonical_name")))


@query("""SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 4 = 0 THEN 'renamed ' || c_custkey ELSE c_name END AS canonical_name,
                 CASE WHEN c_custkey % 8 = 0 THEN 'added ' || c_custkey WHEN c_custkey % 4 = 0 THEN 'added ' || c_custkey || '|' || lower(c_name) ELSE lower(c_name) END AS names FROM customer""")
def overlay_view(spark, d):
    """Canonical names replaced, aliases added, names disabled."""
    c = t(spark, d, "customer")
    entity = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"))
    alias = c.select(F.col("c_custkey").alias("entity_id"), F.lower("c_name").alias("norm"))
    off = F.when(F.col("c_custkey") % 8 == 0, F.array(F.concat(F.lit(" "), F.upper("c_name"), F.lit("　")))).otherwise(F.array().cast("array<string>"))
    o = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("renamed "), "c_custkey").alias("canonical_name"), F.array(F.concat(F.lit("　Ａｄｄｅｄ  "), "c_custkey")).alias("added_aliases"), off.alias("disabled_names"))
    names, aliases = resolve.overlaid(entity, alias, o)
    return names.withColumnRenamed("id", "entity_id").join(kb.listed(aliases, ["entity_id"], "norm", "names", "|"), "entity_id")


@query("""SELECT c_custkey AS artist_id, c_nationkey AS group_id, 'Public' AS source, true AS confirmed FROM customer UNION ALL SELECT c_custkey, -n_nationkey, 'User', n_nationkey % 2 = 0 FROM customer JOIN nation ON n_nationkey < c_custkey % 4 WHERE c_custkey % 5 = 0 AND n_nationkey <> 1""")
def overlay_relations(spark, d):
    """Relations that overrides add, but for those they have disabled."""
    c = t(spark, d, "customer")
    group = lambda i: F.struct(F.lit(i).cast("long").alias("circle_id"), F.lit(i % 2 == 0).alias("user_confirmed"), F.lit(i == 1).alias("disabled"))
    o = c.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("entity_id"), F.slice(F.array(*[group(i) for i in range(4)]), 1, (F.col("c_custkey") % 4).cast("int")).alias("user_groups"))
    return resolve.overlaid_relations(c.select(F.col("c_custkey").alias("artist_id"), F.col("c_nationkey").alias("group_id")), o)


@query("""WITH c AS (SELECT l_orderkey AS f, l_linenumber * 1000000 + l_suppkey AS pos, CASE WHEN l_partkey % 6 = 0 THEN 'Ambiguous' WHEN l_partkey % 6 < 4 THEN 'Matched' ELSE 'NotFound' END AS status, CASE WHEN l_partkey % 6 IN (1, 2, 3) THEN l_suppkey END AS target, l_partkey % 7 = 0 AS known, l_partkey % 5 = 0 AS cautious FROM lineitem),
               a AS (SELECT f, min(CASE WHEN known AND target IS NOT NULL THEN pos END) AS at_, max(CASE WHEN status = 'Ambiguous' THEN 1 ELSE 0 END) AS unsure, count(DISTINCT CASE WHEN NOT cautious THEN target END) AS n, min(CASE WHEN NOT cautious THEN target END) AS tt,
                            count(DISTINCT CASE WHEN cautious THEN target END) AS cn, min(CASE WHEN cautious THEN target END) AS ct FROM c GROUP BY 1)
          SELECT a.f AS file, CASE WHEN at_ IS NOT NULL THEN 'Matched' WHEN unsure = 1 THEN 'Ambiguous' WHEN n = 1 THEN 'Matched' WHEN n > 1 THEN 'Choice' WHEN cn = 1 THEN 'Matched' WHEN cn > 1 THEN 'Choice' ELSE 'NotFound' END AS status,
                 CASE WHEN at_ IS NOT NULL THEN at_ % 1000000 WHEN unsure = 1 THEN NULL WHEN n = 1 THEN tt WHEN n = 0 AND cn = 1 THEN ct END AS target FROM a""")
def resolve_files(spark, d):
    """A file's candidates come to one answer."""
    m = F.col("l_partkey") % 6
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("position"), F.when(m == 0, "Ambiguous").when(m < 4, "Matched").otherwise("NotFound").alias("status"), F.when(m.isin(1, 2, 3), F.col("l_suppkey")).alias("target"), (F.col("l_partkey") % 7 == 0).alias("known"), (F.col("l_partkey") % 5 == 0).alias("cautious"))
    return resolve.combined(rows, "file", "target")


#: Files of eight shapes named after parts, and the first word of a part's name as identity: by the statement of where a name stands and what that is worth.
SCORE_SQL = r"""p0 AS (SELECT p_partkey AS id, p_size, split_part(p_name, ' ', 1) AS who, split_part(p_name, ' ', 2) AS what FROM part),
               p1 AS (SELECT *, CASE p_size % 8 WHEN 0 THEN '[' || who || '] ' || what WHEN 1 THEN who || ' ' || what WHEN 2 THEN '(' || what || ' (' || who || ')) x' WHEN 3 THEN what || who || 'x' WHEN 4 THEN what || ' [' || who || ']'
                                     WHEN 5 THEN upper(who) || '-' || what WHEN 6 THEN 'x' || left(who, length(who) - 1) || ' ' || what ELSE 'zz' || chr(12288) || who END AS raw,
                             CASE WHEN p_size % 3 = 0 THEN who ELSE 'not ' || who END AS written, CASE WHEN p_size % 8 = 2 THEN [who] ELSE [] END AS creators, CASE WHEN p_size % 13 = 0 THEN [who || ' tag'] ELSE [] END AS tags FROM p0),
               p2 AS (SELECT *, lower(replace(raw, chr(12288), ' ')) AS txt, length(who) AS n, list_concat(regexp_extract_all(replace(raw, chr(12288), ' '), '[\[\(]\s*([^\]\)]{1,80})\s*[\]\)]', 1), list_filter(string_split_regex(replace(raw, chr(12288), ' '), '[\s_\-]+')[1:4], lambda x: trim(x) <> '')) AS found FROM p1),
               p3 AS (SELECT *, list_transform(found, lambda x: trim(lower(x))) AS places,
                             list_filter(range(1, length(txt) - n + 2), lambda i: substr(txt, i, n) = who AND (i = 1 OR contains('[]()-_., ', substr(txt, i - 1, 1))) AND (i + n > length(txt) OR contains('[]()-_., ', substr(txt, i + n, 1))))[1] AS at_,
                             list_filter(range(1, length(raw) - length(written) + 2), lambda i: lower(substr(raw, i, length(written))) = lower(written) AND (i = 1 OR contains('[]()-_., ' || chr(12288), substr(raw, i - 1, 1)))
                                         AND (i + length(written) > length(raw) OR contains('[]()-_., ' || chr(12288), substr(raw, i + length(written), 1))))[1] AS raw_at FROM p2),
               fz AS (SELECT id, max(greatest(CASE WHEN n >= 3 AND (contains(x, who) OR contains(who, x)) AND least(length(x), n) >= 3 AND least(length(x), n) * 100 // greatest(length(x), n) >= 60 THEN 40 ELSE 0 END,
                                              CASE WHEN levenshtein(x, who) = 1 AND n >= 4 THEN 70 WHEN levenshtein(x, who) = 2 AND n >= 6 THEN 55 ELSE 0 END)) AS fuzzy FROM (SELECT id, who, n, unnest(places) AS x FROM p3) GROUP BY 1),
               v AS (SELECT p3.id, p_size, n, at_, coalesce(fuzzy, 0) AS fuzzy, CASE WHEN p_size % 5 = 0 OR raw_at IS NOT NULL THEN 100 ELSE 95 END + CASE WHEN p_size % 4 = 1 THEN 20 ELSE 0 END + CASE WHEN list_contains(creators, who) THEN 30 ELSE 0 END
                            + CASE WHEN regexp_matches(left(txt, at_ - 1), '^[\s\[({<]*$') THEN 15 ELSE 0 END + CASE WHEN at_ > 1 AND substr(txt, at_ - 1, 1) || substr(txt, at_ + n, 1) IN ('[]', '()') THEN 10 ELSE 0 END
                            - CASE WHEN len(list_filter(tags, lambda t: contains(t, who))) > 0 THEN 100 ELSE 0 END AS value FROM p3 LEFT JOIN fz ON fz.id = p3.id),
               r AS (SELECT id, p_size, CASE WHEN at_ IS NULL THEN CASE WHEN n <= 2 THEN least(40, fuzzy) ELSE fuzzy END ELSE greatest(0, CASE WHEN n <= 2 THEN least(75, value) ELSE value END) END AS score FROM v)"""


def scored(spark, d) -> DataFrame:
    p, k = t(spark, d, "part"), F.col("p_size")
    who, what = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    shapes = [F.concat(F.lit("["), who, F.lit("] "), what), F.concat_ws(" ", who, what), F.concat(F.lit("("), what, F.lit(" ("), who, F.lit(")) x")), F.concat(what, who, F.lit("x")), F.concat(what, F.lit(" ["), who, F.lit("]")), F.concat_ws("-", F.upper(who), what), F.concat(F.lit("x"), F.left(who, F.length(who) - 1), F.lit(" "), what), F.concat(F.lit("zz　"), who)]
    raw = F.element_at(F.array(*shapes), (k % 8 + 1).cast("int"))
    none = F.array().cast("array<string>")
    rows = p.select(F.col("p_partkey").alias("id"), "p_size", who.alias("who"), raw.alias("raw"), text.nfkc(raw).alias("form"))
    score = scoring.identity_score(
        scoring.search_form(F.col("form")), F.col("raw"), scoring.regions(F.col("form")), F.when(k % 8 == 2, F.array("who")).otherwise(none), F.when(k % 13 == 0, F.array(F.concat("who", F.lit(" tag")))).otherwise(none),
        F.col("who"), F.when(k % 3 == 0, F.col("who")).otherwise(F.concat(F.lit("not "), "who")), k % 5 == 0, k % 4 == 1,
    )
    return rows.select("id", "p_size", score.alias("score"))


@query(f"WITH {SCORE_SQL} SELECT id, score FROM r")
def identity_scores(spark, d):
    """Where a complete name stands in a file, or how near one of its regions comes."""
    return scored(spark, d).select("id", "score")


@query(f"WITH {SCORE_SQL} SELECT p_size, id % 10 AS folder, max(score) + CASE WHEN count(CASE WHEN score >= 80 THEN 1 END) >= 2 THEN 20 ELSE 0 END AS score FROM r GROUP BY 1, 2")
def folder_scores(spark, d):
    """The best identity of a folder, and more if several are good."""
    return scoring.folder_scores(scored(spark, d).withColumn("folder", F.col("id") % 10), ["p_size", "folder"])


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS target, CASE WHEN o_orderkey % 7 = 0 THEN 'manual' WHEN o_orderkey % 3 = 0 THEN 'classic' ELSE 'scored' END AS "by"
          FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 2 = 0""")
def decision_order(spark, d):
    """A person's assignment, else the cascade, else the scores."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    some = lambda k, v: o.withColumn("target", F.when(F.col("id") % k == 0, v))
    return resolve.classic_first(some(3, 2), some(2, 3), some(7, 1), "id", "target")


@query("""WITH e AS (SELECT DISTINCT o_orderpriority AS prefix FROM orders), k AS (SELECT o_orderpriority AS prefix, max(CASE WHEN o_orderkey = 7 THEN 1 ELSE 0 END) AS c FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
          SELECT e.prefix, coalesce(c, 0) = 0 AS as_event FROM e LEFT JOIN k ON k.prefix = e.prefix""")
def event_or_name(spark, d):
    """What a person confirmed as a name is one."""
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("prefix"), (F.col("o_orderkey") == 7).alias("user_confirmed"))
    return resolve.event_first(o.filter("prefix <> '5-LOW'"), o.select("prefix"), "prefix")


@query("""WITH r AS (SELECT o_custkey AS q, o_orderkey % 5 AS cand, o_orderkey % 3 = 0 AS exact, 85 + o_orderkey % 12 AS score, o_orderkey % 31 = 0 AS conflict FROM orders WHERE o_orderkey % 4 <> 0),
               a AS (SELECT q, count(DISTINCT CASE WHEN exact THEN cand END) AS n, min(CASE WHEN exact THEN cand END) AS c, max(CASE WHEN exact THEN score END) AS s, max(CASE WHEN conflict THEN 1 ELSE 0 END) AS k FROM r GROUP BY 1)
          SELECT q, CASE WHEN n = 1 AND s >= 90 AND k = 0 THEN 'Confirmed' ELSE 'Candidate' END AS status, CASE WHEN n = 1 AND s >= 90 AND k = 0 THEN c END AS candidate FROM a""")
def online_confirmed(spark, d):
    """E21."""
    k = F.col("o_orderkey")
    r = t(spark, d, "orders").select(F.col("o_custkey").alias("q"), (k % 5).alias("candidate"), (k % 3 == 0).alias("exact"), (k % 12 + 85).alias("score"), (k % 31 == 0).alias("conflict"), (k % 4 == 0).alias("likely_group"))
    return resolve.online_confirmed(r, "q")


@query("""WITH e AS (SELECT o_custkey AS q, o_orderkey % 3 AS identity, o_orderkey % 4 AS work, o_orderkey % 6 <> 0 AS in_title, o_orderkey % 5 = 0 AS structured, o_orderkey % 10 < 6 AS tag FROM orders),
               a AS (SELECT q, identity, count(DISTINCT work) AS works, max(CASE WHEN NOT in_title THEN 1 ELSE 0 END) AS al, max(CASE WHEN (structured AND tag) OR NOT in_title THEN 1 ELSE 0 END) AS ti FROM e WHERE in_title OR tag GROUP BY 1, 2),
               n AS (SELECT q, sum(al) AS als, sum(ti) AS tis FROM a GROUP BY 1),
               r AS (SELECT a.*, ti = 1 AND works >= 2 AND tis = 1 AS sure, CASE WHEN works >= 3 THEN 92 WHEN works = 2 THEN 88 ELSE 75 END AS s FROM a JOIN n ON n.q = a.q WHERE al = 0 OR (works >= 2 AND als = 1))
          SELECT q, identity, works, CASE WHEN sure THEN greatest(92, s) ELSE s END AS score, CASE WHEN sure AND al = 1 THEN 'alias' WHEN sure THEN 'title' ELSE 'search' END AS bridge FROM r""")
def online_bridge(spark, d):
    """What two works or more and a single bridged identity are worth."""
    k = F.col("o_orderkey")
    e = t(spark, d, "orders").select(F.col("o_custkey").alias("q"), (k % 3).alias("identity"), (k % 4).cast("string").alias("work"), (k % 6 != 0).alias("in_title"), (k % 5 == 0).alias("structured"), (k % 10 < 6).alias("tag_in_title"))
    return resolve.bridged(e, "q")


# --- names and rules


@query("""SELECT c_custkey AS id, lower(c_name) AS unwrapped, CASE WHEN c_custkey % 2 = 0 THEN '作者名前' ELSE '作者 ' || lower(c_name) END AS joined, CASE WHEN c_custkey % 2 = 0 THEN '作者|名前' ELSE '' END AS segments,
                 'a·' || lower(c_name) || '-~' AS cautious, 'x' || lower(c_name) AS compatible FROM customer""")
def name_forms(spark, d):
    """Brackets around the whole, joined and split parts, cautious and compatibility forms."""
    c = t(spark, d, "customer")
    two = F.when(F.col("c_custkey") % 2 == 0, F.lit("作者 名前")).otherwise(F.concat(F.lit("作者 "), "c_name"))
    cautious = F.concat(F.lit("「“a・"), "c_name", F.lit("—～”」."))
    wide = F.concat(F.lit("ｘ"), "c_name", F.lit("​"))
    return c.select(F.col("c_custkey").alias("id"), F.lower(text.unwrapped(F.concat(F.lit("【["), "c_name", F.lit("]】")))).alias("unwrapped"), text.cjk_joined(two).alias("joined"), F.array_join(text.safe_segments(two), "|").alias("segments"), text.normalize_cautious(F.regexp_replace(cautious, r"\.$", "")).alias("cautious"), text.normalize(wide).alias("compatible"))


@query("""SELECT c_custkey AS id, '[' || c_mktsegment || ' (' || c_name || ')] t' AS name, c_mktsegment || ' (' || c_name || ')|' || c_mktsegment || '|' || c_name || '|t|[' || c_mktsegment || ' (' || c_name || ')] t' AS aliases,
                 lower('[' || c_mktsegment || '(' || c_name || ')]t|' || c_mktsegment || '(' || c_name || ')') AS literal FROM customer""")
def name_aliases(spark, d):
    """What a folder's name may stand for."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("["), "c_mktsegment", F.lit(" ("), "c_name", F.lit(")] t")).alias("name"))
    return c.select("id", "name", F.array_join(grammar.aliases_udf("name"), "|").alias("aliases"), F.array_join(grammar.literal_norms_udf("name"), "|").alias("literal"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'C' || o_custkey WHEN 2 THEN '未知' WHEN 3 THEN '5-LOW' END AS prefix, CASE o_orderkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 85 WHEN 2 THEN 0 WHEN 3 THEN 80 END AS confidence,
                 CASE o_orderkey % 4 WHEN 2 THEN '' ELSE 'work ' || o_orderkey END AS title, CASE o_orderkey % 4 WHEN 0 THEN 'circle' ELSE '' END AS society FROM orders""")
def name_prefixes(spark, d):
    """a prefix before [society (creator)], one that is written like an event, one that nothing speaks for, and one that the batch knows."""
    o, k = t(spark, d, "orders"), F.col("o_orderkey") % 4
    work = F.concat(F.lit("work "), "o_orderkey", F.lit(" [Chinese]"))
    name = F.when(k == 0, F.concat(F.lit("("), "o_orderpriority", F.lit(") [circle (c"), "o_custkey", F.lit(")] "), work)).when(k == 1, F.concat(F.lit("（C"), "o_custkey", F.lit("） "), work)).when(k == 2, F.concat(F.lit("(未知) "), work)).otherwise(F.concat(F.lit("(5-LOW) [a] "), work))
    p = o.select(F.col("o_orderkey").alias("id"), grammar.parse_udf(frozenset({"5-low"}))(name).alias("p"))
    return p.select("id", "p.prefix", "p.confidence", "p.title", "p.society")


@query("""WITH x AS (SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'C' || (c_custkey % 100) WHEN 1 THEN c_name WHEN 2 THEN 'DL版' WHEN 3 THEN 'x DL版' WHEN 4 THEN '2024年' || (1 + c_custkey % 9) || '月' WHEN 5 THEN 'some 漢化 by ' || c_name WHEN 6 THEN '20' || (10 + c_custkey % 80) || '.11' ELSE '' END AS tag FROM customer)
          SELECT id, tag, id % 8 NOT IN (1, 3) AS metadata FROM x""")
def default_rules(spark, d):
    """The default rules for tags that aren't names."""
    k, n = F.col("c_custkey") % 8, F.col("c_custkey")
    tag = F.when(k == 0, F.concat(F.lit("C"), n % 100)).when(k == 1, F.col("c_name")).when(k == 2, "DL版").when(k == 3, "x DL版").when(k == 4, F.concat(F.lit("2024年"), n % 9 + 1, F.lit("月"))).when(k == 5, F.concat(F.lit("some 漢化 by "), "c_name")).when(k == 6, F.concat(F.lit("20"), n % 80 + 10, F.lit(".11"))).otherwise("")
    x = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), tag.alias("tag"))
    return x.withColumn("metadata", rules.is_metadata_tag("tag"))


@query(r"""SELECT p_partkey AS id, regexp_matches(p_brand, '^(?:Brand#|B)\s*\d{2,3}$') AS digits, regexp_matches(p_type, '^(?:STANDARD|PROMO).*$') AS starts, regexp_matches(p_type, '^.*(?:STEEL|TIN)$') AS ends FROM part""")
def visual_rules(spark, d):
    """F15 SRC11: rules made without writing an expression, loaded from their JSON."""
    import json

    made = {"digits": ("PrefixDigits", "Brand#|B", "p_brand"), "starts": (rules.STARTS, "STANDARD|PROMO", "p_type"), "ends": (rules.ENDS, "STEEL|TIN", "p_type")}
    loaded = rules.load_rules(json.dumps([{"name": n, "kind": rules.REGEX, "pattern": rules.visual_pattern(k, p, 2, 3)} for n, (k, p, _) in made.items()]))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), *[r.hits(F.col(made[r.name][2])).alias(r.name) for r in loaded])


@query("""SELECT o_orderkey AS id, o_orderkey % 3 <> 1 AS starts, o_orderkey % 3 = 2 AS after_event FROM orders""")
def leading_names(spark, d):
    """a text that starts with a complete name, by itself or after an event's description."""
    k = F.col("o_orderkey") % 3
    name = F.concat(F.lit("maker"), F.col("o_custkey"))
    txt = F.when(k == 1, F.concat(name, F.lit("x title"))).otherwise(F.concat(name, F.lit(" title")))
    event = F.when(k == 2, F.concat(F.lit("C99 "), txt)).otherwise(txt)
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.starts_with_complete(txt, name).alias("starts"), text.event_then_identity(event, name).alias("after_event"))


@query("SELECT count(DISTINCT (o_orderpriority, o_orderstatus, o_custkey)) AS keys, count(DISTINCT (o_orderpriority, o_orderstatus, o_custkey)) AS fingerprints, count(*) AS \"rows\" FROM orders")
def fingerprints(spark, d):
    """as many fingerprints as there are different rows."""
    o = t(spark, d, "orders")
    return o.agg(F.countDistinct("o_orderpriority", "o_orderstatus", "o_custkey").alias("keys"), F.countDistinct(text.fingerprint("o_orderpriority", "o_orderstatus", "o_custkey")).alias("fingerprints"), F.count(F.lit(1)).alias("rows"))


@query("""SELECT event_id, upper(replace('c:/' || event_type || '/' || event_id, '/', chr(92))) AS key, user_id || '|' || (event_id * 1000003) || '|' || (event_id + 5) || '|' || upper(event_type) AS signature FROM events""")
def rename_signatures(spark, d):
    """F28 F29."""
    e = t(spark, d, "events").select("event_id", F.concat(F.lit("c:/"), "event_type", F.lit("/"), "event_id", F.lit("/")).alias("full_path"), F.col("user_id").alias("file_size"), F.timestamp_micros(F.col("event_id") * 1_000_003).alias("last_write_utc"), F.timestamp_micros(F.col("event_id") + 5).alias("creation_utc"), F.col("event_type").alias("extension"))
    return cdc.with_signature(e).select("event_id", "key", "signature")


@query(f"WITH x AS (SELECT o_orderkey AS id, {STATUS_SQL} AS s, o_orderkey % 2 = 0 AS c FROM orders) SELECT id, CASE WHEN s = 'Matched' AND c THEN 'MatchedCautious' ELSE s END AS code FROM x")
def status_codes(spark, d):
    """F27."""
    return statuses(spark, d).select(F.col("o_orderkey").alias("id"), resolve.status_code(F.col("status"), F.when(F.col("o_orderkey") % 2 == 0, "Cautious").otherwise("Exact")).alias("code"))


@query(f"WITH {URL_SQL} SELECT page_id FROM p WHERE NOT contains(host, 'spam')")
def excluded_view(spark, d):
    """Rules hide rows from a view; the index keeps them."""
    own = [rules.Rule("spam", rules.CONTAINS, "spam")]
    return rules.excluded_view(urls(spark, d).withColumn("rule", rules.first_hit(F.col("host"), own))).select("page_id")


@query(f"SELECT o_orderkey AS id FROM (SELECT o_orderkey, {STATUS_SQL} AS s FROM orders) WHERE s IN ('NewAuthor', 'NewAuthorReuse')")
def scan_mode(spark, d):
    """P9."""
    return statuses(spark, d).filter(report.mode("NewAuthor", F.col("status"))).select(F.col("o_orderkey").alias("id"))


@query(f"SELECT count(*) AS n, count(DISTINCT s) AS kinds FROM (SELECT {STATUS_SQL} AS s FROM orders) WHERE s = 'Ambiguous' OR s = 'Choice' HAVING count(*) < 25 UNION ALL SELECT 25, 1 FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 9 IN (1, 7)) WHERE n >= 25")
def early_stop(spark, d):
    """A scan that stops when so many rows of its mode are found; which ones doesn't matter, the limit is the feature."""
    rows = planning.early_stop(statuses(spark, d), report.mode("Ambiguous", F.col("status")), 25)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(report.view_class(F.col("status"))).alias("kinds"))


@query(f"SELECT id FROM (SELECT o_orderkey AS id, {STATUS_SQL} AS s, o_custkey % 4 AS v FROM orders) WHERE s <> 'Error' AND v = 2")
def cache_validity(spark, d):
    """Cached rows of today's fingerprint and version, unless their status forbids it."""
    cached = statuses(spark, d).select(F.col("o_orderkey").alias("id"), "status", (F.col("o_custkey") % 4).alias("version"), F.col("o_orderpriority").alias("fingerprint"))
    facts = cached.filter("version = 2").select("fingerprint", "version").distinct()
    return planning.still_valid(cached, facts, ["fingerprint", "version"]).select("id")


# --- plans


@query("""WITH o AS (SELECT s_nationkey AS g, count(*) AS n FROM supplier GROUP BY 1), h AS (SELECT max(g) AS g FROM o), c AS (SELECT n FROM o, h WHERE o.g = h.g),
               f AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'alias:' || lower(c_mktsegment) WHEN c_custkey % 3 = 1 THEN 'entity:' || c_nationkey ELSE 'name:' || lower(c_name) END AS identity, c_custkey FROM customer),
               k AS (SELECT identity, row_number() OVER (ORDER BY min(c_custkey), identity) - 1 AS slot FROM f GROUP BY 1)
          SELECT identity, slot, CASE WHEN c.n < 20 THEN greatest(1, h.g) + (c.n + slot) // 20 ELSE greatest(1, h.g) + 1 + slot // 20 END AS group_number FROM k, c, h""")
def plan_from_occupancy(spark, d):
    """New identities go on from the highest group and what it holds."""
    highest, occupied = planning.occupancy(t(spark, d, "supplier").select(F.col("s_nationkey").alias("number")), "number")
    k = F.col("c_custkey") % 3
    identity = planning.identity_key(F.when(k == 0, F.col("c_mktsegment")), F.when(k == 1, F.col("c_nationkey")), F.col("c_name"), compat=False)
    files = t(spark, d, "customer").select(identity.alias("identity"), "c_custkey")
    return planning.allocated(files, "identity", "c_custkey", highest, occupied, 20).select("identity", "slot", "group_number")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'NewAuthor' ELSE 'NewAuthorReuse' END AS status FROM orders""")
def plan_statuses(spark, d):
    """L2: the first file of a new identity makes it."""
    return planning.new_statuses(t(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select(F.col("o_orderkey").alias("id"), "status")


@query("""SELECT c_custkey AS file, c_custkey - c_custkey % 7 AS identity FROM customer""")
def plan_linked(spark, d):
    """L2 H1: a file takes over the identity that an earlier file of a shared name planned."""
    c = t(spark, d, "customer")
    own = F.concat(F.lit("n"), F.floor(F.col("c_custkey") / 7))
    norms = F.when(F.col("c_custkey") % 7 == 0, F.array(own, F.concat(F.lit("m"), "c_custkey"))).otherwise(F.array(own, F.concat(F.lit("x"), "c_custkey")))
    return planning.linked_identities(c.select(F.col("c_custkey").alias("file"), norms.alias("norms")).withColumn("order", F.col("file")), "file", "order", "norms").select("file", "identity")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 THEN n_name || ' (' || c_name || ')' ELSE c_name END AS label FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def canonical_labels(spark, d):
    """L4: "group (artist)" where exactly one related group has the society's name."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    n = t(spark, d, "nation")
    files = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("artist"), F.when(F.col("o_orderkey") % 2 == 0, F.col("c_nationkey")).otherwise(-1).alias("society"), F.col("c_name").alias("artist_name"))
    groups = t(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("artist"), F.col("n_nationkey").alias("group_norm"), F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("group_name"))
    # every fifth artist has no group, every fourth two of the same name
    groups = groups.filter("artist % 5 <> 0")
    groups = groups.unionByName(groups.filter("artist % 4 = 0").withColumn("group_id", F.col("group_id") + 1000))
    return planning.canonical_label(files, groups, "artist", "society").select("id", "label")


@query("""WITH f AS (SELECT c_custkey AS file, c_custkey % 20 AS o, c_custkey // 20 AS chain FROM customer)
          SELECT file, CASE WHEN o % 2 = 0 THEN file ELSE file - 1 END AS identity FROM f""")
def plan_chained(spark, d):
    """L2 H1: chains in which each file shares a name with the next alone, so makers alternate."""
    k = F.col("c_custkey")
    link = lambda i: F.concat_ws("-", F.floor(k / 20), i)
    c = t(spark, d, "customer").select(k.alias("file"), k.alias("order"), F.array(link(k % 20), link(k % 20 + 1)).alias("norms"))
    return planning.linked_identities(c, "file", "order", "norms")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'AlreadyInTarget' WHEN 1 THEN 'TargetExists' ELSE 'Movable' END AS state FROM orders")
def terminal_states(spark, d):
    """L5."""
    k = F.col("o_orderkey") % 3
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), planning.terminal_state(F.lit("A/b"), F.when(k == 0, "a/B").otherwise("c"), k == 1).alias("state"))


@query("""WITH i AS (SELECT CAST(range AS BIGINT) AS i FROM range((SELECT count(*) FROM orders)))
          SELECT i AS file, i % 37 AS author, CASE i % 3 WHEN 0 THEN '[author' || i % 37 || '] work ' || i WHEN 1 THEN '[circle' || i % 37 || ' (author' || i % 37 || ')] work ' || i ELSE '(C99) [author' || i % 37 || '] work ' || i END || '.zip' AS name,
                 1024 + (i * 7919) % 1048576 AS size FROM i""")
def synthetic_library(spark, d):
    """L8."""
    return planning.synthetic(spark, t(spark, d, "orders").count(), 37).select("file", "author", "name", "size")


@query("SELECT true AS same, false AS other")
def preview_equality(spark, d):
    """All columns, whatever the order of rows."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return spark.createDataFrame([(planning.same_preview(o, o.orderBy(F.desc("o_orderkey"))), planning.same_preview(o, o.withColumn("o_orderstatus", F.lower("o_orderstatus"))))], "same boolean, other boolean")


@query("""WITH r AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS source, c_mktsegment || CAST(o_orderdate AS DATE) AS target FROM orders JOIN customer ON c_custkey = o_custkey WHERE lower(o_orderpriority) IN ('1-urgent', '5-low') AND c_nationkey <= 20),
               k AS (SELECT target, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM r GROUP BY 1 HAVING count(DISTINCT source) > 1) SELECT r.id, k.sources FROM r JOIN k ON k.target = r.target""")
def restored_session(spark, d):
    """An earlier session's rows that today's settings allow, and which of them now stand in each other's way."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("extension"), F.col("c_nationkey").alias("depth"), F.col("o_custkey").cast("string").alias("source"), F.concat("c_mktsegment", F.to_date("o_orderdate").cast("string")).alias("target"))
    return planning.conflict_sources(planning.restored(rows, ["1-URGENT", "5-LOW"], 20), "source", "target").select("id", F.array_join("sources", "|").alias("sources"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def newest_lookups(spark, d):
    """The limit is the feature."""
    return report.newest(t(spark, d, "events"), "ts", "event_id").select("event_id")


# --- snapshots


@query("""SELECT CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 10 < 5 THEN 'Moved' ELSE 'Removed' END END AS kind, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1
          UNION ALL SELECT 'Added', count(*) FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 10 >= 5 UNION ALL SELECT 'CacheHit', count(*) FROM orders WHERE o_orderkey % 5 = 0""")
def cdc_scope_relocations(spark, d):
    """C4: only direct children of the scanned folder may have moved."""
    o = t(spark, d, "orders")
    k = F.col("o_orderkey")
    root = F.when(k % 10 < 5, "r").otherwise("r/deep")
    rows = lambda head: o.select(F.concat(F.lit(head), F.when(k % 5 == 0, "same").otherwise(head), k).alias("key"), k.cast("string").alias("sig"), k.alias("name"), k.alias("ord"), root.alias("dir"))
    old = o.select(F.concat(F.when(k % 5 == 0, "same").otherwise("old"), k).alias("key"), k.cast("string").alias("sig"), k.alias("name"), k.alias("ord"), root.alias("dir"))
    new = o.select(F.concat(F.when(k % 5 == 0, "same").otherwise("new"), k).alias("key"), k.cast("string").alias("sig"), k.alias("name"), k.alias("ord"))
    return cdc.counters(cdc.delta(old, new, "key", "sig", "name", "ord", cdc.shallow_children(old, "dir", "r"))).withColumnRenamed("rows", "n")


@query("SELECT o_orderpriority AS scope_key, count(*) AS members FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1 UNION ALL SELECT '5-LOW', count(*) FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderkey % 3 = 0")
def cdc_unknown_scope(spark, d):
    """An unknown scope removes nothing."""
    o = t(spark, d, "orders")
    members = o.select(F.col("o_orderpriority").alias("scope_key"), F.col("o_orderkey").alias("file_id"))
    kept, _ = cdc.scoped(members, members.select("file_id"), o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("file_id")), "5-LOW", known=False, shallow=False)
    return kept.groupBy("scope_key").agg(F.count(F.lit(1)).alias("members"))


@query("""WITH n AS (SELECT c_custkey AS id, c_custkey % 60 AS norm FROM customer), i AS (SELECT s_suppkey AS folder, s_suppkey % 6 AS role, s_suppkey * 7 % 70 AS norm FROM supplier),
               h AS (SELECT id, role + 1 AS stage, folder FROM n JOIN i ON i.norm = n.norm WHERE role < 5 UNION SELECT id, 7, folder FROM n JOIN i ON i.norm = n.norm WHERE role = 5
                     UNION SELECT id, 6, folder FROM n JOIN i ON i.norm IN (n.norm + 1, n.norm + 2) WHERE role < 5 AND n.norm % 3 = 0 AND n.norm % 7 <> 0),
               m AS (SELECT id, min(stage) AS stage FROM h GROUP BY 1), r AS (SELECT h.id, h.stage, count(*) AS k, min(folder) AS f FROM h JOIN m ON m.id = h.id AND m.stage = h.stage GROUP BY 1, 2),
               a AS (SELECT n.id, norm, stage, k, f, norm % 7 = 0 AND coalesce(stage, 7) > 5 AS late FROM n LEFT JOIN r ON r.id = n.id)
          SELECT id, CASE WHEN late THEN 6 ELSE stage END AS stage, CASE WHEN late THEN 'Ambiguous' WHEN k = 1 THEN 'Matched' ELSE 'Choice' END AS status, CASE WHEN NOT late AND k = 1 THEN f END AS folder, CASE WHEN late THEN 0 ELSE k END AS targets FROM a WHERE late OR stage IS NOT NULL""")
def resolve_roles(spark, d):
    """Role after role, then every name of the entity in all roles."""
    k, s = F.col("c_custkey") % 60, F.col("s_suppkey")
    names = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), k.cast("string").alias("norm"))
    index = t(spark, d, "supplier").select(s.alias("folder"), (s % 6).alias("role"), (s * 7 % 70).cast("string").alias("norm"))
    entities = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(k % 7 == 0, resolve.AMBIGUOUS).when(k % 3 == 0, resolve.FOUND).otherwise(resolve.NOT_FOUND).alias("status"), k.alias("entity_id"))
    known = t(spark, d, "customer").select(k.alias("entity_id"), F.explode(F.array((k + 1).cast("string"), (k + 2).cast("string"))).alias("norm")).distinct()
    return resolve.role_cascade(names, index, entities, known, "id", "folder")


@query("""SELECT o_orderkey AS file_id, c_name AS name, l_linenumber AS plan FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_linenumber % 3 = 1""")
def session_plans(spark, d):
    """A session's files and their plans, made under a configuration that goes on from the asked one."""
    o, li, n = t(spark, d, "orders"), t(spark, d, "lineitem"), F.col("l_linenumber")
    members = o.select(F.col("o_orderpriority").alias("session_id"), F.col("o_orderkey").alias("file_id"))
    files = o.join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("file_id"), F.col("c_name").alias("name"))
    config = F.when(n % 3 == 0, "v1").when(n % 3 == 1, F.concat(F.lit("v1|AuthorDependency="), n)).otherwise(F.concat(F.lit("v12|AuthorDependency="), n))
    plans = li.select(F.col("l_orderkey").alias("file_id"), config.alias("config_key"), n.alias("plan"))
    return cdc.session_plans(members, files, plans, "1-URGENT", "v1", dependent=True).select("file_id", "name", "plan")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'third/' WHEN o_orderkey % 2 = 0 THEN 'second/' ELSE 'first/' END || o_orderkey AS full_path FROM orders")
def cdc_own_moves(spark, d):
    """The program's own moves, the last of each path counting."""
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    move = lambda rows, to, seq: rows.select(F.concat(F.lit("FIRST/"), k).alias("old_path"), F.concat(F.lit(to), k).alias("new_path"), F.lit(seq).alias("seq"))
    moves = move(o.filter("o_orderkey % 2 = 0"), "second/", 1).unionByName(move(o.filter("o_orderkey % 6 = 0"), "third/", 2))
    return cdc.applied(o.select(k.alias("id"), F.concat(F.lit("first/"), k).alias("full_path")), moves).select("id", "full_path")


@query("SELECT n_regionkey AS root, count(*) AS n FROM nation WHERE n_regionkey <> 1 GROUP BY 1 UNION ALL SELECT 1, count(*) FROM supplier")
def cdc_destination(spark, d):
    """A destination tree is replaced as a whole."""
    old = t(spark, d, "nation").select(F.col("n_regionkey").alias("root"), F.col("n_name").alias("name"))
    new = t(spark, d, "supplier").select(F.lit(1).alias("root"), F.col("s_name").alias("name"))
    same = cdc.replaced(old, new, 1, stamp_changed=False)
    return cdc.replaced(same, new, 1, stamp_changed=True).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id % 4 = 0 AND x.user_id = e.user_id AND e.ts >= x.ts AND e.ts <= x.ts + INTERVAL 3600 SECOND)""")
def own_changes_apart(spark, d):
    """Changes that the program announced are left out for a while."""
    e = t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("path"), F.col("ts").alias("at"))
    return cdc.others_changes(e, e.filter("event_id % 4 = 0").select("path", "at"), 3600).select("event_id")


SCOPED_SQL = """f AS (SELECT o_orderkey AS id, 'LIB\\' || upper(o_orderpriority) || '\\' || o_orderstatus AS dir, o_orderkey % 3 AS m FROM orders),
               s AS (SELECT 'all' AS scope_key, 'LIB' AS root, true AS recursive UNION ALL SELECT 'top', 'LIB', false UNION ALL SELECT DISTINCT 'p' || o_orderpriority, 'LIB\\' || upper(o_orderpriority), o_orderpriority > '3' FROM orders UNION ALL SELECT DISTINCT o_orderpriority || o_orderstatus, 'LIB\\' || upper(o_orderpriority) || '\\' || o_orderstatus, false FROM orders),
               m AS (SELECT scope_key, id FROM f JOIN s ON dir = root OR recursive AND starts_with(dir, root || '\\'))"""


def scoped_orders(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as files in a tree, and scopes on three levels of it."""
    o = t(spark, d, "orders")
    under = lambda *c: F.concat_ws("/", F.lit("lib"), *c)
    files = o.select(F.col("o_orderkey").alias("file_id"), under("o_orderpriority", "o_orderstatus").alias("directory"))
    fixed = spark.createDataFrame([("all", "lib/", True), ("top", "Lib", False)], "scope_key string, root string, recursive boolean")
    two = o.select(F.concat(F.lit("p"), "o_orderpriority"), under("o_orderpriority"), F.col("o_orderpriority") > "3").distinct()
    three = o.select(F.concat("o_orderpriority", "o_orderstatus"), under("o_orderpriority", "o_orderstatus"), F.lit(False)).distinct()
    return files, fixed.union(two).union(three)


@query(f"WITH {SCOPED_SQL} SELECT scope_key, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM m GROUP BY 1")
def scope_members(spark, d):
    """P5 C4: files and a table of scopes, nested ones too, in one pass."""
    files, scopes = scoped_orders(spark, d)
    return rules.scopes_of(files, "file_id", "directory", scopes).groupBy("scope_key").agg(F.count(F.lit(1)).alias("n"), F.sum("file_id").alias("total"))


@query(f"""WITH {SCOPED_SQL}, r AS (SELECT scope_key, scope_key NOT LIKE '%1-URGENT%' AS known, scope_key LIKE '%F' AS soft FROM s),
               seen AS (SELECT scope_key, id FROM m WHERE scope_key <> 'all' AND id % 3 <> 0 OR scope_key = 'all' AND id % 2 = 0), lost AS (SELECT m.*, soft FROM m JOIN r ON r.scope_key = m.scope_key AND r.known WHERE NOT EXISTS (SELECT 1 FROM seen n WHERE n.scope_key = m.scope_key AND n.id = m.id)),
               held AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM lost WHERE lost.scope_key = m.scope_key AND lost.id = m.id)),
               gone AS (SELECT id FROM lost WHERE (NOT soft OR id NOT IN (SELECT id FROM held)) AND id NOT IN (SELECT id FROM seen)),
               after_ AS (SELECT * FROM held WHERE id NOT IN (SELECT id FROM gone) UNION SELECT * FROM seen)
           SELECT scope_key, count(*) AS members, CAST(sum(id) AS BIGINT) AS total FROM after_ GROUP BY 1 UNION ALL SELECT 'files', count(*), CAST(sum(id) AS BIGINT) FROM f WHERE id NOT IN (SELECT id FROM gone)""")
def cdc_scopes(spark, d):
    """What scans of many scopes at once, some unknown, some shallow, leave of memberships and files."""
    files, scopes = scoped_orders(spark, d)
    members = rules.scopes_of(files, "file_id", "directory", scopes)
    k, i = F.col("scope_key"), F.col("file_id")
    seen = members.filter(F.when(k == "all", i % 2 == 0).otherwise(i % 3 != 0))
    kinds = scopes.select(k, (~F.contains(k, F.lit("1-URGENT"))).alias("known"), F.endswith(k, F.lit("F")).alias("shallow"), F.lit(False).alias("safe"))
    held, left = cdc.scoped_many(members, files, seen, kinds)
    sums = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name), F.sum("file_id").alias("total"))
    return sums(held.groupBy("scope_key"), "members").unionByName(sums(left.groupBy(F.lit("files").alias("scope_key")), "members"))


@query("""WITH r AS (SELECT p_partkey AS ord, p_partkey % 4 AS kind, CASE p_partkey % 4 WHEN 0 THEN lower(p_brand) WHEN 1 THEN left(lower(p_name), 1 + p_partkey % 7) WHEN 2 THEN right(lower(p_type), 1 + p_partkey % 5) ELSE substr(lower(p_name), 1 + p_partkey % 5, 1 + p_partkey % 4) END AS pattern FROM part WHERE p_size % 5 = 0),
               x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_name || ' ' || p_type ELSE p_type || ' ' || p_brand END AS txt FROM part),
               h AS (SELECT DISTINCT txt, ord FROM (SELECT DISTINCT txt FROM x) JOIN r ON pattern <> '' AND CASE kind WHEN 0 THEN lower(txt) = pattern WHEN 1 THEN starts_with(lower(txt), pattern) WHEN 2 THEN suffix(lower(txt), pattern) ELSE contains(lower(txt), pattern) END)
          SELECT id, 'r' || min(ord) AS rule FROM x JOIN h ON h.txt = x.txt GROUP BY 1""")
def rule_table_hits(spark, d):
    """Rules as a table as large as the texts' own; every kind meets its texts by equality."""
    p, k = t(spark, d, "part"), F.col("p_partkey")
    cut = [F.upper("p_brand"), F.left("p_name", 1 + k % 7), F.right("p_type", 1 + k % 5), F.substring("p_name", 1 + k % 5, 1 + k % 4)]
    table = p.filter("p_size % 5 = 0").select(k.alias("ord"), F.concat(F.lit("r"), k).alias("name"), F.element_at(F.array(*map(F.lit, (rules.EXACT, rules.STARTS, rules.ENDS, rules.CONTAINS))), (k % 4 + 1).cast("int")).alias("kind"), F.element_at(F.array(*cut), (k % 4 + 1).cast("int")).alias("pattern"))
    txt = F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.concat_ws(" ", "p_type", "p_brand"))
    return rules.first_hit_by_table(p.select(k.alias("id"), txt.alias("txt")), "id", "txt", table)


# --- streams


#: Files that a stream takes in one batch at most.
PER_BATCH = 1_000


def told(stream, out: str, checkpoint: str, parts: list[list[tuple[DataFrame, str]]]) -> None:
    """Parts are written one after another into the folders that a stream reads; after each the stream goes on from its checkpoint to the end of its input. stream: makes it anew."""
    for part in parts:
        for rows, path in part:
            rows.write.mode("append").parquet(path)
        to_end(stream(), out, checkpoint)


def to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


SCANS_SQL = f"""{DELTA_SQL} SELECT 0 AS scan, 'Added' AS kind, count(*) AS n FROM o UNION ALL SELECT 1, kind, count(*) FROM x GROUP BY 2"""
CHANGED_SQL = SCANS_SQL.replace("FROM x", "FROM x WHERE kind <> 'CacheHit'")


def scans(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two snapshots as events of two hours, and the time that goes on."""
    old, new = order_snapshots(spark, d)
    at = lambda rows, hour: rows.select(F.col("key"), F.col("sig").alias("signature"), F.col("name").cast("string").alias("name"), F.col("ord").alias("pos"), F.lit(False).alias("gone"), F.lit(f"2026-01-01 {hour:02d}:00:00").cast("timestamp").alias("at"))
    tick = spark.range(1).select(F.lit(None).cast("string").alias("key"), F.lit("").alias("signature"), F.lit("").alias("name"), F.lit(0).cast("long").alias("pos"), F.lit(False).alias("gone"), F.lit("2026-01-01 03:59:00").cast("timestamp").alias("at"))
    return at(old, 1), at(new, 2), tick


def scan_counters(spark, out: str) -> DataFrame:
    first = F.unix_millis(F.lit("2026-01-01 01:00:00").cast("timestamp"))
    rows = spark.read.parquet(out).withColumn("scan", F.floor((F.col("ms") - first) / 3_600_000).cast("int"))
    return cdc.relocated(rows, "scan").filter("scan < 2").groupBy("scan", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCANS_SQL}")
def stream_scans(spark, d):
    """Snapshots as a stream, what is known in the state store, what wasn't seen again by timers; the second scan comes after a restart from the checkpoint."""
    own = stateful.stateful_session(spark)
    old, new, tick = scans(spark, d)
    path, out = folder(spark, "scans"), folder(spark, "scan-changes")
    stream = lambda: stateful.changes_of_paths(changes.snapshots(own, path, old.schema, PER_BATCH), "10 minutes", 5_400_000)
    told(stream, out, folder(spark, "scan-state"), [[(old, path)], [(new, path), (tick, path)]])
    return scan_counters(spark, out)


@query(f"WITH {CHANGED_SQL}")
def stream_single_changes(spark, d):
    """The same counters where only what changed is told, event by event."""
    own = stateful.stateful_session(spark)
    old, new, tick = scans(spark, d)
    keys = ["key", "signature"]
    lost = old.join(new, "key", "left_anti").withColumn("gone", F.lit(True)).withColumn("at", F.lit("2026-01-01 02:00:00").cast("timestamp"))
    path, out = folder(spark, "single"), folder(spark, "single-changes")
    stream = lambda: stateful.changes_of_paths(changes.snapshots(own, path, old.schema, PER_BATCH), "10 minutes")
    told(stream, out, folder(spark, "single-state"), [[(old, path)], [(lost.select(old.columns), path), (new.join(old, keys, "left_anti").select(old.columns), path), (tick, path)]])
    return scan_counters(spark, out)


@query("""SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id % 4 = 0 AND x.user_id = e.user_id AND e.ts >= x.ts AND e.ts <= x.ts + INTERVAL 3600 SECOND)""")
def stream_own_changes(spark, d):
    """Announcements on a stream, each written after the events that it concerns; events wait for them, and they are forgotten by event time."""
    own = stateful.stateful_session(spark)
    e = t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("path"), F.date_trunc("millisecond", "ts").alias("at"))
    first, last = e.agg(F.min("at"), F.max("at")).first()
    span, a, b, out = last - first, folder(spark, "own-events"), folder(spark, "own-said"), folder(spark, "others-changes")
    late = f"{int(span.total_seconds() * 0.6) + 7200} seconds"
    tick = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("string").alias("path"), F.lit(last + 4 * span).alias("at"))
    early = F.col("at") <= F.lit(first + span / 2)  # by time: no event of a half is later than `late`, in whatever order the half is read
    said = e.filter("event_id % 4 = 0").select("path", "at")
    stream = lambda: stateful.others_changes_stream(*(changes.snapshots(own, path, rows.schema, PER_BATCH) for path, rows in ((a, e), (b, said))), 3600, late)
    told(stream, out, folder(spark, "own-state"), [[(e.filter(early), a), (said.filter(early), b)], [(e.filter(~early), a), (said.filter(~early), b), (tick, a)]])
    return spark.read.schema("event_id long, path string, at timestamp").parquet(out).select("event_id")


def streamed(spark, d, at: str, table: str) -> DataFrame:
    path = folder(spark, at)
    t(spark, d, table).repartition(4).write.parquet(path)
    return changes.snapshots(spark, path, spark.read.parquet(path).schema, per_batch=4)


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives until its input ends, as a table in the shared folder."""
    spark = stream.sparkSession
    out = folder(spark, "stream")
    save = lambda rows, _: rows.write.mode("overwrite").parquet(out)  # noqa: E731  # complete mode: the last batch has all
    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    """T4: windows over a stream of files; the watermark is wider than the table, so nothing is late."""
    events = streamed(spark, d, "events", "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_end(changes.tumbling(events, "ts", "1 hour", "3650 days", ["event_type"]), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "events")


@query("SELECT 'Added' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT 'CacheHit', count(*) FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'Removed', count(*) FROM orders WHERE o_orderkey % 4 = 2")
def stream_snapshots(spark, d):
    """Snapshots that arrive in a folder are reconciled batch by batch."""
    o, path, out = t(spark, d, "orders"), folder(spark, "snapshots"), folder(spark, "changes")
    snapshot = lambda which: o.filter(which).select(F.col("o_orderkey").cast("string").alias("key"), F.concat_ws("|", "o_orderkey", "o_totalprice").alias("sig"), F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("ord")).coalesce(1)
    snapshot("o_orderkey % 2 = 0").write.parquet(path)
    known: dict[str, DataFrame] = {}

    def save(delta: DataFrame, new: DataFrame, batch: int) -> None:
        delta.write.mode("overwrite").parquet(f"{out}/{batch}")
        new.write.mode("overwrite").parquet(f"{out}-state/{batch}")
        known["last"] = spark.read.parquet(f"{out}-state/{batch}")

    progress, schema = folder(spark, "progress"), spark.read.parquet(path).schema
    go = lambda: changes.reconcile_stream(changes.snapshots(spark, path, schema), lambda: known.get("last"), save, "key", "sig", "name", "ord", progress).awaitTermination()
    go()
    snapshot("o_orderkey % 4 < 2").write.mode("append").parquet(path)
    go()
    return cdc.counters(spark.read.parquet(f"{out}/1")).withColumnRenamed("rows", "n")


# --- sources and sinks


@query("""SELECT CAST(c_custkey AS VARCHAR) AS gallery_id, 'a "quoted", ' || c_name AS artist_raw, 'line one' || chr(10) || c_mktsegment AS group_raw, '' AS japanese_title FROM customer WHERE c_custkey % 9 <> 0""")
def monthly_file(spark, d):
    """SRC1 SRC2: quotes, separators and line breaks within fields; ids that are no positive numbers apart; of repeated ids one."""
    path, c = folder(spark, "monthly"), t(spark, d, "customer")
    rows = c.select(F.when(F.col("c_custkey") % 9 == 0, "-5").otherwise(F.col("c_custkey").cast("string")).alias("\ufeffId"), F.concat(F.lit('a "quoted", '), "c_name").alias("artist"), F.concat(F.lit("line one\n"), "c_mktsegment").alias("group_name"))
    rows.unionByName(rows.filter(F.col("artist").endswith("7"))).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return readers.monthly_file(spark, path, "s", "f").select("gallery_id", "artist_raw", "group_raw", "japanese_title")


@query("SELECT c_name AS canonical, unnest([c_name, 'alias ' || c_custkey]) AS alias, unnest([0, 1]) AS position FROM customer WHERE c_custkey % 3 <> 0")
def legacy_alias_file(spark, d):
    """SRC10 SRC5: "name|alias" lines from a compressed file; comments and lines of one name apart; names that differ by form are one."""
    path, c = folder(spark, "aliases"), t(spark, d, "customer")
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.when(F.col("c_custkey") % 2 == 0, "# ").otherwise(""), "c_name")).otherwise(F.concat("c_name", F.lit(" | alias "), "c_custkey", F.lit("|"), F.upper("c_name")))
    c.select(line.alias("value")).write.option("compression", "gzip").text(path)
    lines = readers.prepared(spark, path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("v")).filter("v <> '' AND NOT startswith(v, '#')")
    return readers.alias_groups(lines).select("canonical", "alias", "position")


@query("SELECT n_regionkey AS folder, count(*) AS files FROM nation WHERE n_regionkey <> 4 GROUP BY 1")
def listing_of_files(spark, d):
    """SRC6: files of some extensions below a folder."""
    path = folder(spark, "tree")
    n = t(spark, d, "nation").select("n_regionkey", "n_name")
    n.filter("n_regionkey <> 4").repartition(F.col("n_name")).write.option("maxRecordsPerFile", 1).partitionBy("n_regionkey").csv(path)
    n.filter("n_regionkey = 4").write.mode("append").partitionBy("n_regionkey").json(path)
    found = readers.listing(spark, path, ["*.csv"])
    return found.groupBy(F.regexp_extract("path", r"n_regionkey=(\d+)/", 1).cast("int").alias("folder")).agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {URL_SQL}, q AS (SELECT page_id, 'web' || regexp_replace(path, '/[^/]*$', '') AS dir, CASE WHEN regexp_matches(path, '\\.[A-Za-z0-9_]{{1,20}}$') THEN lower(regexp_extract(path, '\\.([A-Za-z0-9_]{{1,20}})$', 1)) ELSE '' END AS ext FROM p) SELECT page_id FROM q WHERE (dir = 'web/en' OR starts_with(dir, 'web/en/')) AND ext IN ('html', '')")
def index_query(spark, d):
    """SRC7: an index of files asked for a folder and extensions; both conditions are the reader's."""
    u = urls(spark, d)
    index = u.select("page_id", F.concat(F.lit("web"), F.regexp_replace("path", r"/[^/]*$", "")).alias("directory"), rules.extension("path").alias("extension"))
    return readers.filtered_listing(index, "web/en", ["*.html", ""]).select("page_id")


@query("SELECT c_name || '.csv' AS path, lower(sha1(c_name)) AS sha, c_custkey AS size FROM customer WHERE c_nationkey < 12 AND c_custkey % 5 <> 0")
def source_manifest(spark, d):
    """SRC8."""
    c = t(spark, d, "customer").select(F.concat("c_name", F.when(F.col("c_nationkey") < 12, ".csv").otherwise(".txt")).alias("path"), F.when(F.col("c_custkey") % 5 == 0, "tree").otherwise("blob").alias("type"), F.upper(F.sha1("c_name")).alias("sha"), F.col("c_custkey").alias("size"))
    return readers.manifest(c, "Customer", ".csv")


@query("""SELECT 'aliases' AS list, 'reference' AS fault, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 10 = 3 OR c_custkey = 0 UNION ALL SELECT 'authors', 'id', '0' FROM customer WHERE c_custkey = 0
          UNION ALL SELECT 'circles', 'id', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey = 0 OR n_nationkey % 6 = 1 UNION ALL SELECT 'name_decisions', 'reference', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 4 = 2 AND CASE WHEN c_nationkey < 12 THEN c_custkey % 10 = 3 ELSE c_custkey >= 25 END
          UNION ALL SELECT 'public_overrides', 'id', 'o' || c_custkey FROM customer WHERE c_custkey % 9 = 4 UNION ALL SELECT 'public_overrides', 'list', 'o' || c_custkey FROM customer WHERE c_custkey % 9 = 4 AND c_custkey % 2 = 0
          UNION ALL SELECT DISTINCT 'public_overrides', 'reference', CAST(c_nationkey + 20 AS VARCHAR) FROM customer WHERE c_custkey % 9 = 4 AND c_nationkey + 20 >= 25
          UNION ALL SELECT 'legacy_alias_groups', 'name', 'g' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0""")
def library_checks(spark, d):
    """SRC9: all that forbids saving a library, which is written as JSON and read again."""
    path, c, n, s = folder(spark, "library"), t(spark, d, "customer"), t(spark, d, "nation"), t(spark, d, "supplier")
    k = F.col("c_custkey")
    one = lambda rows, into, **fields: rows.agg(F.collect_list(F.struct(*[v.alias(x) for x, v in fields.items()])).alias(into))
    twice = n.unionByName(n.filter("n_nationkey % 6 = 1"))
    names = F.array().cast("array<string>")
    o = c.filter(k % 9 == 4)
    parts = [
        one(c.filter(k % 10 != 3), "authors", id=k), one(twice, "circles", id=F.col("n_nationkey")), one(c, "aliases", author_id=k, alias=F.col("c_name")),
        one(c.filter(k % 4 == 2), "name_decisions", name=F.col("c_name"), entity_type=F.when(F.col("c_nationkey") < 12, "Artist").otherwise("Group"), entity_id=k, status=F.lit("Confirmed")),
        one(o.unionByName(o), "public_overrides", id=F.concat(F.lit("o"), k), added_aliases=names, disabled_names=names, original_names=F.when(k % 2 == 1, names), user_groups=F.array(F.struct((F.col("c_nationkey") + 20).alias("circle_id")))),
        one(s, "legacy_alias_groups", id=F.concat(F.lit("g"), "s_suppkey"), canonical=F.col("s_name"), names=F.array(F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name"))), author_id=F.lit(0)),
    ]
    whole = reduce(lambda a, b: a.join(b, F.lit(True)), parts)  # one row each: a library is one document
    whole.write.json(path)
    return readers.library_faults(readers.library(spark, path))


@query("SELECT 'aliases' AS list, c_custkey AS id FROM customer WHERE c_custkey % 10 = 3 UNION ALL SELECT 'author_circles', c_custkey FROM customer WHERE c_custkey % 10 = 3 UNION ALL SELECT 'author_circles', n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def library_references(spark, d):
    """SRC9: a user library written as JSON and read again, and what in it refers to nothing."""
    path, c, n = folder(spark, "library"), t(spark, d, "customer"), t(spark, d, "nation")
    author = c.filter("c_custkey % 10 <> 3").agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"))).alias("authors"))
    alias = c.agg(F.collect_list(F.struct(F.col("c_custkey").alias("author_id"), F.lower("c_name").alias("alias"))).alias("aliases"))
    circle = n.filter("n_regionkey <> 2").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("canonical_name"))).alias("circles"))
    both = c.agg(F.collect_list(F.struct(F.col("c_custkey").alias("author_id"), F.col("c_nationkey").alias("circle_id"))).alias("author_circles"))
    whole = reduce(lambda a, b: a.join(b, F.lit(True)), [author, alias, circle, both])  # one row each: a library is one document
    whole.withColumn("circle_aliases", F.from_json(F.lit("[]"), T.ArrayType(T.StructType([T.StructField("circle_id", T.LongType())])))).write.json(path)
    return readers.broken_references(readers.library(spark, path))


@query(r"SELECT page_id, list_aggregate(list_slice(list_distinct_in_order, 1, 25), 'string_agg', '|') AS ids FROM (SELECT page_id, ['1' || page_id || '/ab' || page_id, '2' || page_id || '/cd'] AS list_distinct_in_order FROM pages)")
def page_ids(spark, d):
    """SRC13: distinct (id, token) pairs of a page's links, in order."""
    i = F.col("page_id").cast("string")
    html = F.concat(F.lit('<a href="/g/1'), i, F.lit("/AB"), i, F.lit('/">x</a> /g/x/1 <a href="/g/2'), i, F.lit('/cd">'), F.lit('<a href="/g/1'), i, F.lit("/ab"), i, F.lit('">'))
    return t(spark, d, "pages").select("page_id", F.array_join(readers.gallery_ids(html), "|").alias("ids"))


@query('''SELECT 0 AS "at", chr(65279) || '"session","files"' AS line UNION ALL SELECT 1, '"s ""1""","' || count(*) || '"' FROM nation UNION ALL SELECT 2, '' UNION ALL SELECT 3, '"name","region"'
          UNION ALL SELECT 3 + row_number() OVER (ORDER BY n_name), '"' || n_name || '","' || n_regionkey || '"' FROM nation''')
def history_block(spark, d):
    """SNK1: a session's header, then its items, as one quoted block."""
    n = t(spark, d, "nation")
    session = n.agg(F.lit('s "1"').alias("session"), F.count(F.lit(1)).alias("files"))
    return writers.session_block(session, n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), ["name"])


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 2 = 0")
def replaced_table(spark, d):
    """SNK2: a batch is staged and takes the old one's place as a whole."""
    path, o = folder(spark, "table"), t(spark, d, "orders").select("o_orderkey")
    writers.replace_whole(o, path)
    writers.replace_whole(o.filter("o_orderkey % 2 = 0"), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT count(*) AS n, false AS stale_taken FROM orders WHERE o_orderkey % 2 = 0")
def staged_version(spark, d):
    """SNK3: a staged version becomes current if what it was built on is; one built on an older version doesn't."""
    base, o = folder(spark, "versions"), t(spark, d, "orders").select("o_orderkey")
    writers.stage(o, base, None)
    first = writers.activate(spark, base, None)
    writers.stage(o.filter("o_orderkey % 2 = 0"), base, first)
    second = writers.activate(spark, base, first)
    writers.stage(o.limit(0), base, first)
    third = writers.activate(spark, base, second)
    return spark.read.parquet(f"{base}/{third}").agg(F.count(F.lit(1)).alias("n"), F.lit(third != second).alias("stale_taken"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING (' || s_name || ')' ELSE s_name END AS folder, s_name AS author FROM supplier""")
def author_folders(spark, d):
    """authors back from folders' names, by the template that fits best."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("BUILDING ("), "s_name", F.lit(")"))).otherwise(F.col("s_name")).alias("folder"))
    return s.withColumn("author", naming.author_of_folder(F.col("folder"), ["BUILDING ({author})"]))
