"""The named queries: each applies library operators to the given tables, and has the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import grammar, naming, rules, text
from .operators import cdc, kb, resolve, scoring
from .plans import planning, report
from .sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- evidence and knowledge base


def work_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as works, months of shipping as files, return flags as sources, suppliers as artists, brands as groups."""
    li = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("source_id"), F.col("l_orderkey").alias("gallery_id"), F.date_format("l_shipdate", "yyyy-MM").alias("source_file"), "l_suppkey", "l_partkey")
    return li.join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")


WORK_SQL = """w AS (SELECT l_returnflag AS source_id, l_orderkey AS gallery_id, strftime(l_shipdate, '%Y-%m') AS source_file, l_suppkey, l_partkey, p_brand
                 FROM lineitem JOIN part ON p_partkey = l_partkey),
             n AS (SELECT source_id, gallery_id, max(source_file) AS source_file FROM w GROUP BY 1, 2),
             c AS (SELECT w.* FROM w JOIN n USING (source_id, gallery_id, source_file))"""


def weights(rows: DataFrame) -> DataFrame:
    return kb.newest_pairs(rows, "source_id", "gallery_id", "source_file", "l_suppkey", "p_brand")


@query(f"""WITH {WORK_SQL}, p AS (SELECT a.source_id, a.l_suppkey, b.p_brand, count(DISTINCT a.gallery_id) AS weight
             FROM c a JOIN c b ON a.source_id = b.source_id AND a.gallery_id = b.gallery_id GROUP BY 1, 2, 3)
           SELECT l_suppkey, p_brand, max(weight) AS weight FROM p GROUP BY 1, 2""")
def pair_weights(spark, d):
    """J3 J4 A2 A3."""
    return kb.max_weights(weights(work_rows(spark, d)), "l_suppkey", "p_brand")


@query(f"""WITH {WORK_SQL}, p AS (SELECT a.source_id, a.l_suppkey, b.p_brand, count(DISTINCT a.gallery_id) AS weight
             FROM c a JOIN c b ON a.source_id = b.source_id AND a.gallery_id = b.gallery_id WHERE a.source_id <> 'A' GROUP BY 1, 2, 3)
           SELECT l_suppkey, p_brand, max(weight) AS weight FROM p GROUP BY 1, 2""")
def kb_withdraw_rebuild(spark, d):
    """A source is withdrawn and the relations are built anew."""
    return kb.max_weights(weights(work_rows(spark, d).filter("source_id <> 'A'")), "l_suppkey", "p_brand")


def evidence(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = work_rows(spark, d)
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    rows = rows.join(s, "l_suppkey")
    side = lambda kind, c: rows.select("source_id", "source_file", "gallery_id", F.lit(kind).alias("entity_type"), F.col(c).alias("name"), F.lower(c).alias("normalized_name"), F.lit("").alias("pretty_name"))
    return side("Artist", "s_name").unionByName(side("Group", "p_brand")), rows.select("source_id", "gallery_id", "source_file")


INCOMING_SQL = f"""{WORK_SQL}, e AS (SELECT source_id, gallery_id, 'Artist' AS kind, s_name AS name FROM c JOIN supplier ON s_suppkey = l_suppkey
                               UNION ALL SELECT source_id, gallery_id, 'Group', p_brand FROM c),
             i AS (SELECT source_id, kind, lower(name) AS norm, min(name) AS name, count(DISTINCT gallery_id) AS works FROM e GROUP BY 1, 2, 3)"""


@query(f"WITH {INCOMING_SQL} SELECT source_id, kind, norm, name, works, 'Archive:' || source_id AS provider FROM i")
def kb_incoming(spark, d):
    """M2 A1."""
    return kb.incoming(*evidence(spark, d)).select("source_id", "kind", "norm", "name", "works", "provider")


def base_identities(spark, d) -> tuple[DataFrame, DataFrame]:
    s = t(spark, d, "supplier").select("s_suppkey", F.lower("s_name").alias("norm"))
    row = lambda rows, provider, add: rows.select(F.lit(provider).alias("provider"), F.lit("Artist").alias("kind"), "norm", (F.col("s_suppkey") + add).alias("entity_id"))
    identity = row(s.filter("s_suppkey % 2 = 0"), "Archive:A", 0).unionByName(row(s.filter("s_suppkey % 4 = 0"), "Archive:R", 1_000_000))
    entity = s.filter("s_suppkey % 6 = 1").select((F.col("s_suppkey") + 2_000_000).alias("id"), F.lit("Artist").alias("kind"), F.concat(F.lit("archive:N:artist:"), "norm").alias("external_id"))
    return identity, entity


ASSIGN_SQL = f"""{INCOMING_SQL}, b AS (SELECT 'A' AS src, lower(s_name) AS norm, s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0
                                 UNION ALL SELECT 'R', lower(s_name), s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 4 = 0),
             h AS (SELECT norm, count(DISTINCT id) AS holders FROM b GROUP BY 1),
             x AS (SELECT lower(s_name) AS norm, s_suppkey + 2000000 AS id FROM supplier WHERE s_suppkey % 6 = 1),
             g AS (SELECT i.source_id, i.kind, i.norm, b.id AS own, x.id AS ext, b.id IS NULL AND coalesce(h.holders, 0) > 1 AS conflict
                   FROM i LEFT JOIN b ON i.kind = 'Artist' AND b.src = i.source_id AND b.norm = i.norm
                          LEFT JOIN h ON i.kind = 'Artist' AND h.norm = i.norm LEFT JOIN x ON i.kind = 'Artist' AND i.source_id = 'N' AND x.norm = i.norm)"""


@query(f"WITH {ASSIGN_SQL} SELECT source_id, kind, norm, coalesce(own, CASE WHEN NOT conflict THEN ext END) AS entity_id, conflict FROM g")
def kb_assign_conflicts(spark, d):
    """M3-M9 A4 A5."""
    identity, entity = base_identities(spark, d)
    rows = kb.incoming(*evidence(spark, d))
    base = kb.Kb(entity, identity, identity, identity)
    return kb.assigned(base, rows).select("source_id", "kind", "norm", "entity_id", "conflict")


@query(f"WITH {ASSIGN_SQL}, a AS (SELECT kind, norm, coalesce(own, CASE WHEN NOT conflict THEN ext END) AS id FROM g) SELECT kind, norm, count(DISTINCT id) AS entities FROM a WHERE id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT id) > 1")
def kb_ambiguous_names(spark, d):
    """M9 A4."""
    return kb.ambiguous(kb_assign_conflicts(spark, d).filter("entity_id IS NOT NULL"), ["kind", "norm"], "entity_id")


@query("""WITH r AS (SELECT l_suppkey AS id, count(DISTINCT l_orderkey) AS works FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
          SELECT lower(s_name) AS norm, s_suppkey AS entity_id, greatest(CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey * 20 ELSE 0 END, coalesce(works, 0)) AS works
          FROM supplier LEFT JOIN r ON r.id = s_suppkey WHERE s_suppkey % 3 = 0 OR works IS NOT NULL""")
def kb_upsert_identity(spark, d):
    """M10 J13."""
    s = t(spark, d, "supplier").select("s_suppkey", F.lower("s_name").alias("norm"), (F.col("s_nationkey") * 20).cast("long").alias("works"))
    target = s.filter("s_suppkey % 3 = 0").select("norm", F.col("s_suppkey").alias("entity_id"), "works")
    found = t(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_orderkey").alias("works"))
    return kb.upsert_max(target, found.join(s.drop("works"), "s_suppkey").select("norm", F.col("s_suppkey").alias("entity_id"), "works"), ["norm", "entity_id"], "works")


@query("""WITH a AS (SELECT p_partkey AS entity_id, lower(p_name) AS norm, 'name' AS alias_type FROM part WHERE p_partkey % 2 = 0),
               b AS (SELECT p_partkey AS entity_id, lower(p_brand) AS norm, 'brand' AS alias_type FROM part UNION ALL SELECT p_partkey, lower(p_name), 'brand' FROM part)
          SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.entity_id = b.entity_id AND a.norm = b.norm)""")
def kb_alias_union(spark, d):
    """M11 J12 O6."""
    p = t(spark, d, "part")
    row = lambda c, kind: p.select(F.col("p_partkey").alias("entity_id"), F.lower(c).alias("norm"), F.lit(kind).alias("alias_type"))
    return kb.insert_ignore(row("p_name", "name").filter("entity_id % 2 = 0"), row("p_brand", "brand").unionByName(row("p_name", "brand")).distinct(), ["entity_id", "norm"])


@query("""SELECT 'lineitem-orders' AS relation, count(*) AS missing FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3)
          UNION ALL SELECT 'orders-customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 7)
          UNION ALL SELECT 'lineitem-part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
          UNION ALL SELECT 'lineitem-supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""")
def kb_integrity(spark, d):
    """Children without a parent, where some parents were taken away."""
    li, o, c, p, s = (t(spark, d, x) for x in ("lineitem", "orders", "customer", "part", "supplier"))
    checks = (
        ("lineitem-orders", li, o.filter("o_orderkey % 10 <> 3"), "l_orderkey", "o_orderkey"),
        ("orders-customer", o, c.filter("c_custkey % 50 <> 7"), "o_custkey", "c_custkey"),
        ("lineitem-part", li, p, "l_partkey", "p_partkey"),
        ("lineitem-supplier", li, s, "l_suppkey", "s_suppkey"),
    )
    out = None
    for name, child, parent, key, parent_key in checks:
        one = kb.dangling(child.select(key), parent, key, parent_key).agg(F.count(F.lit(1)).alias("missing")).select(F.lit(name).alias("relation"), "missing")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT c_custkey AS id, c_name AS name, 0 AS source_rank FROM customer WHERE contains(lower(c_name), '7')
          UNION ALL SELECT * FROM (SELECT s_suppkey AS id, s_name AS name, 1 AS source_rank FROM supplier ORDER BY s_name, s_suppkey LIMIT 25 OFFSET 10)""")
def listing_union_page(spark, d):
    """J25 O11 O2."""
    user = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    public = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return report.listing_union(report.text_search(user, "7", ["name"]), public, ["name", "id"], 10, 25)


@query("""SELECT c_mktsegment AS segment, count(*) AS n, CAST(greatest(1, ceil(count(*) / 40.0)) AS BIGINT) AS pages FROM customer GROUP BY 1""")
def page_counts(spark, d):
    """A20."""
    return t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n")).withColumn("pages", report.pages(F.col("n"), 40))


@query("""SELECT lang AS kind, count(*) AS "rows", CAST(sum(CASE WHEN strlen(text) > length(text) THEN 1 ELSE 0 END) AS BIGINT) AS non_ascii FROM documents GROUP BY 1""")
def kb_profile(spark, d):
    """A8 F31."""
    return kb.profile(t(spark, d, "documents").withColumnRenamed("lang", "kind"), "kind", "text")


@query("""WITH e AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Group' ELSE 'Artist' END AS kind, p_name AS canonical_name, lower(p_name) AS norm FROM part),
               m AS (SELECT id FROM e WHERE norm LIKE '%wid_et%' UNION SELECT p_partkey FROM part WHERE p_size = 7 AND 'b' || lower(p_type) || ' widget' LIKE '%wid_et%' UNION SELECT p_partkey FROM part WHERE p_size = 9 AND 'widxet ' || p_brand LIKE '%wid_et%')
          SELECT e.id, kind, canonical_name FROM m JOIN e ON e.id = m.id ORDER BY kind, canonical_name, e.id LIMIT 40 OFFSET 5""")
def kb_search_page(spark, d):
    """By names, aliases and providers' tags; the text is normalised, and has a wildcard."""
    p = t(spark, d, "part")
    entity = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "Group").otherwise("Artist").alias("kind"), F.col("p_name").alias("canonical_name"), F.lower("p_name").alias("norm"))
    alias = p.filter("p_size = 7").select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("b"), F.lower("p_type"), F.lit(" widget")).alias("norm"))
    identity = p.filter("p_size = 9").select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("widxet "), "p_brand").alias("norm"))
    return kb.searched(entity, alias, " ＷＩＤ_ＥＴ", 5, 40, identity).drop("norm")


@query("""SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types FROM part GROUP BY 1""")
def kb_listed(spark, d):
    """A16 A17."""
    return kb.listed(t(spark, d, "part"), ["p_brand"], "p_type", "types")


@query("""SELECT o_custkey AS entity_id, min(o_orderpriority || ':' || o_orderstatus || ':' || CAST(o_orderkey AS VARCHAR)) AS key FROM orders GROUP BY 1""")
def kb_stable_keys(spark, d):
    """A18."""
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").cast("string").alias("norm"))
    return kb.stable_keys(o)


# --- names


@query(r"""SELECT c_custkey AS id, '[' || replace(lower(c_name), '#', '(') || ')]' AS norm, lower(c_name) AS without_stop FROM customer""")
def norm_name(spark, d):
    """Brackets of another width, spaces around them, one closer missing."""
    c = t(spark, d, "customer")
    raw = F.concat(F.lit("  【 "), F.replace("c_name", F.lit("#"), F.lit(" （ ")), F.lit(" ) "))
    return c.select(F.col("c_custkey").alias("id"), text.normalize(raw, compat=False).alias("norm"), text.without_full_stop(F.concat("c_name", F.lit(" .")), compat=False).alias("without_stop"))


@query("""SELECT p_partkey, p_brand AS society, unnest([p_type, p_name]) AS creator, unnest([0, 1]) AS position FROM part""")
def structured_parts(spark, d):
    """F7 F10."""
    p = t(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("+ ("), "p_type", F.lit(" ， "), "p_name", F.lit(", "), F.lower("p_type")).alias("name"))
    return grammar.exploded_parts(p, "name").drop("name")


TAG_RULES = [rules.Rule("urgent", rules.CONTAINS, "urgent"), rules.Rule("econ", rules.EXACT, "economy"), rules.Rule("level", rules.REGEX, r"^[45]-")]


@query("""SELECT tag, regexp_matches(lower(tag), 'urgent') OR lower(tag) = 'economy' OR regexp_matches(tag, '^[45]-') AS metadata, count(*) AS n
          FROM (SELECT o_orderpriority AS tag FROM orders UNION ALL SELECT p_type FROM part UNION ALL SELECT event_type FROM events) GROUP BY 1, 2""")
def tag_cleaning(spark, d):
    """F13 F14 U1."""
    tags = t(spark, d, "orders").select(F.col("o_orderpriority").alias("tag")).unionByName(t(spark, d, "part").select(F.col("p_type").alias("tag"))).unionByName(t(spark, d, "events").select(F.col("event_type").alias("tag")))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("metadata", rules.is_metadata_tag("tag", TAG_RULES, compat=False))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '(C' || (70 + o_orderkey % 30) || ') [' || c_mktsegment || ' (' || c_name || ')] work' WHEN 1 THEN '[' || c_name || '] [Chinese] work' ELSE '(' || c_name || ') work' END AS name,
                 CASE o_orderkey % 3 WHEN 0 THEN c_mktsegment || ' (' || c_name || ')' ELSE c_name END AS candidates FROM orders JOIN customer ON c_custkey = o_custkey""")
def filename_candidates(spark, d):
    """Names made of orders, nearly all distinct, so the grammar runs on rows as they lie."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("(C"), 70 + F.col("o_orderkey") % 30, F.lit(") ["), "c_mktsegment", F.lit(" ("), "c_name", F.lit(")] work"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("["), "c_name", F.lit("] [Chinese] work"))).otherwise(F.concat(F.lit("("), "c_name", F.lit(") work")))
    return o.select("o_orderkey", name.alias("name")).select("o_orderkey", "name", F.array_join(grammar.candidates_udf()("name"), "|").alias("candidates"))


@query("""SELECT lower(o_orderpriority) AS prefix, count(DISTINCT (lower(c_mktsegment), CAST(c_nationkey AS VARCHAR))) AS pairs
          FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(DISTINCT (lower(c_mktsegment), CAST(c_nationkey AS VARCHAR))) >= 3""")
def event_discovery(spark, d):
    """A7."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return grammar.event_prefixes(o.select(F.col("o_orderpriority").alias("prefix"), F.col("c_mktsegment").alias("society"), F.col("c_nationkey").cast("string").alias("creators")))


@query("""SELECT s_suppkey, 'Group ' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS folder, s_suppkey AS number, replace(s_name, '#', '') || '＊' AS author
          FROM supplier WHERE s_suppkey > 0""")
def folder_names(spark, d):
    """F21 F22."""
    s = t(spark, d, "supplier").filter("s_suppkey > 0").select("s_suppkey", naming.group_name("Group {n3}", F.col("s_suppkey")).alias("folder"), F.concat(F.replace("s_name", F.lit("#"), F.lit("")), F.lit("* .")).alias("raw"))
    return s.select("s_suppkey", "folder", naming.group_number("Group {n3}", F.col("folder")).cast("long").alias("number"), F.regexp_replace(naming.author_folder("{author}", F.col("raw")), " $", "").alias("author"))


URL_RULES = [rules.Rule("spam", rules.CONTAINS, "spam"), rules.Rule("blog", rules.STARTS, "blog."), rules.Rule("org", rules.ENDS, ".org"), rules.Rule("shop", rules.REGEX, r"cheap|casino")]
URL_SQL = "p AS (SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '') AS host, coalesce(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)"


def urls(spark, d) -> DataFrame:
    u = F.coalesce("url", F.lit(""))
    return t(spark, d, "pages").select("page_id", F.regexp_extract(u, r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract(u, r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


@query(f"""WITH {URL_SQL} SELECT page_id, CASE WHEN contains(host, 'spam') THEN 'spam' WHEN starts_with(host, 'blog.') THEN 'blog' WHEN ends_with(host, '.org') THEN 'org'
           WHEN regexp_matches(host, 'cheap|casino') THEN 'shop' END AS rule FROM p""")
def exclusion_first_match(spark, d):
    """P1 U2."""
    return urls(spark, d).select("page_id", rules.first_hit(F.col("host"), URL_RULES).alias("rule"))


@query(f"""WITH {URL_SQL}, f AS (SELECT page_id, list_filter(string_split(host || '/' || path, '/'), lambda x: x <> '') AS parts FROM p),
           e AS (SELECT page_id, unnest(parts[1:len(parts) - 1]) AS part, unnest(range(1, len(parts))) AS depth FROM f WHERE len(parts) > 1),
           h AS (SELECT page_id, depth, CASE WHEN lower(part) = 'en' THEN 'english' WHEN contains(lower(part), 'example.org') THEN 'org' WHEN contains(lower(part), 'spam') THEN 'spam' END AS rule FROM e),
           r AS (SELECT page_id, arg_max(rule, depth) AS rule FROM h WHERE rule IS NOT NULL GROUP BY 1)
           SELECT p.page_id, r.rule FROM p LEFT JOIN r ON p.page_id = r.page_id""")
def exclusion_ancestors(spark, d):
    """P2."""
    own = [rules.Rule("english", rules.EXACT, "en"), rules.Rule("org", rules.CONTAINS, "example.org"), rules.Rule("spam", rules.CONTAINS, "spam")]
    u = urls(spark, d).select("page_id", F.concat(F.lit("root/"), "host", F.lit("/"), "path").alias("full"), F.lit("root").alias("root"))
    return rules.folder_hit(u, "full", "root", own).select("page_id", "rule")


@query(f"""WITH {URL_SQL}, q AS (SELECT page_id, upper(regexp_replace(path, '/+$', '')) AS p, upper(regexp_replace(regexp_replace(path, '/+$', ''), '/[^/]*$', '')) AS dir FROM p)
           SELECT page_id, dir = '/EN' OR starts_with(dir, '/EN/') AS deep, dir = '/EN' AS shallow FROM q""")
def scope_projection(spark, d):
    """P5 F29."""
    directory = F.regexp_replace(F.regexp_replace("path", r"/+$", ""), r"/[^/]*$", "")
    u = urls(spark, d)
    return u.select("page_id", rules.in_scope(directory, F.lit("/en"), True).alias("deep"), rules.in_scope(directory, F.lit("/en"), False).alias("shallow"))


# --- resolution


def candidate_names(spark, d) -> DataFrame:
    c = t(spark, d, "customer")
    return c.select("c_custkey", text.normalize(F.concat(F.lit(" 【"), "c_name", F.lit("】")), compat=False).alias("whole"), text.normalize("c_name", compat=False).alias("norm"), F.regexp_replace("c_name", "^Customer#0*", "").alias("digits"), "c_nationkey")


@query("""WITH c AS (SELECT c_custkey, lower(c_name) AS norm, regexp_replace(c_name, '^Customer#0*', '') AS digits FROM customer),
               s AS (SELECT s_suppkey, lower(s_name) AS norm, regexp_replace(s_name, '^Supplier#0*', '') AS digits, s_nationkey FROM supplier),
               l AS (SELECT c_custkey, 1 AS stage, c_custkey AS target FROM c WHERE c_custkey % 5 = 0
                     UNION ALL SELECT c.c_custkey, 2, s_suppkey + 1000000 FROM c JOIN s ON c.digits = s.digits
                     UNION ALL SELECT c_custkey, 3, s_suppkey + 2000000 FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey % 7 = 0),
               f AS (SELECT c_custkey, min(stage) AS stage FROM l GROUP BY 1)
          SELECT l.c_custkey, l.stage, CASE WHEN count(DISTINCT target) = 1 THEN 'Matched' WHEN l.stage = 3 THEN 'Ambiguous' ELSE 'Choice' END AS status,
                 CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target, count(DISTINCT target) AS targets
          FROM l JOIN f ON l.c_custkey = f.c_custkey AND l.stage = f.stage GROUP BY 1, 2""")
def resolve_cascade(spark, d):
    """Whole names, then numbers, then nations."""
    c = candidate_names(spark, d)
    s = t(spark, d, "supplier").select("s_suppkey", F.regexp_replace("s_name", "^Supplier#0*", "").alias("norm"), F.col("s_nationkey").cast("string").alias("nation"))
    folders = t(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("target"), text.normalize("c_name", compat=False).alias("norm"))
    one = resolve.reached(c.select("c_custkey", F.regexp_replace("whole", r"^\[|\]$", "").alias("norm")), folders, "c_custkey", "target")
    two = resolve.reached(c.select("c_custkey", F.col("digits").alias("norm")), s.select((F.col("s_suppkey") + 1_000_000).alias("target"), "norm"), "c_custkey", "target")
    three = resolve.reached(c.select("c_custkey", F.col("c_nationkey").cast("string").alias("norm")), s.filter("s_suppkey % 7 = 0").select((F.col("s_suppkey") + 2_000_000).alias("target"), F.col("nation").alias("norm")), "c_custkey", "target")
    return resolve.first_stage([(one, "Choice"), (two, "Choice"), (three, "Ambiguous")], "c_custkey", "target")


@query("""WITH q AS (SELECT o_orderkey AS id, c_nationkey AS society, o_custkey % 40 AS creator FROM orders JOIN customer ON c_custkey = o_custkey),
               h AS (SELECT DISTINCT q.id, s_suppkey AS artist_id FROM q JOIN supplier ON s_nationkey = q.society AND s_suppkey % 40 = q.creator)
          SELECT id, CASE WHEN count(*) = 1 THEN 'Matched' ELSE 'Ambiguous' END AS status, CASE WHEN count(*) = 1 THEN min(artist_id) END AS artist_id FROM h GROUP BY 1""")
def resolve_structured(spark, d):
    """Nations are societies, suppliers their creators."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    q = o.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("string").alias("society"), (F.col("o_custkey") % 40).cast("string").alias("creator"))
    s = t(spark, d, "supplier")
    groups = s.select(F.col("s_nationkey").cast("string").alias("norm"), F.col("s_nationkey").alias("group_id")).distinct()
    artists = s.select((F.col("s_suppkey") % 40).cast("string").alias("norm"), F.col("s_suppkey").alias("artist_id"))
    return resolve.structured_entities(q, groups, artists, s.select(F.col("s_suppkey").alias("artist_id"), F.col("s_nationkey").alias("group_id")), "id", s.select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("alias")))


@query("""WITH n AS (SELECT DISTINCT c_mktsegment AS kind, CAST(c_custkey % 300 AS VARCHAR) AS norm FROM customer),
               h AS (SELECT c_mktsegment AS kind, CAST(c_custkey % 300 AS VARCHAR) AS norm, count(DISTINCT c_custkey) AS n, min(c_custkey) AS e,
                            count(DISTINCT CASE WHEN c_nationkey = 3 THEN c_custkey END) AS cn, min(CASE WHEN c_nationkey = 3 THEN c_custkey END) AS ce FROM customer GROUP BY 1, 2),
               x AS (SELECT kind, norm, CAST(norm AS BIGINT) % 4 AS m FROM n WHERE CAST(norm AS BIGINT) % 3 = 0)
          SELECT n.kind, n.norm, CASE WHEN m = 0 THEN 'Matched' WHEN m = 1 THEN 'NotFound' WHEN m IN (2, 3) THEN 'Ambiguous' WHEN n = 1 OR cn = 1 THEN 'Matched' ELSE 'Ambiguous' END AS status,
                 CASE WHEN m = 0 THEN 7 WHEN m IS NOT NULL THEN NULL WHEN n = 1 THEN e WHEN cn = 1 THEN ce END AS entity_id
          FROM n JOIN h ON n.kind = h.kind AND n.norm = h.norm LEFT JOIN x ON x.kind = n.kind AND x.norm = n.norm""")
def resolve_decisions(spark, d):
    """What people decided about names comes before what holds them."""
    c = t(spark, d, "customer").select(F.col("c_mktsegment").alias("kind"), (F.col("c_custkey") % 300).cast("string").alias("norm"), F.col("c_custkey").alias("entity_id"), (F.col("c_nationkey") == 3).alias("user_confirmed"))
    names = c.select("kind", "norm").distinct()
    m = F.col("norm").cast("long") % 4
    decisions = names.filter(F.col("norm").cast("long") % 3 == 0).select("kind", "norm", F.lit(7).cast("long").alias("entity_id"), F.when(m == 0, "Confirmed").when(m == 1, "Disabled").when(m == 2, "Pending").otherwise("Independent").alias("decision"))
    return resolve.decided_names(names, c, decisions)


@query("""WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS id, right(c_name, 6) AS norm FROM customer), u AS (SELECT s_suppkey AS id, right(s_name, 6) AS norm FROM supplier),
               a AS (SELECT norm, count(DISTINCT id) AS n, min(id) AS i FROM p GROUP BY 1), b AS (SELECT norm, count(DISTINCT id + 1) AS n, min(id + 1) AS i FROM u GROUP BY 1)
          SELECT 'Artist' AS kind, a.norm, a.n AS public_ids, b.n AS user_ids FROM a JOIN b ON a.norm = b.norm WHERE a.n > 1 OR b.n > 1 OR a.i <> b.i""")
def name_conflicts(spark, d):
    """A9 J23."""
    p = t(spark, d, "customer").select(F.lit("Artist").alias("kind"), F.right("c_name", F.lit(6)).alias("norm"), F.col("c_custkey").alias("entity_id"))
    u = t(spark, d, "supplier").select(F.lit("Artist").alias("kind"), F.right("s_name", F.lit(6)).alias("norm"), (F.col("s_suppkey") + 1).alias("entity_id"))
    return resolve.name_conflicts(p, u)


@query("""WITH w AS (SELECT o_custkey AS artist_id, c_nationkey AS group_id, count(*) AS weight FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
          SELECT artist_id, group_id, weight, n_name AS group_name FROM w JOIN nation ON n_nationkey = group_id""")
def related_groups(spark, d):
    """J6."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    w = o.groupBy(F.col("o_custkey").alias("artist_id"), F.col("c_nationkey").alias("group_id")).agg(F.count(F.lit(1)).alias("weight"))
    return kb.related_groups(w, t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("canonical_name")))


@query("""WITH w AS (SELECT l_returnflag AS source_id, count(DISTINCT l_orderkey) AS works, count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS files,
                            count(DISTINCT s_name) AS a, count(DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN s_name END) AS ra, count(DISTINCT p_brand) AS g
                     FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1)
          SELECT source_id, works, files, a + g AS names, ra AS resolved FROM w""")
def evidence_counts(spark, d):
    """A6."""
    e, w = evidence(spark, d)
    even = (F.col("entity_type") == "Artist") & (F.regexp_extract("name", r"(\d)$", 1).cast("int") % 2 == 0)
    return kb.evidence_counts(e.withColumn("status", F.when(even, "Matched").otherwise("Candidate")), w)


@query("""WITH h AS (SELECT o_orderkey % 3000 AS id, c_custkey AS e FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 6 GROUP BY 1, 2),
               k AS (SELECT DISTINCT o_orderkey % 3000 AS id FROM orders), n AS (SELECT id, count(*) AS n, min(e) AS e FROM h GROUP BY 1)
          SELECT k.id, CASE WHEN n = 1 THEN 'Matched' WHEN n > 1 THEN 'Ambiguous' ELSE 'NotFound' END AS status, CASE WHEN n = 1 THEN e END AS entity_id FROM k LEFT JOIN n ON n.id = k.id""")
def resolve_public(spark, d):
    """E12 O4 O6."""
    names = t(spark, d, "orders").select((F.col("o_orderkey") % 3000).alias("id"), F.col("o_custkey").cast("string").alias("norm"))
    holders = t(spark, d, "customer").filter("c_nationkey < 6").select(F.col("c_custkey").cast("string").alias("norm"), F.col("c_custkey").alias("entity_id"))
    return resolve.public(names, holders, "id")


@query("""WITH g AS (SELECT DISTINCT c_mktsegment AS canonical, CAST(c_custkey % 400 AS VARCHAR) AS norm FROM customer),
               n AS (SELECT c_custkey, CAST(c_custkey % 400 AS VARCHAR) AS norm FROM customer), f AS (SELECT s_suppkey AS target, CASE WHEN s_nationkey < 3 THEN 'BUILDING' WHEN s_suppkey = 1 THEN 'FURNITURE' END AS canonical FROM supplier),
               o AS (SELECT c_custkey, count(DISTINCT canonical) AS g, min(canonical) AS canonical FROM n JOIN g ON g.norm = n.norm GROUP BY 1),
               h AS (SELECT c_custkey, g, count(DISTINCT target) AS k, min(target) AS t FROM o LEFT JOIN f ON f.canonical = o.canonical GROUP BY 1, 2)
          SELECT c_custkey, CASE WHEN g > 1 THEN 'Ambiguous' WHEN k = 1 THEN 'Matched' WHEN k > 1 THEN 'Choice' ELSE 'NotFound' END AS status, CASE WHEN g = 1 AND k = 1 THEN t END AS target FROM h""")
def resolve_alias_groups(spark, d):
    """E2."""
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    norm = (F.col("c_custkey") % 400).cast("string").alias("norm")
    groups = c.select(F.col("c_mktsegment").alias("canonical"), norm).distinct()
    folders = s.select(F.col("s_suppkey").alias("target"), F.when(F.col("s_nationkey") < 3, "BUILDING").when(F.col("s_suppkey") == 1, "FURNITURE").alias("canonical")).filter("canonical IS NOT NULL")
    return resolve.by_alias_group(c.select("c_custkey", norm), groups, folders, "c_custkey", "target")


# --- scores

NAMES_SQL = """n AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT replace(name, 'o', '0') AS file, name FROM n),
               g AS (SELECT DISTINCT name, substr(replace(name, ' ', ''), CAST(unnest(range(1, length(replace(name, ' ', '')))) AS BIGINT), 2) AS gram FROM n),
               f AS (SELECT DISTINCT file, substr(replace(file, ' ', ''), CAST(unnest(range(1, length(replace(file, ' ', '')))) AS BIGINT), 2) AS gram FROM a),
               h AS (SELECT f.file, g.name AS folder, count(*) AS hits FROM f JOIN g ON f.gram = g.gram GROUP BY 1, 2),
               k AS (SELECT file, folder, hits FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY hits DESC, lower(folder), folder) AS r FROM h) WHERE r <= 24)"""


def blocks(spark, d) -> DataFrame:
    n = t(spark, d, "part").select("p_name").distinct()
    left = n.select(F.replace("p_name", F.lit("o"), F.lit("0")).alias("file")).withColumn("file_name", F.col("file"))
    right = n.select(F.col("p_name").alias("folder")).withColumn("folder_name", F.col("folder"))
    return scoring.blocked(left, right, "file", "file_name", "folder", "folder_name")


@query(f"WITH {NAMES_SQL} SELECT file, folder, hits FROM k")
def blocking_top24(spark, d):
    """F18 J17."""
    return blocks(spark, d)


#: By the statement: a name of three or more in or around the region; a distance of exactly 1 or 2; no more than 40 for names of two.
FUZZY_SQL = f"""{NAMES_SQL}, z AS (SELECT file, folder, length(folder) AS n, least(length(file), length(folder)) AS lo, greatest(length(file), length(folder)) AS hi, levenshtein(file, folder) AS dist,
                     (contains(file, folder) OR contains(folder, file)) AS inside FROM k),
               s AS (SELECT file, folder, CASE WHEN n <= 2 THEN least(40, v) ELSE v END AS score
                     FROM (SELECT *, greatest(CASE WHEN n >= 3 AND inside AND lo >= 3 AND lo * 100 // hi >= 60 THEN 40 ELSE 0 END, CASE WHEN dist = 1 AND n >= 4 THEN 70 WHEN dist = 2 AND n >= 6 THEN 55 ELSE 0 END) AS v FROM z))"""


@query(f"WITH {FUZZY_SQL} SELECT file, folder, score FROM s")
def fuzzy_score(spark, d):
    """F17 E16 J19."""
    return blocks(spark, d).select("file", "folder", scoring.fuzzy_score(F.array("file"), F.col("folder")).alias("score"))


@query(f"""WITH {FUZZY_SQL}, u AS (SELECT file, folder, CASE WHEN file = folder THEN 100 ELSE score END AS score FROM s),
               r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, lower(folder), folder) AS r, lead(score, 1, 0) OVER (PARTITION BY file ORDER BY score DESC, lower(folder), folder) AS second,
                            max(score) OVER (PARTITION BY file) AS best FROM u WHERE score > 0),
               c AS (SELECT file, count(*) AS n, string_agg(folder, '|' ORDER BY r) AS folders FROM r WHERE score >= 60 AND score + 20 >= best GROUP BY 1),
               d AS (SELECT a.file, folder, coalesce(score, 0) AS score, coalesce(second, 0) AS second, n, folders, CASE WHEN score >= 100 AND score - second >= 20 THEN 'Matched' WHEN score >= 60 THEN 'Choice' ELSE 'None' END AS status
                     FROM (SELECT DISTINCT file FROM u) a LEFT JOIN r ON r.file = a.file AND r.r = 1 LEFT JOIN c ON c.file = a.file)
           SELECT file, status, CASE WHEN status <> 'None' THEN folder END AS folder, score, second AS runner_up, CASE WHEN status = 'Choice' THEN n ELSE 0 END AS choices, CASE WHEN status = 'Choice' THEN folders ELSE '' END AS candidates FROM d""")
def score_decide(spark, d):
    """E18."""
    s = fuzzy_score(spark, d).withColumn("score", F.when(F.col("file") == F.col("folder"), 100).otherwise(F.col("score")))
    return scoring.decided(s, "file", "folder").withColumn("candidates", F.array_join("candidates", "|"))


@query(f"WITH {NAMES_SQL} SELECT file, folder, hits FROM k")
def blocking_prefix(spark, d):
    """The same pairs, the commonest grams being joined only where they could change them."""
    n = t(spark, d, "part").select("p_name").distinct()
    left = n.select(F.replace("p_name", F.lit("o"), F.lit("0")).alias("file")).withColumn("file_name", F.col("file"))
    right = n.select(F.col("p_name").alias("folder")).withColumn("folder_name", F.col("folder"))
    return scoring.blocked_by_prefix(left, right, "file", "file_name", "folder", "folder_name")[0]


# --- snapshots

OLD_SQL = "o AS (SELECT 'k' || o_orderkey AS key, CAST(o_totalprice AS VARCHAR) || '|' || CAST(o_orderdate AS DATE) || '|' || o_orderstatus AS sig, o_custkey AS name, o_orderkey AS ord FROM orders WHERE o_orderkey % 11 <> 0)"
NEW_SQL = """n AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'm' ELSE 'k' END || o_orderkey AS key,
                     CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE '' END || CAST(o_totalprice AS VARCHAR) || '|' || CAST(o_orderdate AS DATE) || '|' || o_orderstatus AS sig,
                     CASE WHEN o_orderkey % 26 = 0 THEN -1 ELSE o_custkey END AS name, o_orderkey AS ord FROM orders WHERE o_orderkey % 19 <> 0)"""
DELTA_SQL = f"""{OLD_SQL}, {NEW_SQL}, b AS (SELECT o.key AS old_key, n.key AS new_key, o.sig AS os, n.sig AS ns, o.name AS onm, n.name AS nn, n.ord FROM o FULL JOIN n ON o.key = n.key),
               s AS (SELECT os, min(old_key) AS old_key, min(onm) AS onm FROM b WHERE new_key IS NULL GROUP BY 1 HAVING count(*) = 1),
               f AS (SELECT ns, new_key, nn FROM (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY ord, new_key) AS r FROM b WHERE old_key IS NULL) WHERE r = 1),
               m AS (SELECT CASE WHEN onm = nn THEN 'Moved' ELSE 'Renamed' END AS kind, old_key, new_key FROM s JOIN f ON os = ns),
               x AS (SELECT CASE WHEN os = ns THEN 'CacheHit' ELSE 'Modified' END AS kind, old_key, new_key FROM b WHERE old_key IS NOT NULL AND new_key IS NOT NULL
                     UNION ALL SELECT * FROM m
                     UNION ALL SELECT 'Added', NULL, new_key FROM b WHERE old_key IS NULL AND new_key NOT IN (SELECT new_key FROM m)
                     UNION ALL SELECT 'Removed', old_key, NULL FROM b WHERE new_key IS NULL AND old_key NOT IN (SELECT old_key FROM m))"""


def order_snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    o = t(spark, d, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("double").cast("string")
    sig = F.concat_ws("|", price, F.to_date("o_orderdate").cast("string"), "o_orderstatus")
    old = o.filter(k % 11 != 0).select(F.concat(F.lit("k"), k).alias("key"), sig.alias("sig"), F.col("o_custkey").alias("name"), k.alias("ord"))
    new = o.filter(k % 19 != 0).select(F.concat(F.when(k % 13 == 0, "m").otherwise("k"), k).alias("key"), F.concat(F.when(k % 17 == 0, "x").otherwise(""), sig).alias("sig"), F.when(k % 26 == 0, -1).otherwise(F.col("o_custkey")).alias("name"), k.alias("ord"))
    return old, new


def order_delta(spark, d) -> DataFrame:
    return cdc.delta(*order_snapshots(spark, d), "key", "sig", "name", "ord")


@query(f"WITH {DELTA_SQL} SELECT kind, count(*) AS \"rows\" FROM x GROUP BY 1")
def cdc_delta(spark, d):
    """C1 A14 F28."""
    return cdc.counters(order_delta(spark, d))


@query(f"WITH {DELTA_SQL} SELECT kind, old_key, new_key FROM x WHERE kind IN ('Moved', 'Renamed')")
def cdc_relocations(spark, d):
    """C2 C3 C4."""
    return order_delta(spark, d).filter("kind IN ('Moved', 'Renamed')")


@query(f"WITH {DELTA_SQL} SELECT old_key, true AS plan, kind IN ('Renamed', 'Removed') AS recognition, kind IN ('Renamed', 'Removed') AS facts FROM x WHERE old_key IS NOT NULL AND kind <> 'CacheHit'")
def cdc_invalidated(spark, d):
    """C1 C2 P11."""
    return cdc.invalidated(order_delta(spark, d))


@query("""WITH m AS (SELECT o_orderpriority AS scope_key, o_orderkey AS file_id FROM orders UNION ALL SELECT 'all', o_orderkey FROM orders WHERE o_orderkey % 2 = 0),
               s AS (SELECT o_orderkey AS file_id FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderkey % 3 <> 0),
               g AS (SELECT file_id FROM m WHERE scope_key = '5-LOW' AND file_id NOT IN (SELECT file_id FROM s))
          SELECT scope_key, count(*) AS members FROM (SELECT * FROM m WHERE scope_key <> '5-LOW' AND file_id NOT IN (SELECT file_id FROM g) UNION SELECT '5-LOW', file_id FROM s) GROUP BY 1""")
def cdc_scoped_removed(spark, d):
    """What one scope loses goes from all."""
    o = t(spark, d, "orders")
    members = o.select(F.col("o_orderpriority").alias("scope_key"), F.col("o_orderkey").alias("file_id")).unionByName(o.filter("o_orderkey % 2 = 0").select(F.lit("all").alias("scope_key"), F.col("o_orderkey").alias("file_id")))
    seen = o.filter("o_orderpriority = '5-LOW' AND o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("file_id"))
    kept, _ = cdc.scoped(members, o.select(F.col("o_orderkey").alias("file_id")), seen, "5-LOW", known=True, shallow=False)
    return kept.groupBy("scope_key").agg(F.count(F.lit(1)).alias("members"))


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS day, max(ts) AS last_at FROM events GROUP BY 1 ORDER BY last_at DESC LIMIT 16)
          SELECT CAST(s.day AS VARCHAR) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN s ON CAST(ts AS DATE) = s.day JOIN customer ON c_custkey = user_id WHERE c_mktsegment = 'BUILDING' OR starts_with(c_mktsegment, 'MA') GROUP BY 1, 2""")
def session_topn(spark, d):
    """The sixteen newest days, with who took part."""
    e = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    s = cdc.newest_sessions(e.groupBy("day").agg(F.max("ts").alias("at")), "at", "day", 16)
    c = t(spark, d, "customer").filter((F.col("c_mktsegment") == "BUILDING") | F.startswith("c_mktsegment", F.lit("MA"))).select(F.col("c_custkey").alias("user_id"))
    return e.join(s.select("day"), "day").join(c, "user_id").groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("""WITH a AS (SELECT DISTINCT upper(c_name) AS path FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT DISTINCT upper(c_name) AS path FROM customer WHERE c_custkey % 5 <> 0)
          SELECT 'index' AS side, path FROM a WHERE path NOT IN (SELECT path FROM b) UNION ALL SELECT 'listing', path FROM b WHERE path NOT IN (SELECT path FROM a)""")
def completeness_diff(spark, d):
    """C10."""
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    return cdc.differences(c.filter("c_custkey % 7 <> 0"), c.filter("c_custkey % 5 <> 0"), "c_name")


@query("""WITH e AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 9 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END AS target FROM orders WHERE o_orderkey % 4 = 1)
          SELECT CAST(o_orderkey % 3 AS BIGINT) AS path_mod, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.o_orderkey = orders.o_orderkey) GROUP BY 1""")
def blocked_paths(spark, d):
    """P4."""
    o = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C:/x/"), F.col("o_orderkey")).alias("path"))
    stop = o.filter("o_orderkey % 4 = 1").select(F.replace(F.lower("path"), F.lit("/"), F.lit("\\")).alias("path"))
    return rules.not_blocked(o, stop).groupBy((F.col("o_orderkey") % 3).alias("path_mod")).agg(F.count(F.lit(1)).alias("n"))


# --- plans


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1), r AS (SELECT o_custkey, first, row_number() OVER (ORDER BY first, o_custkey) - 1 AS slot FROM f)
          SELECT o_custkey, first, slot, CAST(3 + (13 + slot) // 20 AS BIGINT) AS group_number FROM r""")
def plan_allocation(spark, d):
    """New identities in the order of their first files, twenty to a group; group 3 has thirteen."""
    return planning.allocated(t(spark, d, "orders"), "o_custkey", "o_orderkey", 3, 13, 20)


@query("""WITH x AS (SELECT o_orderkey, o_custkey, lower(c_mktsegment) || '/' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS k FROM orders JOIN customer ON c_custkey = o_custkey),
               s AS (SELECT k, count(DISTINCT o_custkey) AS sources FROM x GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1)
          SELECT o_orderkey, sources FROM x JOIN s ON x.k = s.k""")
def batch_conflicts(spark, d):
    """A10."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("source"), F.concat("c_mktsegment", F.lit("/"), F.to_date("o_orderdate")).alias("target"))
    return planning.batch_conflicts(rows, "source", "target").select("o_orderkey", "sources")


@query("""WITH x AS (SELECT o_orderkey, o_custkey % 100 AS target FROM orders), f AS (SELECT target, min(o_orderkey) AS f FROM x GROUP BY 1)
          SELECT o_orderkey, f.f IS NOT NULL AND x.target % 10 <> 0 AS executed FROM x LEFT JOIN f ON f.target = x.target AND f.f = x.o_orderkey""")
def first_per_target(spark, d):
    """L9 L5."""
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).cast("string").alias("target"))
    return planning.first_per_target(o, "target", "o_orderkey", o.select("target").filter("cast(target as int) % 10 = 0")).select("o_orderkey", "executed")


@query("""WITH x AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS size, c_nationkey % 3 AS a, o_orderkey % 3 AS b, o_orderstatus = 'P' AS missing, c_mktsegment || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS target
                     FROM orders JOIN customer ON c_custkey = o_custkey)
          SELECT count(*) AS "rows", CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(CASE WHEN a <> b THEN size ELSE 0 END) AS BIGINT) AS cross_bytes, CAST(sum(CASE WHEN missing THEN 1 ELSE 0 END) AS BIGINT) AS missing,
                 (SELECT count(*) FROM (SELECT target FROM x GROUP BY 1 HAVING count(*) > 1)) AS duplicate_targets FROM x""")
def safety_totals(spark, d):
    """A12."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = o.select(F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), (F.col("c_nationkey") % 3).alias("a"), (F.col("o_orderkey") % 3).alias("b"), (F.col("o_orderstatus") == "P").alias("missing"), F.concat("c_mktsegment", F.to_date("o_orderdate").cast("string")).alias("target"))
    return report.safety_totals(rows, "size", "a", "b", "missing", "target")


STATUS_SQL = "CASE o_orderkey % 9 WHEN 0 THEN 'Duplicate' WHEN 1 THEN 'Choice' WHEN 2 THEN 'NewAuthor' WHEN 3 THEN 'Matched' WHEN 4 THEN 'Excluded' WHEN 5 THEN 'Error' WHEN 6 THEN 'NewAuthorReuse' WHEN 7 THEN 'Ambiguous' ELSE 'Unrecognized' END"


def statuses(spark, d) -> DataFrame:
    names = ["Duplicate", "Choice", "NewAuthor", "Matched", "Excluded", "Error", "NewAuthorReuse", "Ambiguous", "Unrecognized"]
    return t(spark, d, "orders").withColumn("status", F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 9 + 1).cast("int")))


@query(f"""WITH x AS (SELECT {STATUS_SQL} AS s FROM orders), n AS (SELECT s, count(*) AS n FROM x GROUP BY 1), v AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM n)
           SELECT v.n AS all_rows, CAST(sum(CASE WHEN s IN ('Ambiguous', 'Choice', 'Duplicate', 'Unrecognized', 'Error') THEN n.n ELSE 0 END) AS BIGINT) AS attention,
                  CAST(sum(CASE WHEN s = 'Duplicate' THEN n.n ELSE 0 END) AS BIGINT) AS duplicate, CAST(sum(CASE WHEN s IN ('Ambiguous', 'Choice') THEN n.n ELSE 0 END) AS BIGINT) AS ambiguous,
                  CAST(sum(CASE WHEN s IN ('NewAuthor', 'NewAuthorReuse') THEN n.n ELSE 0 END) AS BIGINT) AS new, CAST(sum(CASE WHEN s = 'Matched' THEN n.n ELSE 0 END) AS BIGINT) AS matched,
                  CAST(sum(CASE WHEN s = 'Excluded' THEN n.n ELSE 0 END) AS BIGINT) AS excluded, CAST(sum(CASE WHEN s IN ('Error', 'Unrecognized') THEN n.n ELSE 0 END) AS BIGINT) AS unrecognized FROM n, v GROUP BY v.n""")
def filter_counts(spark, d):
    """A11 P6 P9 F27."""
    return report.filter_counts(statuses(spark, d))


@query(f"""WITH x AS (SELECT year(o_orderdate) AS round, {STATUS_SQL} AS s, o_orderstatus = 'F' AS hit FROM orders)
           SELECT CAST(round AS BIGINT) AS round, count(*) AS files, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) AS BIGINT) AS recalculated,
                  CAST(sum(CASE WHEN s = 'Matched' THEN 1 ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN s IN ('Error', 'Unrecognized') THEN 1 ELSE 0 END) AS BIGINT) AS unrecognized FROM x GROUP BY 1""")
def round_summary(spark, d):
    """A13."""
    rows = statuses(spark, d).select(F.year("o_orderdate").cast("long").alias("round"), "status", (F.col("o_orderstatus") == "F").alias("hit"))
    return report.round_summary(rows, "round", "status", "hit")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 OR o_orderstatus = 'P' THEN 'recomputed' ELSE 'cached' END AS result FROM orders""")
def plan_merge_cache(spark, d):
    """Half of the rows are cached; of those what went stale is computed anew."""
    o = t(spark, d, "orders")
    key = F.col("o_orderkey").alias("id")
    cached = o.filter("o_orderkey % 2 = 0").select(key, F.lit("cached").alias("result"))
    again = o.filter("o_orderkey % 2 = 1 OR o_orderstatus = 'P'").select(key, F.lit("recomputed").alias("result"))
    return planning.merged_cache(cached, o.filter("o_orderstatus = 'P'").select(key), again, "id")


@query("""WITH e AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 500 = 3)
          SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM e) OR o_orderstatus = 'O' THEN 'new' ELSE 'old' END AS target FROM orders""")
def partial_replan(spark, d):
    """An edited row takes with it those of the same author, and all that can still move."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", "Matched").otherwise("Excluded").alias("status"), F.lit("old").alias("target"))
    edited = o.filter("o_orderkey % 500 = 3")
    return planning.replanned(o, edited, lambda rows: rows.withColumn("target", F.lit("new")), "o_orderkey", "o_custkey").select("o_orderkey", "target")


@query("""SELECT c_custkey FROM customer ORDER BY ((CAST(c_custkey AS BIGINT) * 1103515245) + 20261008) % 2147483647, c_custkey LIMIT 100""")
def lcg_sample(spark, d):
    """L7."""
    return planning.lcg_sample(t(spark, d, "customer").select("c_custkey"), "c_custkey", 20261008, 100)


@query("""WITH l AS (SELECT user_id, event_type, max(ts) AS last_at FROM events GROUP BY 1, 2)
          SELECT user_id, event_type, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS "at" FROM l
          WHERE floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(last_at)) < 60 * CASE event_type WHEN 'error' THEN 4320 WHEN 'click' THEN 1440 ELSE 2880 END""")
def fresh_lookup(spark, d):
    """P10."""
    last = report.latest_lookup(t(spark, d, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts")
    out = report.fresh(last, "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), "event_type", {"error": 4320, "click": 1440}, 2880)
    return out.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') OR contains(lang, 'the') OR contains(source, 'the')) AND (contains(lower(text), 'src1') OR contains(lang, 'src1') OR contains(source, 'src1'))""")
def text_search(spark, d):
    """P7."""
    return report.text_search(t(spark, d, "documents"), "The SRC1", ["text", "lang", "source"]).select("doc_id")


@query("""SELECT event_id, CAST(row_number() OVER (ORDER BY t DESC NULLS LAST, event_id) AS BIGINT) AS n FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN date_trunc('hour', ts) END AS t FROM events) ORDER BY n LIMIT 500""")
def latest_first(spark, d):
    """O1: equal times keep their order, missing ones come last."""
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.date_trunc("hour", "ts")).alias("at"))
    return report.latest_first(e, "at", "event_id", 500).withColumn("n", F.row_number().over(Window.orderBy(F.desc_nulls_last("at"), "event_id")).cast("long")).select("event_id", "n")


@query("""SELECT min_by(lang, doc_id) AS lang, min(doc_id) AS doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents) GROUP BY lower(lang)""")
def first_spelling(spark, d):
    """O10."""
    docs = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("lang"))
    return report.first_spelling(docs, "lang", "doc_id")


@query("""SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, d LIMIT 7""".replace("CAST(ts AS DATE) AS d", "strftime(ts, '%Y-%m-%d') AS d"))
def by_priority(spark, d):
    """O3."""
    e = t(spark, d, "events").filter("event_type = 'error'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return report.by_priority(e.withColumn("s", F.lit("Ambiguous")), "s", ["Unresolved", "Ambiguous"], [F.desc("n"), "d"], 7).select("d", "n")


@query("""WITH l AS (SELECT event_id, user_id, ts, event_type FROM events WHERE event_id % 10 <> 0 AND event_id % 14 <> 3)
          SELECT event_id, CAST(user_id AS BIGINT) AS files, CAST(user_id + 1 AS BIGINT) AS sp FROM l WHERE event_type <> 'error' ORDER BY event_type DESC, event_id DESC LIMIT 1000""")
def perf_log_parse(spark, d):
    """SRC12: a file for each type of event; one is of another format, some lines are comments or have no valid time; a key that is written twice keeps its last value."""
    e = t(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("file"))
    time = F.when(F.col("event_id") % 14 == 3, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    line = F.concat(F.when(F.col("event_id") % 10 == 0, "# ").otherwise(""), time, F.lit("|ID="), "event_id", F.lit("|F="), "user_id", F.lit("|SP=7|junk|=x|SP="), F.col("user_id") + 1)
    head = e.select("file").distinct().select("file", F.lit(-1).cast("long").alias("line"), F.when(F.col("file") == "error", "#GL2").when(F.col("file") == "click", "#GL3").otherwise("#GL4").alias("value"))
    log = readers.performance_log(head.unionByName(e.select("file", F.col("event_id").cast("long").alias("line"), line.alias("value"))))
    return log.select(readers.metric("values", "ID").alias("event_id"), readers.metric("values", "F").alias("files"), readers.metric("values", "SP").alias("sp"))


@query("""WITH w AS (SELECT l_suppkey, p_brand, count(DISTINCT l_orderkey) AS works FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
          SELECT l_suppkey, p_brand, works, CASE WHEN works >= 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN 92 ELSE 88 END WHEN works = 2 THEN 88 WHEN works = 1 THEN 75 ELSE 0 END AS score FROM w""")
def work_score(spark, d):
    """F32."""
    w = work_rows(spark, d).groupBy("l_suppkey", "p_brand").agg(F.countDistinct("gallery_id").alias("works"))
    return w.withColumn("score", text.work_score(F.col("works"), F.col("l_suppkey") % 2 == 0))


@query("""SELECT p_partkey, unnest(list_distinct(list_transform(range(1, length(replace(p_name, ' ', ''))), lambda i: substr(replace(p_name, ' ', ''), CAST(i AS BIGINT), 2)))) AS gram FROM part""")
def name_bigrams(spark, d):
    """F18."""
    return scoring.grams(t(spark, d, "part"), "p_partkey", "p_name", whole_if_single=False)


@query("""SELECT doc_id, sha256(text) AS content, lower(regexp_replace(source, '[^a-zA-Z0-9]', '', 'g')) AS compact FROM documents""")
def hashes(spark, d):
    """F25 F26."""
    return t(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content"), text.compact_identity("source", compat=False).alias("compact"))


@query("""SELECT page_id, CASE WHEN regexp_matches(path, '\\.[A-Za-z0-9_]{1,20}$') THEN lower(regexp_extract(path, '\\.([A-Za-z0-9_]{1,20})$', 1)) ELSE '' END AS ext FROM (WITH """ + URL_SQL + " SELECT * FROM p)")
def extensions(spark, d):
    """F23."""
    return urls(spark, d).select("page_id", rules.extension("path").alias("ext"))


@query("""WITH tags AS (SELECT DISTINCT 'artist' AS ns, s_name AS name FROM supplier UNION SELECT DISTINCT 'group', p_brand FROM part)
          SELECT 'tag:' || ns || ':' || name AS gallery_id, upper(ns[1]) || ns[2:] AS entity_type, name FROM tags""")
def tag_aggregate(spark, d):
    """SRC3."""
    tags = t(spark, d, "supplier").select(F.lit("artist").alias("namespace"), F.col("s_name").alias("tag")).unionByName(t(spark, d, "part").select(F.lit("Circle").alias("namespace"), F.col("p_brand").alias("tag")))
    return readers.tag_aggregate(tags)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS gid, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
               g AS (SELECT CAST(gid AS VARCHAR) AS gallery_id, string_agg(name, '|' ORDER BY name) AS artists FROM l GROUP BY gid)
          SELECT g.gallery_id, coalesce(o_orderpriority, '') AS title, artists FROM g LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = g.gallery_id WHERE o_orderstatus IS NULL OR o_orderstatus <> 'P'""")
def gallery_dump(spark, d):
    """SRC4: tables and columns found by their names."""
    tables = {
        "labels": t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Artist").alias("type")),
        "uses": t(spark, d, "lineitem").select(F.col("l_suppkey").alias("tid"), F.col("l_orderkey").alias("gid")),
        "gallery": t(spark, d, "orders").select(F.col("o_orderkey").alias("gid"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") == "P").cast("int").alias("expunged")),
    }
    return readers.gallery_dump(tables).select("gallery_id", "title", F.array_join("artists", "|").alias("artists"))


# --- Spark baseline: plain SQL that the reference doesn't have


@query("""SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS line, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def x_rollup(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("line"), "n", "qty")


@query("""SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS line, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def x_cube(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("line"), "n")


@query("""SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE))""")
def x_rank(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate"))
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"))


@query("""SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders""")
def x_rows_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return t(spark, d, "orders").select("o_orderkey", F.sum(F.round("o_totalprice").cast("long")).over(w).alias("s"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def x_intersect(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(t(spark, d, "customer").filter("c_nationkey < 5").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def x_except(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey"))


@query("""SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def x_tumbling(spark, d):
    return t(spark, d, "events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("w"), "event_type", "n")


@query("""SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL (6 * k) HOUR, '%Y-%m-%d %H:%M') AS w, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1""")
def x_sliding(spark, d):
    return t(spark, d, "events").groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("w"), "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
               s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
          SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def x_session(spark, d):
    return t(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query()
def x_approx_distinct(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"))


@query("""SELECT a.event_id, (SELECT max(b.event_id) FROM events b WHERE b.event_type = 'view' AND b.user_id = a.user_id AND b.ts <= a.ts AND b.ts = (SELECT max(c.ts) FROM events c WHERE c.event_type = 'view' AND c.user_id = a.user_id AND c.ts <= a.ts)) AS view_id
          FROM events a WHERE a.event_type = 'purchase'""")
def x_asof(spark, d):
    """The last view before each purchase: one sort by user and time of both together, no range join."""
    e = t(spark, d, "events").filter("event_type IN ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("view_id", last).filter("event_type = 'purchase'").select("event_id", "view_id")


from . import more_queries as _more  # noqa: E402, F401  # registers its queries here
