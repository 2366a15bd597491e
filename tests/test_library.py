"""Golden cases and plain models of the library's operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from archivolt import more_queries
from archivolt.functions import grammar, naming, rules, text
from archivolt.operators import cdc, kb, resolve, scoring
from archivolt.plans import planning, report
from archivolt.sources import readers, writers
from archivolt.streaming import changes, stateful

EVIDENCE = "source_id string, source_file string, gallery_id string, entity_type string, name string, normalized_name string, pretty_name string"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


# --- names


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Ａｂｃ　 Ｄ", "abc d"),
        ("a​b﻿", "ab"),
        ("【Name】 （x ）", "[name](x)"),
        ("自家発電処 (flanvia", "自家発電処(flanvia)"),
        ("a (b [c", "a(b[c"),
        ("a ) b", "a)b"),
        ("a [b) c", "a[b)c"),
        ("John  Smith", "john smith"),
        (None, ""),
        ("   ", ""),
    ],
)
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(text.normalize("s")).first()[0] == want == grammar.norm(raw or "")


def test_cautious(spark):
    rows = [("「A・B」", "a·b"), ("a—b", "a-b"), ("name)", "name"), ("name (x)", "name(x)"), ("end.", "end"), ("end..", "end.."), ("“‘q’”", "q")]
    df = spark.createDataFrame(rows, "s string, want string")
    assert all(r.got == r.want for r in df.select(text.normalize_cautious("s").alias("got"), "want").collect())


def test_small_text_functions(spark):
    df = spark.createDataFrame([("[［a］]", "葛籠 くずかご", "name.", "雨と棘 雨がっぱ少女群", "a_b", "X, y;x | [] |N/A\nZ", "日本", "abc")], "w string, c string, s string, g string, t string, n string, j string, b string")
    r = df.select(
        text.unwrapped("w").alias("w"), text.cjk_joined("c").alias("c"), text.without_full_stop("s").alias("s"), text.safe_segments("g").alias("g"), text.pretty_tag("t").alias("t"), text.split_names("n").alias("n"),
        text.is_non_ascii("j").alias("j"), text.bigrams("b").alias("b"), text.compact_identity(F.lit("A-b_1!")).alias("k"), text.blob_sha1(F.lit("hello\n")).alias("sha"),
        text.bounded_levenshtein(F.lit("abcdef"), F.lit("uvwxyz")).alias("far"), text.has_complete(F.lit("x [abc] y"), F.lit("abc")).alias("in1"), text.has_complete(F.lit("xabc"), F.lit("abc")).alias("in2"),
        text.event_then_identity(F.lit("コミケ96ダイジェスト版 荒井啓 [漢化]"), F.lit("荒井啓")).alias("ev"), text.starts_with_complete(F.lit("Name- x"), F.lit("[name]")).alias("st"),
    ).first()
    assert (r.w, r.c, r.s, r.t, r.n, r.j, r.b, r.k) == ("a", "葛籠くずかご", "name", "a b", ["X", "y", "Z"], True, ["ab", "bc"], "ab1")
    assert r.g == ["雨と棘", "雨がっぱ少女群"] and r.sha == "ce013625030ba8dba906f756967f9e9ca394464a" and r.far == 3 and r.in1 and not r.in2 and r.ev and r.st


def test_structured(spark):
    names = ["Xration+(mil)", "木鈴亭 (木鈴カケル, コウリ", "[c (a & b、A)]", "plain", "(x)", "c ()"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [r.p and (r.p.society, r.p.creators) for r in df.select(text.structured_parts("s").alias("p")).collect()]
    assert got == [("Xration", ["mil"]), ("木鈴亭", ["木鈴カケル", "コウリ"]), ("c", ["a", "b"]), None, None, None]
    assert got == [grammar.parts(n) and (grammar.parts(n)[0], grammar.parts(n)[1]) for n in names]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("(未知展会X) [LAMINARIA (しおこんぶ)] 作品 [中国翻译]", ["LAMINARIA (しおこんぶ)"]),
        ("(秋葉原超同人祭) まきばのぼにゅうにっき ~サキュバス編~ [罗洁爱儿个人机翻]", []),
        ("(作者甲) [作者乙] 作品", ["作者甲", "作者乙"]),
        ("(作者甲) 作品", ["作者甲"]),
        ("[a][b] title [c]", ["a", "b"]),
        ("(C99) [circle (artist)] work", ["circle (artist)"]),
        ("(同人誌) [x] work", ["x"]),
        ("[中国翻訳] [x] work", ["x"]),
        ("[Pixiv] title", ["Pixiv"]),
        ("[circle (creator) title", ["circle (creator)"]),
        ("title words [author] more", ["author"]),
        ("", []),
    ],
)
def test_candidates(name, want):
    assert grammar.candidates(name, grammar.metadata_test(rules.default_rules())) == want


def test_events(spark):
    p = [grammar.Parsed(f"(未知展会X) [S{i} (c{i})] w") for i in range(3)]
    rows = [(x.prefix, x.society, "|".join(x.creators)) for x in p] + [("other", "s", "c")] * 20
    df = spark.createDataFrame(rows, "prefix string, society string, creators string")
    assert [(r.prefix, r.pairs) for r in grammar.event_prefixes(df).collect()] == [("未知展会x", 3)]
    assert grammar.Parsed("(未知展会X) 作品", frozenset({"未知展会x"})).confidence == 80
    assert grammar.Parsed("(C99) t").confidence == 85 and p[0].confidence == 90 and grammar.Parsed("(作者甲) 作品").confidence == 0


def test_udfs(spark):
    df = spark.createDataFrame([("[a (b)] t",), (None,)], "s string")
    r = df.select(grammar.candidates_udf()("s").alias("c"), grammar.parse_udf()("s").alias("p"), grammar.aliases_udf("s").alias("a"), grammar.norms_udf("s").alias("n"), grammar.literal_norms_udf("s").alias("l")).collect()
    assert r[0].c == ["a (b)"] and r[0].a[:3] == ["a (b)", "a", "b"] and "a(b)" in r[0].n and r[0].l == ["[a(b)]t", "a(b)"] and r[1].c == []
    assert grammar.per_distinct(df, "s", "c", grammar.candidates_udf()).count() == 2


def test_rules(spark):
    tags = ["Chinese", "DL版", "xDL版", "2014.11", "2024年10月3日", "C97", "COMIC1☆15", "774", "author", "", "例大祭8"]
    df = spark.createDataFrame([(t,) for t in tags], "s string")
    got = [r.m for r in df.select(rules.is_metadata_tag("s").alias("m")).collect()]
    assert got == [True, True, False, True, True, True, True, False, False, True, True]
    assert got == [grammar.metadata_test(rules.default_rules())(t) for t in tags]
    assert len(rules.default_rules()) == 67
    with pytest.raises(ValueError):
        rules.load_rules('[{"name": "x", "kind": "Nope", "pattern": "a"}]')
    with pytest.raises(Exception):  # noqa: B017
        rules.load_rules('[{"name": "x", "kind": "Regex", "pattern": "("}]')
    own = rules.load_rules('[{"name": "off", "kind": "Exact", "pattern": "a", "enabled": false}, {"name": "b", "kind": "Contains", "pattern": "A"}]')
    assert one(spark, rules.first_hit(F.col("s"), own), s="xay") == "b"
    paths = spark.createDataFrame([("r/x/keep/stop/f.zip", "r"), ("r/f.zip", "r"), ("r/stop/keep/f.zip", "r")], "p string, r string")
    hit = [rules.Rule("stop", rules.EXACT, "STOP"), rules.Rule("keep", rules.EXACT, "keep")]
    assert [x.rule for x in rules.folder_hit(paths, "p", "r", hit).collect()] == ["stop", None, "keep"]
    table = spark.createDataFrame([(2, "b", "Contains", "x"), (1, "a", "StartsWith", "Y")], "ord int, name string, kind string, pattern string")
    names = spark.createDataFrame([(1, "yx"), (2, "ax"), (3, "q")], "id int, n string")
    assert {r.id: r.rule for r in rules.first_hit_by_table(names, "id", "n", table).collect()} == {1: "a", 2: "b"}
    assert one(spark, rules.extension("s"), s="A.B.ZIP") == "zip" and one(spark, rules.normalized_extension("s"), s="*.Rar") == "rar"


def test_naming(spark):
    assert [naming.letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(naming.from_letters(naming.letters(n)) == n for n in range(1, 800))
    df = spark.createDataFrame([(0,), (1,), (28,), (1000,)], "n int")
    for template, want in (("G {n}", ["G 1", "G 1", "G 28", "G 1000"]), ("{n2}", ["01", "01", "28", "1000"]), ("x{n3}y", ["x001y", "x001y", "x028y", "x1000y"]), ("{A}", ["A", "A", "AB", "ALL"]), ("{a}", ["a", "a", "ab", "all"])):
        rows = df.select("n", naming.group_name(template, F.col("n")).alias("g")).withColumn("back", naming.group_number(template, F.col("g"))).collect()
        assert [r.g for r in rows] == want and [r.back for r in rows] == [1, 1, 28, 1000]
    assert one(spark, naming.group_number("G {n}", F.col("s")), s="H 1") is None
    assert one(spark, naming.author_folder("{author}", F.col("s")), s='a/b:c*?"<>|. ') == "a／b：c＊？＂＜＞｜" and one(spark, naming.author_folder("{author}", F.col("s")), s="con") == "_con"
    assert one(spark, naming.author_folder("{author}", F.col("s")), s="") == "_" and len(one(spark, naming.author_folder("[{author}]", F.col("s")), s="x" * 400)) == 255
    assert one(spark, naming.author_of_folder(F.col("s"), ["[{author}]", "by {author} end"]), s="BY me END") == "me" and one(spark, naming.author_of_folder(F.col("s"), ["[{author}]"]), s="you") == "you"


# --- knowledge base


def tables(spark, state="imported"):
    nh, eh = "nh-metadata-archive", "eh-tag-aggregate"
    month = "by_month/2026-09.csv"
    evidence = spark.createDataFrame(
        [(nh, month, "101", "Artist", "artist a", "artist a", "artist a"), (nh, month, "101", "Group", "circle c", "circle c", "circle c"), (eh, "tag-aggregate", "tag:artist:artist_a", "Artist", "artist_a", "artist_a", "artist a"), (eh, "tag-aggregate", "tag:group:circle c", "Group", "circle c", "circle c", "circle c")], EVIDENCE
    )
    works = spark.createDataFrame([(nh, month, "101")], "source_id string, source_file string, gallery_id string")
    files = spark.createDataFrame([(nh, month, state), (eh, "tag-aggregate", state)], "source_id string, path string, state string")
    return evidence, works, files


def base(spark, rows=True):
    entity = spark.createDataFrame([(5, "artist a", "artist a", "artist a", "Artist", "eh:artist:artist_a", True)][: int(rows)], "id long, canonical_name string, roman_name string, norm string, kind string, external_id string, verified boolean")
    identity = spark.createDataFrame([("E-Hentai", "Artist", "artist_a", 5, "artist_a", 4)][: int(rows)], "provider string, kind string, norm string, entity_id long, tag string, works long")
    alias = spark.createDataFrame([], "entity_id long, norm string, alias string, alias_type string")
    return kb.Kb(entity, identity, alias, spark.createDataFrame([], "artist_id long, group_id long, weight long"))


def sizes(k):
    return k.entity.count(), k.identity.count(), k.relation.count(), k.relation_source.count(), k.conflict.count()


def test_merge(spark):
    evidence, works, files = tables(spark)
    k = kb.merge(base(spark), evidence, works, files)
    assert sizes(k) == (4, 4, 1, 1, 2)
    assert k.identity.filter("provider = 'nHentai' AND kind = 'Artist' AND entity_id <> 5").count() == 1
    assert k.identity.filter("provider = 'E-Hentai' AND kind = 'Artist' AND entity_id = 5").count() == 1
    assert sizes(kb.merge(k, evidence, works, files)) == sizes(k)  # the same evidence again
    assert kb.wrong_relations(k).count() == 0
    gone = kb.merge(base(spark), evidence, works, tables(spark, "withdrawn")[2])
    assert (gone.entity.count(), gone.identity.count(), gone.relation.count()) == (1, 1, 0)


def test_files_are_worked_out_once(spark, tmp_path):
    """what a merge gives doesn't go back to where its files came from, in any of its steps."""
    evidence, works, files = tables(spark)
    files.write.parquet(f"{tmp_path}/files")
    k = kb.merge(base(spark), evidence, works, spark.read.parquet(f"{tmp_path}/files"))
    assert not [f for x in (k.entity, k.identity, k.alias, k.relation, k.conflict) for f in x.inputFiles() if str(tmp_path) in f]


def test_merge_from_zero(spark):
    evidence, works, files = tables(spark)
    nh = evidence.filter("source_id = 'nh-metadata-archive'")
    k = kb.merge(base(spark, False), nh, works, files)
    assert sizes(k) == (2, 2, 1, 1, 0)
    assert sorted((r.id, r.kind) for r in k.entity.collect()) == [(1, "Artist"), (2, "Group")]


def test_newest_file_is_the_newest_imported_one(spark):
    """A withdrawn or pending newer file of the same work takes nothing away."""
    s = "csv"
    evidence = spark.createDataFrame([(s, f, "1", kind, n, n, "") for f in ("f1", "f2") for kind, n in (("Artist", "a"), ("Group", "g"), ("Parody", "p"))], EVIDENCE)
    works = spark.createDataFrame([(s, "f1", "1"), (s, "f2", "1")], "source_id string, source_file string, gallery_id string")
    for state, want in (("withdrawn", (2, 1)), ("pending", (2, 1)), ("imported", (2, 1))):
        files = spark.createDataFrame([(s, "f1", "imported"), (s, "f2", state)], "source_id string, path string, state string")
        k = kb.merge(base(spark, False), evidence, works, files)
        assert (k.entity.count(), k.relation.count()) == want
    none = spark.createDataFrame([(s, "f1", "pending"), (s, "f2", "withdrawn")], "source_id string, path string, state string")
    assert kb.merge(base(spark, False), evidence, works, none).entity.count() == 0


def test_entities_are_called_by_their_pretty_names(spark):
    rows = [("nh-metadata-archive", "f", "1", "Artist", "some_name", "some_name", "Ｓｏｍｅ　Name"), ("eh-current", "f", "2", "Group", "circle", "circle", ""), ("csv", "f", "3", "Group", "circle", "circle", "")]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    works = evidence.select("source_id", "source_file", "gallery_id")
    files = evidence.select("source_id", F.col("source_file").alias("path"), F.lit("imported").alias("state"))
    k = kb.merge(base(spark, False), evidence, works, files)
    got = {r.external_id: r for r in k.entity.collect()}
    nh, eh, own = got["nhentai:artist:some_name"], got["ehentai:group:circle"], got["archive:csv:group:circle"]
    assert (nh.canonical_name, nh.roman_name, nh.norm, nh.nh_artist_tag, nh.eh_tag, nh.verification_source) == ("Ｓｏｍｅ　Name", "Ｓｏｍｅ　Name", "some name", "some_name", "", "Unverified")
    assert (eh.eh_namespace, eh.eh_tag, eh.eh_artist_tag, eh.verification_source) == ("group", "circle", "", "OfflineDatabase") and own.verification_source == "Unverified"
    names = {r.id: r.source_key for r in k.source.collect()}
    assert sorted(names.values()) == ["csv", "eh-current", "nh-metadata-archive"] and names[nh.source_id] == "nh-metadata-archive"
    assert {(r.norm, r.alias_type) for r in k.alias.filter(F.col("entity_id") == nh.id).collect()} == {("some_name", "provider_tag"), ("some name", "roman")}
    # an entity of the base without the tag takes it
    old = spark.createDataFrame([(9, "x", "x", "x", "Artist", "nhentai:artist:some_name", True)], "id long, canonical_name string, roman_name string, norm string, kind string, external_id string, verified boolean")
    again = kb.merge(kb.Kb(old, *[getattr(base(spark, False), n) for n in ("identity", "alias", "relation")]), evidence, works, files)
    assert again.entity.filter("id = 9").first().nh_artist_tag == "some_name" and again.entity.count() == 3


def test_merge_of_many(spark):
    """102,582 identities, twice."""
    eh = "eh-tag-aggregate"
    row = lambda kind, n: spark.range(n).select(F.lit(eh).alias("source_id"), F.lit("t").alias("source_file"), F.concat(F.lit(f"tag:{kind}:"), "id").alias("gallery_id"), F.lit(kind).alias("entity_type"), F.concat(F.lit(f"{kind} "), "id").alias("name"), F.lower(F.concat(F.lit(f"{kind} "), "id")).alias("normalized_name"), F.lit("").alias("pretty_name"))
    evidence = row("Artist", 80_000).unionByName(row("Group", 22_582))
    works = spark.createDataFrame([], "source_id string, source_file string, gallery_id string")
    files = spark.createDataFrame([(eh, "t", "imported")], "source_id string, path string, state string")
    k = kb.merge(base(spark, False), evidence, works, files)
    assert sizes(k) == (102_582, 102_582, 0, 0, 0)
    ids = k.entity.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()
    assert tuple(ids) == (1, 102_582, 102_582)


def test_kb_pieces(spark):
    rows = spark.createDataFrame([("s", "f1", 1), ("s", "f2", 2), ("t", "f1", 3)], "source_id string, source_file string, v int")
    assert kb.replace_file(rows, None, "s", "f1").count() == 2
    assert kb.repeated_keys(rows, ["source_file"]).collect()[0].source_file == "f1"
    assert [r.v for r in kb.smallest_source(rows, ["source_file"], "source_id").orderBy("v").collect()] == [1, 2]
    ev = spark.createDataFrame([("Artist", "a", "A", "x", "")], "entity_type string, normalized_name string, name string, status string, entity_key string")
    res = spark.createDataFrame([("Artist", "a", "A", "Matched", "k")], ev.schema)
    assert kb.revalidated(ev, res).first().status == "Matched" and kb.revalidated(ev, res.limit(0)).first().status == "Unresolved"
    lib = spark.createDataFrame([(1, "p", "e", "", "", False), (2, "p", "f", "keep", "", True)], "id int, provider string, external_id string, canonical_name string, roman_name string, user_confirmed boolean")
    got = {r.id: (r.canonical_name, r.roman_name) for r in kb.provider_results(lib, lib.selectExpr("provider", "external_id", "'new' AS canonical_name", "'r' AS roman_name")).collect()}
    assert got == {1: ("new", "r"), 2: ("keep", "")}
    ent = spark.createDataFrame([(1, ""), (2, "old")], "id int, tag string")
    assert {r.id: r.tag for r in kb.filled_tags(ent, spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id int, name string"), "tag").collect()} == {1: "a", 2: "old"}
    assert kb.with_dimension(ent, spark.createDataFrame([(1, "one")], "k int, label string"), "id", "k", "label").filter("label = ''").count() == 1


# --- resolution


def test_decisions(spark):
    holders = spark.createDataFrame([("Artist", "shared", 1, True), ("Artist", "shared", 2, True), ("Artist", "first", 1, False), ("Group", "first", 9, False), ("Artist", "mixed", 1, True), ("Artist", "mixed", 2, False)], "kind string, norm string, entity_id long, user_confirmed boolean")
    names = holders.select("kind", "norm").distinct().unionByName(spark.createDataFrame([("Artist", "nobody")], "kind string, norm string"))

    def resolved(*decisions):
        d = spark.createDataFrame(list(decisions), "kind string, norm string, entity_id long, decision string")
        return {(r.kind, r.norm): (r.status, r.entity_id) for r in resolve.decided_names(names, holders, d).collect()}

    r = resolved()
    assert r["Artist", "shared"] == ("Ambiguous", None) and r["Artist", "first"] == ("Matched", 1) and r["Group", "first"] == ("Matched", 9) and r["Artist", "mixed"] == ("Matched", 1) and r["Artist", "nobody"] == ("NotFound", None)
    assert resolved(("Artist", "shared", 2, "Confirmed"))["Artist", "shared"] == ("Matched", 2)
    r = resolved(("Artist", "shared", None, "Independent"), ("Artist", "mixed", None, "Independent"))
    assert r["Artist", "shared"] == r["Artist", "mixed"] == ("Ambiguous", None)
    assert resolved(("Artist", "shared", None, "Disabled"))["Artist", "shared"] == ("NotFound", None)


def reached_by_hand(names, index):
    """key: how many targets, the least: pair by pair."""
    pairs = {(k, t) for k, *n in names for t, *m in index if n == m and None not in n}
    return {k: (len(own := [t for x, t in pairs if x == k]), min(own)) for k in {k for k, _ in pairs}}


def test_targets_are_counted_without_pairs(spark):
    """a key's targets by several names, some shared, some by none; then 6 billion pairs, which aren't made."""
    rng = random.Random(5)
    draw = lambda keys, most: [(k, rng.randrange(1, 3), rng.choice("abcde") if rng.random() < 0.9 else None) for k in range(keys) for _ in range(rng.randrange(most))]
    for names, index in ((draw(40, 5), draw(30, 4)), (draw(40, 2), draw(30, 4)), (draw(40, 5), [])):
        n, i = spark.createDataFrame(names, "id long, role int, norm string"), spark.createDataFrame(index, "folder long, role int, norm string")
        got = resolve.reached(n, i, "id", "folder", ["role", "norm"])
        assert {r.id: (r.targets, r.folder) for r in got.collect()} == reached_by_hand(names, index) and got.columns == ["id", "targets", "folder"]
    two = lambda rows, key: spark.range(rows).select(F.col("id").alias(key), F.explode(F.array((F.col("id") % 2).cast("string"), F.lit("7"))).alias("norm"))
    r = resolve.reached(two(300_000, "id"), two(20_000, "folder"), "id", "folder").groupBy("targets", "folder").count().collect()
    assert [tuple(x) for x in r] == [(20_000, 0, 300_000)]


def test_sets_of_names_stand_for_their_keys(spark):
    """either side or both, sets against sets, as key by key."""
    rows = lambda n, key: spark.range(n).select(F.col("id").alias(key), F.explode(F.array(F.struct(F.lit(1).alias("role"), (F.col("id") % 3).alias("norm")), F.struct(F.lit(2).alias("role"), (F.col("id") % 4).alias("norm"))))).select(key, "col.*")
    q, r = rows(200, "id").filter("id % 5 <> 0 OR role = 1"), rows(150, "folder")
    side = lambda x, k: x.filter(F.col("role") == k).drop("role")
    want = resolve.structured_hits(*[resolve.norm_join(side(q, k), side(r, k), "id", "folder") for k in (1, 2)], "id", "folder")
    want = resolve.cascade([(want, "Choice")], "id", "folder")
    (asked, sets), (owners, held) = resolve.alike(q, "id", ["role", "norm"]), resolve.alike(r, "folder", ["role", "norm"])
    assert (sets.select("id").distinct().count(), held.select("folder").distinct().count()) == (15, 12)
    hits = resolve.structured_hits(*[resolve.norm_join(side(sets, k), side(held, k), "id", "folder") for k in (1, 2)], "id", "folder")
    got = resolve.of_members(resolve.first_stage([(resolve.counted(hits, owners, "id", "folder"), "Choice")], "id", "folder"), asked, "id")
    rows_of = lambda x: sorted(map(tuple, x.select("id", "stage", "status", "folder", "targets").collect()))
    assert rows_of(got) == rows_of(want) and got.count() == 200


def test_cascades_of_common_names(spark):
    """Names that all keys and all targets share: 2 billion pairs a stage, which aren't made; the first stage that finds any decides."""
    names = spark.range(100_000).select("id", (F.col("id") % 2).cast("string").alias("norm"))
    index = spark.range(20_000).select(F.col("id").alias("folder"), F.lit(1).alias("role"), F.lit("1").alias("norm"))
    index = index.unionByName(index.select(F.col("folder") + 50_000, F.lit(2).alias("role"), F.lit("0").alias("norm")).toDF("folder", "role", "norm"))
    entities = names.select("id", F.when(F.col("norm") == "0", resolve.AMBIGUOUS).otherwise(resolve.FOUND).alias("status"), F.col("norm").cast("long").alias("entity_id"))
    known = spark.createDataFrame([(1, "0"), (1, "1")], "entity_id long, norm string")
    sums = lambda x: sorted(map(tuple, x.groupBy("stage", "status", "folder", "targets").count().collect()))
    assert sums(resolve.role_cascade(names, index, entities, known, "id", "folder")) == [(2, "Choice", None, 20_000, 50_000), (3, "Choice", None, 20_000, 50_000)]
    only_entity = resolve.role_cascade(names.withColumn("norm", F.lit("none")), index, entities, known, "id", "folder")
    assert sums(only_entity) == [(6, "Ambiguous", None, 0, 50_000), (6, "Choice", None, 40_000, 50_000)]
    one = resolve.reached(names.filter("id = 3"), index.filter("folder = 9"), "id", "folder")
    all_ = resolve.reached(names, index.filter("role = 1"), "id", "folder")
    assert sums(resolve.first_stage([(one, "Choice"), (all_, "Ambiguous")], "id", "folder")) == [(1, "Matched", 9, 1, 1), (2, "Ambiguous", None, 20_000, 49_999)]


def test_resolve_pieces(spark):
    o = spark.createDataFrame([("k", "", 0), ("", "v1", 7), ("", "v0", 7), ("twice", "v1", 7)], "public_entity_key string, database_version string, original_public_id long")
    keys = spark.createDataFrame([("k", 3), ("twice", 4), ("twice", 5), ("x", 7)], "key string, entity_id long")
    assert sorted((r.public_entity_key, r.database_version, r.entity_id) for r in resolve.bound(o, keys, "v1").collect()) == [("", "v0", None), ("", "v1", 7), ("k", "", 3), ("twice", "v1", None)]
    files = spark.createDataFrame([("f1", "Matched", "a", False, False, 1), ("f1", "Matched", "b", True, False, 2), ("f2", "Matched", "a", False, False, 1), ("f2", "Choice", "b", False, False, 2), ("f3", "Ambiguous", None, False, False, 1), ("f4", "Matched", "c", False, True, 1), ("f5", "NotFound", None, False, False, 1)], "file string, status string, target string, known boolean, cautious boolean, position int")
    assert {r.file: (r.status, r.target) for r in resolve.combined(files, "file", "target").collect()} == {"f1": ("Matched", "b"), "f2": ("Choice", None), "f3": ("Ambiguous", None), "f4": ("Matched", "c"), "f5": ("NotFound", None)}
    soc, cre = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id int, t string"), spark.createDataFrame([(1, "y"), (3, "w")], "id int, t string")
    assert sorted(tuple(r) for r in resolve.structured_hits(soc, cre, "id", "t").collect()) == [(1, "y"), (2, "z"), (3, "w")]
    kids = spark.createDataFrame([(1, "a"), (2, "b")], "author_id long, v string")
    assert resolve.remapped(kids, spark.createDataFrame([(1, 10)], "old_id long, new_id long"), "author_id").collect()[0].author_id == 10
    online = spark.createDataFrame([("q", "a", True, 92, False, False), ("q", "b", False, 99, False, False), ("r", "a", True, 92, True, False), ("s", "a", True, 80, False, False)], "k string, candidate string, exact boolean, score int, conflict boolean, likely_group boolean")
    assert {r.k: r.candidate for r in resolve.online_confirmed(online, "k").collect()} == {"q": "a", "r": None, "s": None}
    lines = spark.createDataFrame([(1, "First|shared|one"), (2, "Second|shared|two"), (3, "unparsed-rule")], "line long, v string")
    groups = readers.alias_groups(lines)
    assert groups.select("line").distinct().count() == 2
    held = groups.select(F.lit("Artist").alias("kind"), F.lower("alias").alias("norm"), F.col("line").alias("entity_id"), F.lit(True).alias("user_confirmed"))
    got = {r.norm: r.status for r in resolve.decided_names(held.select("kind", "norm").distinct(), held, spark.createDataFrame([], "kind string, norm string, entity_id long, decision string")).collect()}
    assert got["one"] == "Matched" and got["shared"] == "Ambiguous"


@pytest.mark.parametrize(("scores", "want"), [([59], "None"), ([60], "Choice"), ([99], "Choice"), ([100], "Matched"), ([100, 81], "Choice"), ([100, 80], "Matched"), ([60, 40, 39], "Choice"), ([70, 55], "Choice"), ([120, 100, 99], "Matched"), ([110, 100, 89], "Choice"), ([0], "None")])
def test_decision(spark, scores, want):
    df = spark.createDataFrame([("f", f"d{i}", s) for i, s in enumerate(scores)], "f string, d string, score int")
    r = scoring.decided(df, "f", "d").first()
    able = [f"d{i}" for i, s in enumerate(scores) if s >= 60 and s + 20 >= scores[0]]
    assert (r.status, r.score, r.runner_up) == (want, scores[0], scores[1] if len(scores) > 1 else 0)
    assert list(r.candidates) == (able if want == "Choice" else []) and r.choices == len(r.candidates)


@pytest.mark.parametrize(("region", "name", "want"), [("abxd", "abcd", 70), ("abx", "abc", 0), ("abxyef", "abcdef", 55), ("abxye", "abcde", 0), ("abcdef", "abcdefgh", 55), ("abcdefghi", "abcdef", 40), ("日本語x", "日本語", 40), ("日本", "日本語", 45), ("ab", "ab", 0), ("abcd", "abc", 40), ("ab", "abc", 0), ("xab", "ab", 0), ("abd", "abcd", 70), ("abcd", "abcd", 40), ("", "abcd", 0)])
def test_fuzzy(spark, region, name, want):
    assert one(spark, scoring.fuzzy_score(F.array(F.lit("zzzzzzzz"), F.col("a")), F.col("b")), a=region, b=name) == want


def test_scores(spark):
    none = F.array().cast("array<string>")

    def s(text, name, raw=None, alias=False, folder=False, creators=none, tags=none):
        t = F.lit(text)
        return one(spark, scoring.identity_score(scoring.search_form(t), t, scoring.regions(t), creators, tags, F.col("i"), F.lit(raw or name), F.lit(alias), F.lit(folder)), i=name)

    assert s("[abc] x", "abc") == 125 and s("x [abc]", "abc") == 110 and s("x abc", "abc") == 100 and s("ABC", "abc") == 115
    assert s("x abc", "abc", raw="a b c") == 95 and s("x abc", "abc", raw="a b c", alias=True) == 100
    assert s("[abc] x", "abc", folder=True, creators=F.array(F.lit("abc"))) == 175
    assert s("x abc", "abc", tags=F.array(F.lit("an abc tag"))) == 0 and s("[ab] x", "ab", folder=True) == 75
    assert s("xabc", "abc") == 40 and s("xab", "ab") == 0 and s("a(b", "a(b") == 115 and s("", "abc") == 0 and s("abc", "") == 0
    assert s("abcx abc", "abc") == 100  # the first complete place, not the first place
    df = spark.createDataFrame([("f", "d", 80), ("f", "d", 90), ("f", "e", 90)], "f string, d string, score int")
    assert {r.d: r.score for r in scoring.folder_scores(df, ["f", "d"]).collect()} == {"d": 110, "e": 90}


def test_scores_from_file_to_decision(spark):
    """Names of files, folders and aliases in; decisions out."""
    files = spark.createDataFrame([(1, "(C99) [Circle (Some Artist)] work"), (2, "[somebody else] work"), (3, "xyz"), (4, "[Ａｌｉａｓ] work"), (5, "[pixiv] work"), (6, "some artizt - work")], "file long, name string")
    folders = spark.createDataFrame([("A", "Some Artist", None), ("B", "[Somebody Else]", "Nick"), ("C", "pixiv", None)], "folder string, name string, preferred string")
    aliases = spark.createDataFrame([("B", "alias")], "folder string, name string")
    prepared = scoring.prepared_files(files, "file", "name")
    identities = scoring.folder_identities(folders, aliases)
    assert {(r.folder, r.norm, r.confirmed, r.own) for r in identities.collect()} == {("A", "some artist", False, True), ("B", "somebody else", False, True), ("B", "nick", False, True), ("B", "alias", True, False), ("C", "pixiv", False, True)}
    pairs = files.select("file").crossJoin(folders.select("folder"))
    scores = scoring.scored_pairs(pairs, prepared, identities, "file")
    got = {r.file: (r.status, r.folder) for r in scoring.decided(scores, "file", "folder").collect()}
    assert got[1] == ("Matched", "A") and got[2] == ("Matched", "B") and got[3] == ("None", None) and got[4] == ("Matched", "B") and got[6][0] == "None"


def test_blocking_by_prefix(spark):
    """What the join of all grams gives, ties and short names included, with fewer pairs looked at."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))
    left = spark.createDataFrame([(i, " ".join(word() for _ in range(r.randint(1, 3)))) for i in range(60)] + [(90, ""), (91, "a"), (92, "zz")], "id long, a string")
    right = spark.createDataFrame([(i, word() + ("x" if i % 3 else "")) for i in range(150)] + [(900, "a"), (901, "")], "folder long, b string")
    for top in (1, 5, 24):
        want = {tuple(x) for x in scoring.blocked(left, right, "id", "a", "folder", "b", top).collect()}
        got, report = scoring.blocked_by_prefix(left, right, "id", "a", "folder", "b", top)
        assert {tuple(x) for x in got.collect()} == want
        assert {x["round"] for x in report.collect()} == {1, 2}
    all_pairs = scoring.blocked(left, right, "id", "a", "folder", "b", None).count()
    first, second = (x.pairs for x in report.orderBy("round").collect())
    assert first < all_pairs and second < all_pairs


# --- snapshots


def files(spark, rows):
    return spark.createDataFrame(rows, "key string, sig string, name string, pos long")


def model_delta(old, new):
    """One new row after another."""
    known, seen, out = {k: (s, n) for k, s, n, _ in old}, {k for k, *_ in new}, []
    missing: dict = {}
    for k, (s, n) in known.items():
        if k not in seen:
            missing.setdefault(s, []).append((k, n))
    taken = set()
    for k, s, n, _ in sorted(new, key=lambda r: r[3]):
        if k in known:
            out.append(("CacheHit" if known[k][0] == s else "Modified", k, k))
        elif len(missing.get(s, ())) == 1 and missing[s][0][0] not in taken:
            o, on = missing[s][0]
            taken.add(o)
            out.append(("Moved" if on == n else "Renamed", o, k))
        else:
            out.append(("Added", None, k))
    return out + [("Removed", k, None) for k in known if k not in seen and k not in taken]


def test_delta_against_a_model(spark):
    r = random.Random(8)
    old = [(f"k{i}", f"s{r.randrange(40)}", f"n{r.randrange(5)}", i) for i in range(80)]
    new = [(f"k{i}" if r.random() < 0.6 else f"m{i}", s if r.random() < 0.8 else "changed", n if r.random() < 0.7 else "other", 100 - i) for i, (_, s, n, _) in enumerate(old) if r.random() < 0.9]
    got = [tuple(x) for x in cdc.delta(files(spark, old), files(spark, new), "key", "sig", "name", "pos").collect()]
    assert sorted(got, key=repr) == sorted(model_delta(old, new), key=repr)


def test_counters(spark):
    rows = [(f"k{i}", f"s{i}", f"n{i}", i) for i in range(8490)]
    n = lambda a, b: {r.kind: r["rows"] for r in cdc.counters(cdc.delta(files(spark, a), files(spark, b), "key", "sig", "name", "pos")).collect()}
    assert n(rows, rows) == {"CacheHit": 8490}
    assert n(rows, [("k0", "x", "n0", 0), *rows[1:]]) == {"CacheHit": 8489, "Modified": 1}
    assert n(rows, rows[1:]) == {"CacheHit": 8489, "Removed": 1}
    assert n([], rows[:256]) == {"Added": 256}
    assert n([("a", "s", "n", 0)], [("b", "s", "n", 0), ("c", "s", "n", 1)]) == {"Moved": 1, "Added": 1}
    assert n([("a", "s", "n", 0), ("b", "s", "n", 0)], [("c", "s", "n", 0)]) == {"Added": 1, "Removed": 2}
    inv = cdc.invalidated(cdc.delta(files(spark, [("a", "s", "n", 0)]), files(spark, [("b", "s", "n", 0)]), "key", "sig", "name", "pos")).first()
    assert inv.plan and not inv.recognition


def test_scopes(spark):
    members = spark.createDataFrame([("zip", 1), ("rar", 2), ("zip", 3), ("all", 3)], "scope_key string, file_id long")
    known = spark.createDataFrame([(1,), (2,), (3,)], "file_id long")
    seen = spark.createDataFrame([(1,)], "file_id long")
    state = lambda **k: tuple(sorted(r.file_id for r in x.collect()) for x in cdc.scoped(members, known, seen, "zip", **k))
    assert state(known=True, shallow=False) == ([1, 2], [1, 2])  # what another scope holds goes too
    assert state(known=True, shallow=True) == ([1, 2, 3], [1, 2, 3])
    assert state(known=False, shallow=False) == ([1, 2, 3, 3], [1, 2, 3])


def test_files(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("C:/a/B.zip", 10, t, t, ".zip"), ("C:\\A\\b.ZIP\\", 10, t, t, ".ZIP")], "full_path string, file_size long, last_write_utc timestamp, creation_utc timestamp, extension string")
    r = cdc.with_signature(df).collect()
    assert r[0].key == r[1].key and r[0].signature == r[1].signature
    moves = spark.createDataFrame([("c:\\a\\b.zip", "C:/x", 1), ("C:/A/B.zip", "C:/y", 2)], "old_path string, new_path string, seq int")
    assert {x.full_path for x in cdc.applied(df, moves).collect()} == {"C:/y"}
    ev = spark.createDataFrame([("a", t), ("b", t)], "path string, at timestamp")
    ex = spark.createDataFrame([("A", t - dt.timedelta(seconds=9)), ("b", t - dt.timedelta(seconds=11))], "path string, at timestamp")
    assert [x.path for x in cdc.others_changes(ev, ex).collect()] == ["b"]
    order = spark.createDataFrame([("old", t, 0), ("latest", t + dt.timedelta(1), 1), ("same", t + dt.timedelta(1), 2), ("unknown", None, 3)], "n string, at timestamp, pos int")
    assert [x.n for x in report.latest_first(order, "at", "pos").collect()] == ["latest", "same", "old", "unknown"]


def test_stream(spark, tmp_path):
    schema = files(spark, []).schema
    kept, counts = [], []

    def save(found, snapshot, _):
        counts.append({r.kind: r["rows"] for r in cdc.counters(found).collect()})
        kept[:] = [snapshot.collect()]

    state = lambda: spark.createDataFrame(kept[0], schema) if kept else None
    for rows in ([("a", "1", "n", 0), ("b", "2", "n", 1)], [("a", "9", "n", 0), ("c", "2", "n", 1)]):
        files(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = changes.reconcile_stream(changes.snapshots(spark, str(tmp_path / "in"), schema), state, save, "key", "sig", "name", "pos", str(tmp_path / "cp"))
        q.awaitTermination()
    assert counts == [{"Added": 2}, {"Modified": 1, "Moved": 1}]


def test_stream_windows(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(t + dt.timedelta(minutes=m), "u") for m in (0, 1, 2, 40, 41, 200)], "at timestamp, k string")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    for name, out, want in (("tumble", changes.tumbling(stream, "at", "30 minutes", "10 minutes", ["k"]), {3, 2, 1}), ("sess", changes.sessions(stream, "at", "20 minutes", "10 minutes", ["k"]), {3, 2, 1})):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {r.events for r in spark.table(name).collect()} == want


# --- plans


def test_own_changes_whatever_the_ids_are(spark, tmp_path):
    """ids that start again with the time, as in copies of a table: no event is late, and each is judged by its path's announcements."""
    rng = random.Random(3)
    at = [dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 4)) for _ in range(300)]
    rows = [(i + copy * 300, at[i], rng.randrange(5)) for copy in range(2) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    said = [(u, ts) for i, ts, u in rows if i % 4 == 0]
    want = sorted(i for i, ts, u in rows if not any(u == v and x <= ts <= x + dt.timedelta(seconds=3600) for v, x in said))
    assert sorted(r.event_id for r in more_queries.stream_own_changes(spark, str(tmp_path)).collect()) == want and 0 < len(want) < 450


def test_paths_in_shares(spark, tmp_path):
    """many paths of one share; seen again, changed, said to be gone, a lease that ends, a null position, and a repeated announcement."""
    hour = lambda h: dt.datetime(2026, 1, 1, h)
    schema = "key string, signature string, name string, pos long, gone boolean, at timestamp"
    first = [(f"p{i}", f"s{i}", "n", i if i % 3 else None, False, hour(1)) for i in range(40)]
    again = [(f"p{i}", f"s{i}" if i % 2 else "new", "n", i, i % 5 == 0, hour(2)) for i in range(30)] + [first[1], (None, None, None, None, False, hour(9))]
    own, path, out = stateful.stateful_session(spark), f"{tmp_path}/in", f"{tmp_path}/out"
    stream = lambda: stateful.changes_of_paths(changes.snapshots(own, path, spark.createDataFrame([], schema).schema, 9), "10 minutes", 5_400_000, shares=2)
    more_queries.told(stream, out, f"{tmp_path}/state", [[(spark.createDataFrame(x, schema), path)] for x in (first, again)])
    ms = lambda h: int(hour(h).replace(tzinfo=dt.UTC).timestamp() * 1000)
    pos = lambda i: i if i % 3 else None
    want = [("Added", f"p{i}", pos(i), ms(1)) for i in range(40)]
    want += [("Removed", f"p{i}", pos(i), ms(2)) if i % 5 == 0 else ("CacheHit" if i % 2 else "Modified", f"p{i}", i, ms(2)) for i in range(30)]
    want += [("Removed", f"p{i}", pos(i), ms(1) + 5_400_000) for i in range(30, 40)] + [("Removed", f"p{i}", i, ms(2) + 5_400_000) for i in range(30) if i % 5]
    assert sorted(map(repr, ((r.kind, r.key, r.pos, r.ms) for r in spark.read.parquet(out).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize(("highest", "occupied", "most"), [(3, 13, 20), (1, 0, 5), (4, 5, 5), (2, 9, 4)])
def test_allocation(spark, highest, occupied, most):
    got = [r.g for r in spark.range(60).select(planning.group_of_new(F.col("id"), highest, occupied, most).alias("g")).collect()]
    group, count, want = highest, occupied, []
    for _ in range(60):
        while count >= most:
            group, count = group + 1, 0
        count += 1
        want.append(group)
    assert got == want
    with pytest.raises(ValueError):
        planning.group_of_new(F.lit(0), 1, 0, 0)


def test_linked_identities(spark):
    r = random.Random(9)
    rows = [(f"f{i}", i, sorted({f"n{r.randrange(25)}" for _ in range(r.randint(1, 3))})) for i in range(60)]
    makers, want = [], {}
    for f, _, norms in rows:
        owner = next((m for m, own in makers if own & set(norms)), None)
        if owner is None:
            makers.append((f, set(norms)))
        want[f] = owner or f
    df = spark.createDataFrame(rows, "file string, pos long, norms array<string>")
    assert {x.file: x.identity for x in planning.linked_identities(df, "file", "pos", "norms").collect()} == want


def test_rules_as_a_table(spark):
    """Against the rules as Columns, regular expressions, short and empty patterns included; no join without an equality."""
    r = random.Random(5)
    word = lambda most: "".join(r.choice("abAB.") for _ in range(r.randint(0, most)))
    own = [rules.Rule(f"r{i}", r.choice([rules.EXACT, rules.STARTS, rules.ENDS, rules.CONTAINS]), word(5)) for i in range(60)] + [rules.Rule("x", rules.REGEX, "^b+a")]
    r.shuffle(own)
    rows = spark.createDataFrame([(i, word(9)) for i in range(120)] + [(500, None)], "id long, n string")
    table = spark.createDataFrame([(i, x.name, x.kind, x.pattern) for i, x in enumerate(own)], "ord long, name string, kind string, pattern string")
    got = rules.first_hit_by_table(rows, "id", "n", table)
    want = rows.select("id", rules.first_hit(F.coalesce("n", F.lit("")), [x for x in own if x.pattern]).alias("rule")).filter("rule IS NOT NULL")
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    paths = spark.createDataFrame([("root/" + "/".join(word(3) or "z" for _ in range(r.randint(1, 4))), "root") for _ in range(80)], "path string, root string").distinct()
    assert {tuple(x) for x in rules.folder_hit_by_table(paths, "path", "root", table).collect()} == {tuple(x) for x in rules.folder_hit(paths, "path", "root", [x for x in own if x.pattern]).collect()}


def test_equal_rules_and_texts_are_judged_once(spark):
    """of equal rules the first, whatever their case; 2 billion hits of equal texts on equal rules aren't made; of a key's texts the first rule of any."""
    table = spark.range(100_000).select(F.col("id").alias("ord"), F.concat(F.lit("r"), "id").alias("name"), F.lit(rules.CONTAINS).alias("kind"), F.when(F.col("id") % 2 == 0, "A").otherwise("b").alias("pattern"))
    rows = spark.range(20_000).select((F.col("id") - F.col("id") % 2 * (F.col("id") == 7).cast("int")).alias("id"), F.when(F.col("id") % 2 == 0, "xB").otherwise("xAb").alias("n"))
    got = rules.first_hit_by_table(rows, "id", "n", table)
    assert sorted(map(tuple, got.groupBy("rule").count().collect())) == [("r0", 10_000), ("r1", 9_999)]  # 6 has two texts
    assert rules.hits_by_table(rows.filter("id = 1"), "id", "n", table.limit(10)).count() == 10


def test_scopes_at_once(spark):
    """Each scope alone against all of them together."""
    files = spark.createDataFrame([(1, "a"), (2, "a/b"), (3, "A\\B\\c"), (4, "ab"), (5, "a/b/")], "file_id long, directory string")
    scopes = spark.createDataFrame([("x", "a", True), ("y", "a/b", False), ("z", "a\\b", True)], "scope_key string, root string, recursive boolean")
    got = {(r.scope_key, r.file_id) for r in rules.scopes_of(files, "file_id", "directory", scopes).collect()}
    for s in scopes.collect():
        want = {r.file_id for r in files.filter(rules.in_scope(F.col("directory"), F.lit(s.root), s.recursive)).collect()}
        assert {f for k, f in got if k == s.scope_key} == want
    members = spark.createDataFrame([(k, f) for k in "pq" for f in range(6)], "scope_key string, file_id long")
    every, seen = members.select("file_id").distinct(), spark.createDataFrame([(1,), (2,), (9,)], "file_id long")
    for known in (True, False):
        for shallow in (True, False):
            want = cdc.scoped(members, every, seen, "p", known, shallow)
            one = spark.createDataFrame([("p", known, shallow, False)], "scope_key string, known boolean, shallow boolean, safe boolean")
            got = cdc.scoped_many(members, every, seen.select(F.lit("p").alias("scope_key"), "file_id"), one)
            for a, b in zip(got, want, strict=True):
                assert {tuple(x) for x in a.collect()} == {tuple(x) for x in b.select(a.columns).collect()}


def test_long_chains_of_names(spark):
    """A chain of 10,000 links in 20 steps at most; a name that all share; and what hangs between two chains."""
    rows = spark.range(10_000).select(F.col("id").alias("file"), F.col("id").alias("pos"), F.array(F.concat(F.lit("n"), "id"), F.concat(F.lit("n"), F.col("id") + 1)).alias("norms"))
    trace: list = []
    got = planning.linked_identities(rows, "file", "pos", "norms", trace)
    assert got.filter((F.col("file") - F.col("file") % 2) != F.col("identity")).isEmpty() and got.count() == 10_000
    assert len(trace) <= 20
    everyone = spark.range(500).select(F.col("id").alias("file"), F.col("id").alias("pos"), F.array(F.lit("all"), F.concat(F.lit("own"), "id")).alias("norms"))
    assert {r.identity for r in planning.linked_identities(everyone, "file", "pos", "norms").collect()} == {0}


def test_labels_without_a_group(spark):
    g = spark.createDataFrame([("a", 1, "circle", " "), ("b", 1, "x", "X"), ("b", 2, "x", "Y"), ("c", 3, "m", "M"), ("c", 3, "n", "M")], "artist string, group_id int, group_norm string, group_name string")
    f = spark.createDataFrame([("a", "circle", "A", "Circle"), ("b", "x", "B", "X"), ("c", "n", "C", "n"), ("d", "x", "D", "X"), ("c", None, "C", None)], "artist string, society string, artist_name string, society_name string")
    assert sorted((r.artist, r.society or "", r.label) for r in planning.canonical_label(f, g, "artist", "society").collect()) == [("a", "circle", "Circle (A)"), ("b", "x", "B"), ("c", "", "C"), ("c", "n", "M (C)"), ("d", "x", "D")]


def test_search(spark):
    e = spark.createDataFrame([(1, "Group", "B", "b"), (2, "Artist", "A", "a_1"), (3, "Artist", "C", "ax1"), (4, "Artist", "D", "d")], "id long, kind string, canonical_name string, norm string")
    alias, tag = spark.createDataFrame([(4, "zz a.1")], "entity_id long, norm string"), spark.createDataFrame([(1, "a%1")], "entity_id long, norm string")
    assert [r.id for r in kb.searched(e, alias, "Ａ_1", identity=tag).collect()] == [2, 3, 4, 1]
    assert [r.id for r in kb.searched(e, alias, " ", limit=2).collect()] == [4, 3] and kb.searched(e, alias, "\\").count() == 0


def test_versions(spark, tmp_path):
    """Of writers on one base exactly one wins; readers keep to their version."""
    from concurrent.futures import ThreadPoolExecutor

    from archivolt.sources.versions import Conflict, Versions

    table = Versions(spark, f"file://{tmp_path}/t")
    assert table.latest() == 0 and table.manifest() == {}
    one = table.publish(spark.range(3), 0)
    pinned = table.table(one)

    def write(i):
        try:
            return Versions(spark, f"file://{tmp_path}/t").publish(spark.range(10 + i), one)
        except Conflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [x for x in pool.map(write, range(6)) if x]
    assert won == [2] == [table.latest()] and pinned.count() == 3 and 10 <= table.table().count() < 16
    with pytest.raises(Conflict):
        table.publish(spark.range(1), 0)


def test_pairs_by_difference(spark, tmp_path):
    """After any series of additions, replacements and withdrawals: what counting everything anew gives."""
    from archivolt.operators import incremental

    r = random.Random(4)
    store, now = incremental.PairStore(spark, f"file://{tmp_path}/p"), {}
    for step in range(5):
        new = {(r.choice("st"), f"f{r.randrange(4)}"): [(str(r.randrange(6)), kind, r.choice("abc") + kind) for kind in ("Artist", "Group") for _ in range(6)] for _ in range(2)}
        gone = {k for k in now if r.random() < 0.3 and k not in new}
        rows = [(s, f, *x) for (s, f), xs in new.items() for x in xs]
        store.change(spark.createDataFrame(rows, incremental.EVIDENCE) if step != 3 else None, gone)
        now = {k: v for k, v in now.items() if k not in gone} | (new if step != 3 else {})
        want: dict = {}
        for s in "st":
            for g in map(str, range(6)):
                top = max((f for (z, f), xs in now.items() if z == s and any(x[0] == g for x in xs)), default=None)
                own = now.get((s, top), [])
                for a in {x[2] for x in own if x[0] == g and x[1] == "Artist"}:
                    for b in {x[2] for x in own if x[0] == g and x[1] == "Group"}:
                        want[s, a, b] = want.get((s, a, b), 0) + 1
        assert {tuple(x)[:3]: x.weight for x in store.by_source().collect()} == want, step


def test_faults_of_a_library(spark, tmp_path):
    """Each way in which a library can be broken, and a sound one."""
    import json

    sound = {
        "authors": [{"id": 1}, {"id": 2}], "circles": [{"id": 5}], "aliases": [{"author_id": 1, "alias": "a"}], "circle_aliases": [{"circle_id": 5, "alias": "c"}], "author_circles": [{"author_id": 1, "circle_id": 5}],
        "name_decisions": [{"name": "n", "entity_type": "Artist", "entity_id": 1, "status": "Confirmed"}, {"name": "m", "entity_type": "Group", "entity_id": 9, "status": "Disabled"}],
        "public_overrides": [{"id": "o", "added_aliases": [], "disabled_names": [], "original_names": [], "user_groups": [{"circle_id": 5}]}],
        "legacy_alias_groups": [{"id": "g", "canonical": "G", "names": ["x"], "author_id": 0}],
    }
    over = sound["public_overrides"][0]
    broken = {
        ("authors", "id"): {"authors": [{"id": 1}, {"id": 1}, {"id": 2}]}, ("authors", "null"): {"authors": [{"id": 1}, {"id": 2}, None]}, ("circles", "id"): {"circles": [{"id": 5}, {"id": 0}]},
        ("aliases", "reference"): {"aliases": [{"author_id": 3}]}, ("circle_aliases", "reference"): {"circle_aliases": [{"circle_id": 6}]}, ("author_circles", "reference"): {"author_circles": [{"author_id": 1, "circle_id": 6}]},
        ("name_decisions", "reference"): {"name_decisions": [{"name": "n", "entity_type": "Group", "entity_id": 1, "status": "Confirmed"}]},
        ("public_overrides", "id"): {"public_overrides": [over, over]}, ("public_overrides", "list"): {"public_overrides": [{**over, "original_names": None}]}, ("public_overrides", "reference"): {"public_overrides": [{**over, "user_groups": [{"circle_id": 6}]}]},
        ("legacy_alias_groups", "id"): {"legacy_alias_groups": [{"id": " ", "canonical": "G", "names": ["x"]}]}, ("legacy_alias_groups", "name"): {"legacy_alias_groups": [{"id": "g", "canonical": "G", "names": ["x", " "]}]},
        ("legacy_alias_groups", "reference"): {"legacy_alias_groups": [{"id": "g", "canonical": "G", "names": ["x"], "author_id": 7}]},
    }
    for i, (want, change) in enumerate({None: {}, **broken}.items()):
        path = tmp_path / f"l{i}.json"
        path.write_text(json.dumps(sound | change))
        got = {(r.list, r.fault) for r in readers.library_faults(readers.library(spark, str(path))).collect()}
        assert got == ({want} if want else set()), (want, got)


def test_provider_results(spark):
    """Found, made once, kept as confirmed; aliases, groups and lookups."""
    from archivolt.operators import providers

    author = "id long, canonical_name string, roman_name string, eh_artist_tag string, nh_artist_tag string, source string, external_id string, entity_type string, verification_source string, eh_namespace string, eh_tag string, verified boolean, user_confirmed boolean"
    result = "seq long, provider string, query string, external_id string, tag string, namespace string, entity_type string, evidence array<string>, other_names array<string>, group_name string, checked_utc string"
    lib = providers.Library(
        spark.createDataFrame([(1, "", "", "some_tag", "", "E-Hentai", "7", "Artist", "", "artist", "some_tag", False, False), (2, "Mine", "", "", "mine", "nHentai", "9", "Artist", "", "artist", "mine", False, True), (3, "Eh", "eh", "eh_x", "eh_x", "E-Hentai", "5", "Artist", "EHTagExact", "artist", "eh_x", False, False), (4, "t", "", "twice", "", "E-Hentai", "", "Artist", "", "artist", "", False, False), (5, "t", "", "twice", "", "E-Hentai", "", "Artist", "", "artist", "", False, False)], author),
        spark.createDataFrame([(1, "Some Tag", "x", "x")], "author_id long, alias string, alias_type string, source string"), spark.createDataFrame([(20, "Circle One", "", "", "u")], "id long, canonical_name string, eh_group_tag string, nh_group_tag string, source string"),
        spark.createDataFrame([(1, 20, "u")], "author_id long, circle_id long, source string"), spark.createDataFrame([("EH", "q", "q one", "none", 0, "old", ""), ("EH", "z", "z", "none", 0, "old", "")], "provider string, query string, query_norm string, status string, author_id long, checked_utc string, detail string"),
    )
    eh, nh = ["E-Hentai/Tag"], ["nHentai/Tag"]
    rows = [
        (1, "eh", "Q　One", "7", "some_tag", "artist", "Artist", eh, ["別名_x"], "circle one", "now"), (2, "nHentai", "mine", "9", "mine", "artist", "Artist", nh, [], "g", "now"), (3, "nHentai", "ehx", "", "eh_x", None, None, nh, None, None, "now"),
        (4, "nHentai", "fresh", "50", "fresh_name", "artist", None, nh, [], "New_Group", "now"), (5, "nHentai", "fresh again", "50", "fresh_name", "artist", "", nh, ["日本"], "new group", "now"), (6, "EH", "two", "", "twice", "artist", "", ["E-Hentai/TitleSearch"], [], None, "now"),
        (7, "x", "no", "", "t", "group", "", eh, [], None, "now"), (8, "x", "no", "", "t", "artist", "Group", eh, [], None, "now"), (9, "x", "no", "", "t", "artist", "Artist", ["EhTagTranslation/x"], [], None, "now"),
    ]
    out = providers.merged(lib, spark.createDataFrame(rows, result))
    a = {r.id: r for r in out.authors.collect()}
    assert set(a) == {1, 2, 3, 4, 5, 6, 7} and (a[2].canonical_name, a[2].source) == ("Mine", "nHentai") and a[2].user_confirmed
    assert (a[1].canonical_name, a[1].roman_name, a[1].verification_source) == ("別名 x", "some tag", "EHTagExact")
    assert a[3].source == "E-Hentai" and a[3].nh_artist_tag == "eh_x"  # verified by better evidence
    assert (a[6].canonical_name, a[6].nh_artist_tag, a[6].external_id, a[6].entity_type) == ("fresh name", "fresh_name", "50", "Artist") and (a[7].eh_artist_tag, a[7].verification_source) == ("twice", "EHTitleBridge")
    names = {(r.author_id, r.alias): r.alias_type for r in out.aliases.collect()}
    assert names[1, "Some Tag"] == "x" and names[1, "some_tag"] == "provider_tag" and names[1, "Q　One"] == "query" and names[1, "別名_x"] == "other_name" and (1, "some tag") not in names
    assert names[6, "fresh again"] == "query" and names[6, "日本"] == "other_name" and not any(i in (2, 3) for i, _ in names)
    c = {r.id: r for r in out.circles.collect()}
    assert set(c) == {20, 21, 22} and {(c[i].canonical_name, c[i].nh_group_tag) for i in (21, 22)} == {("New Group", "New_Group"), ("new group", "new group")}
    assert {(r.author_id, r.circle_id) for r in out.author_circles.collect()} == {(1, 20), (6, 21), (6, 22)}
    seen = {(r.provider.lower(), r.query_norm): r for r in out.lookups.collect()}
    assert seen["eh", "q one"].author_id == 1 and seen["eh", "z"].status == "none" and seen["nhentai", "mine"].detail == providers.PRESERVED and seen["nhentai", "ehx"].author_id == 3 and len(seen) == 7


def test_history_file(spark, tmp_path):
    session = spark.createDataFrame([("s1", 2)], "session string, files long")
    items = spark.createDataFrame([(2, 'b"x'), (1, "a,b"), (3, None)], "n long, name string")
    writers.history_file(session, items, ["n"], str(tmp_path / "h"))
    text_ = "".join(p.read_text() for p in sorted((tmp_path / "h").glob("part-*")))
    assert text_.split("\n")[:-1] == ['\ufeff"session","files"', '"s1","2"', "", '"n","name"', '"1","a,b"', '"2","b""x"', '"3",""']


def test_plan_pieces(spark):
    rows = spark.createDataFrame([(3, "b"), (1, "a"), (2, "B")], "id long, k string")
    assert [(r.id, r.n) for r in writers.numbered(rows, ["id"], "n").orderBy("id").collect()] == [(1, 0), (2, 1), (3, 2)]
    assert {(r.id, r.status) for r in planning.new_statuses(rows.withColumn("k", F.lower("k")), "k", "id").collect()} == {(1, "NewAuthor"), (2, "NewAuthor"), (3, "NewAuthorReuse")}
    assert planning.same_preview(rows, rows) and not planning.same_preview(rows, rows.limit(2))
    assert one(spark, planning.terminal_state(F.col("a"), F.col("b"), F.lit(True)), a="X", b="x") == "AlreadyInTarget"
    syn = planning.synthetic(spark, 300, 30, 7)
    assert syn.filter("changed").count() == 7 and syn.select("author").distinct().count() == 30
    cached = spark.createDataFrame([(1, "fp", "Error"), (2, "fp", "ok"), (3, "old", "ok")], "id int, fp string, status string")
    assert [r.id for r in planning.still_valid(cached, spark.createDataFrame([("fp",)], "fp string"), ["fp"]).collect()] == [2]
    g = spark.createDataFrame([("a", 1, "circle", "Circle"), ("b", 1, "x", "X")], "artist string, group_id int, group_norm string, group_name string")
    f = spark.createDataFrame([("a", "circle", "A"), ("b", "circle", "B")], "artist string, society string, artist_name string")
    assert sorted(r.label for r in planning.canonical_label(f, g, "artist", "society").collect()) == ["B", "Circle (A)"]
    assert planning.occupancy(spark.createDataFrame([(1,), (3,), (3,)], "g int"), "g") == (3, 2)


# --- sources and sinks


def test_monthly_file(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('﻿id,Artist,GROUP_NAME,EN_TITLE\n1,"A, ""q""\nline",g,t\n1,second,,\n0,zero,,\n-3,neg,,\nx,text,,\n2,N/A,[],\n', encoding="utf-8")
    rows = {r.gallery_id: r for r in readers.monthly_file(spark, str(p), "s", "m.csv").collect()}
    assert set(rows) == {"1", "2"} and rows["1"].artist_raw == 'A, "q"\nline' and rows["1"].english_title == "t"
    ev = readers.entity_evidence(readers.monthly_file(spark, str(p), "s", "m.csv"))
    assert {(r.entity_type, r.name) for r in ev.collect()} == {("Artist", "A"), ("Artist", '"q"'), ("Artist", "line"), ("Group", "g")}
    (tmp_path / "bad.csv").write_text("ID,ARTIST\n1,a\n")
    with pytest.raises(ValueError):
        readers.monthly_file(spark, str(tmp_path / "bad.csv"), "s", "b")


def test_dumps(spark):
    tags = spark.createDataFrame([(1, "artist:Foo"), (2, "group:Bar"), (3, "other:x"), (4, "artist:foo")], "id int, name string")
    links = spark.createDataFrame([(1, 10), (2, 10), (4, 10), (3, 11), (1, 12)], "tag_id int, gallery_id int")
    gallery = spark.createDataFrame([(10, "t", 0), (12, "u", 1)], "gid int, title string, expunged int")
    rows = readers.gallery_dump({"tag": tags, "gallery_tag": links, "gallery": gallery}).collect()
    assert [(r.gallery_id, r.title, r.artists, r.groups) for r in rows] == [("10", "t", ["Foo"], ["Bar"])]
    with pytest.raises(ValueError):
        readers.discover_link_tables({"tag": tags})


def test_other_readers(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for n in ("a.zip", "b.txt", "e/c.zip"):
        (tmp_path / "d" / n).write_text("x")
    assert readers.listing(spark, str(tmp_path / "d"), ["zip"]).count() == 2 and readers.listing(spark, str(tmp_path / "d"), [".zip"], recursive=False).count() == 1
    tree = spark.createDataFrame([("by_month/1.csv", "blob", "A" * 40, 5), ("by_month/2.csv", "tree", "a" * 40, 5), ("x.csv", "blob", "a" * 40, 5), ("by_month/3.csv", "blob", "zz", 5), ("by_month/4.csv", "blob", "a" * 40, 1 << 40)], "path string, type string, sha string, size long")
    assert [r.path for r in readers.manifest(tree, "by_month/", ".csv").collect()] == ["by_month/1.csv"]
    (tmp_path / "lib.json").write_text('{"authors": [{"id": 1, "canonical_name": "x"}], "aliases": [{"author_id": 1, "alias": "y"}, {"author_id": 2, "alias": "z"}]}')
    lib = readers.library(spark, str(tmp_path / "lib.json"))
    assert lib["authors"].count() == 1 and kb.dangling(lib["aliases"], lib["authors"], "author_id", "id").first().alias == "z" and lib["circles"].count() == 0
    (tmp_path / "alias.txt").write_text("# c\nA|b| B \nlone\n")
    assert [r.alias for r in readers.legacy_aliases(spark, str(tmp_path / "alias.txt")).orderBy("position").collect()] == ["A", "b"]
    html = '<a href="/g/12/AB/"><a href="/g/12/ab/"><a href="/g/3/cd/">'
    assert one(spark, readers.gallery_ids(F.col("h")), h=html) == ["12/ab", "3/cd"]


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    p = str(tmp_path / "t")
    writers.replace_whole(df, p)
    writers.replace_whole(spark.range(2), p)
    assert spark.read.parquet(p).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        writers.replace_whole(df.select(F.raise_error(F.lit("stop")).alias("id")), p)
    assert spark.read.parquet(p).count() == 2
    b = str(tmp_path / "v")
    assert writers.activate(spark, b, None) is None
    first = writers.stage(df, b, None)
    assert writers.activate(spark, b, None) == first
    second = writers.stage(spark.range(9), b, first)
    assert writers.activate(spark, b, "other") == "other"  # the current version is not what it was built from
    third = writers.stage(spark.range(3), b, first)
    assert writers.activate(spark, b, first) == third != second
    assert writers.upsert(df, spark.range(3, 8), ["id"]).count() == 8
    writers.history(df, df, str(tmp_path / "h"))
    assert spark.read.option("header", True).csv(str(tmp_path / "h" / "items")).count() == 5


def test_structured_ties(spark):
    """A tie by a structured alias, one by norms within aliases, one that neither settles."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    queries = frame([(1, "circle", "pen"), (2, "ring", "ann"), (2, "ring", "bob"), (3, "ring", "ann"), (4, "circle", "solo")], "id int, society string, creator string")
    groups = frame([("circle", 10), ("kreis", 10), ("ring", 20)], "norm string, group_id int")
    artists = frame([("pen", 1), ("pen", 2), ("ann", 3), ("ann", 4), ("solo", 5)], "norm string, artist_id int")
    relation = frame([(1, 10), (2, 10), (3, 20), (4, 20), (5, 10)], "artist_id int, group_id int")
    aliases = frame([(1, "Other (pen)"), (2, "Kreis (pen)"), (3, "Ann-Marie & Bobby"), (4, "Annabel")], "artist_id int, alias string")
    got = sorted(tuple(r) for r in resolve.structured_entities(queries, groups, artists, relation, "id", aliases).collect())
    assert got == [(1, "Matched", 2), (2, "Matched", 3), (3, "Ambiguous", None), (4, "Matched", 5)]
