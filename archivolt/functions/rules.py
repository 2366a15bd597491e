"""Rule tables as data, compiled to Columns: tag cleaning, exclusions, file types."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import nfkc, path_key, text_of

EXACT, CONTAINS, STARTS, ENDS, REGEX = "Exact", "Contains", "StartsWith", "EndsWith", "Regex"

#: The default rules for tags that aren't names.
CONTAINED = (
    "中国翻訳", "中国翻译", "中文翻訳", "中文翻译", "翻訳", "翻译", "漢化", "汉化", "个人汉化", "個人漢化", "机翻", "機翻", "AI翻译", "AI翻訳", "uncensored", "chinese", "中国語", "中国语",
    "白杨汉化组", "白楊漢化組", "成年コミック", "同人CG集", "Comic",
)
EQUAL = (
    "中文", "DL版", "WEB版", "電子版", "电子版", "FANTIA版", "FANBOX版", "FANTIA", "Pixiv", "ニジエ", "無修正", "无修正", "修正版", "空気系", "廉価版", "廉价版", "合刊", "合集", "総集編", "総集版",
    "同人誌", "同人志", "原稿格己删除", "原稿格已删除", "原稿已删除", "原稿削除", "削除済み",
)
NUMBERED = ("C|コミケ", "COMITIA|コミティア", "COMIC", "ぷにケット|ぷにけっと", "FF", "SC", "エアコミケ", "関西コミティア", "こみトレ", "とら祭り", "CSP", "例大祭", "ラグフェス")
SPECIAL = (r"^サンクリ(?:\s*\d{1,4}|\s*\d{4}\s+(?:Spring|Summer|Autumn|Winter))$", r"^COMIC1\s*[☆★＊*]?\s*\d{1,4}$")


@dataclass(frozen=True)
class Rule:
    """One rule; rules are tried in order."""

    name: str
    kind: str
    pattern: str
    enabled: bool = True
    scope: str = "FileName"

    def check(self) -> None:
        """What can't be compiled is refused when it is loaded, since nothing can time it out later."""
        if self.kind not in (EXACT, CONTAINS, STARTS, ENDS, REGEX) or not self.pattern.strip():
            raise ValueError(f"rule {self.name}: unknown kind or empty pattern")
        if self.kind == REGEX:
            re.compile(self.pattern)

    def hits(self, c: Column) -> Column:
        low, p = F.lower(c), self.pattern.lower()
        return {
            EXACT: lambda: low == p,
            CONTAINS: lambda: F.contains(low, F.lit(p)),
            STARTS: lambda: F.startswith(low, F.lit(p)),
            ENDS: lambda: F.endswith(low, F.lit(p)),
            REGEX: lambda: c.rlike("(?iu)" + self.pattern),
        }[self.kind]()


def visual_pattern(kind: str, prefix: str = "", least: int = 1, most: int = 4) -> str:
    """what a rule made without writing an expression compiles to."""
    words = "|".join(re.escape(p.strip()) for p in prefix.split("|") if p.strip())
    if kind in (STARTS, ENDS, "PrefixDigits") and not words:
        raise ValueError("a prefix is needed")
    if not 1 <= least <= most:
        raise ValueError("digits: 1 <= least <= most")
    return {
        STARTS: f"^(?:{words}).*$",
        ENDS: f"^.*(?:{words})$",
        "PrefixDigits": rf"^(?:{words})\s*\d{{{least},{most}}}$",
        "NumericDate": r"^\d{2,4}[.\-_/]\d{1,2}(?:[.\-_/]\d{1,2})?$",
        "CjkDate": r"^\d{4}年\d{1,2}月(?:\d{1,2}日)?$",
    }[kind]


def default_rules() -> list[Rule]:
    """F14."""
    out = [Rule(w, CONTAINS, w) for w in CONTAINED] + [Rule(w, EXACT, w) for w in EQUAL]
    out += [Rule(k, REGEX, visual_pattern(k)) for k in ("NumericDate", "CjkDate")]
    out += [Rule(w, REGEX, visual_pattern("PrefixDigits", w)) for w in NUMBERED]
    return out + [Rule(p, REGEX, p) for p in SPECIAL]


def load_rules(text: str) -> list[Rule]:
    """SRC11, U1, U2: rules from JSON (a list of objects), checked."""
    out = [Rule(r["name"], r["kind"], r["pattern"], bool(r.get("enabled", True)), r.get("scope", "FileName")) for r in json.loads(text)]
    for r in out:
        r.check()
    return out


def is_metadata_tag(c: Column | str, rules: list[Rule] | None = None, compat: bool = True) -> Column:
    """a blank tag is metadata; so is one that any rule hits."""
    s = F.trim(nfkc(text_of(c)) if compat else text_of(c))
    out = s == ""
    rules = [r for r in (default_rules() if rules is None else rules) if r.enabled]
    equal = [r.pattern.lower() for r in rules if r.kind == EXACT]
    if equal:
        out = out | F.lower(s).isin(equal)
    for r in rules:
        if r.kind != EXACT:
            out = out | r.hits(s)
    return out


def first_hit(c: Column, rules: list[Rule]) -> Column:
    """The name of the first enabled rule that hits, else null."""
    return F.coalesce(F.lit(None).cast("string"), *[F.when(r.hits(c), F.lit(r.name)) for r in rules if r.enabled])


def folder_hit(paths: DataFrame, path: str, root: str, rules: list[Rule]) -> DataFrame:
    """Paths with rule, that of the nearest ancestor folder below root that any rule hits; of one folder's rules the first.
    Folders are judged once each: a folder is an array prefix, exploded with its distance."""
    rest = F.expr(f"substring({path}, length({root}) + 2)")
    folders = F.filter(F.split(rest, r"[\\/]"), lambda x: x != "")
    folders = F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
    hit = F.transform(folders, lambda f: first_hit(f, rules))
    hits = F.filter(F.reverse(hit), lambda h: h.isNotNull())
    return paths.withColumn("rule", F.when(F.size(hits) > 0, F.element_at(hits, 1)))


def excluded_view(files: DataFrame, rule: str = "rule") -> DataFrame:
    """What a view shows; the reconciled index keeps everything."""
    return files.filter(F.col(rule).isNull())


def not_blocked(files: DataFrame, blocked: DataFrame, path: str = "path") -> DataFrame:
    """P4."""
    keys = blocked.select(path_key(path).alias("_key")).distinct()
    return files.withColumn("_key", path_key(path)).join(keys, "_key", "left_anti").drop("_key")


def in_scope(directory: Column, root: Column, recursive: bool) -> Column:
    """P5."""
    d, r = path_key(directory), path_key(root)
    return (d == r) | F.startswith(d, F.concat(r, F.lit("\\"))) if recursive else d == r


def extension(name: Column | str) -> Column:
    """lower-case letters and digits after the last point, or empty."""
    return F.lower(F.regexp_extract(text_of(name), r"\.([A-Za-z0-9_]{1,20})$", 1))


def normalized_extension(c: Column | str) -> Column:
    """"*.ZIP", ".zip" and "zip" are one; anything else is empty."""
    return F.regexp_extract(F.lower(F.trim(text_of(c))), r"^(?:\*?\.)?([a-z0-9_]{1,20})$", 1)


def has_type(name: Column | str, types: list[str]) -> Column:
    return extension(name).isin([re.sub(r"^\*?\.", "", t.strip().lower()) for t in types])


#: Longest gram that a pattern to be contained is found by; regular expressions that one table may hold: each is a test of its own.
GRAM, MOST_REGEX = 3, 1_000


def _grams(c: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def hits_by_table(rows: DataFrame, key: str, c: str, rules: DataFrame) -> DataFrame:
    """P1 with rules as a table (ord, name, kind, pattern) of any size: key, ord, name for each rule that hits. Every kind meets its texts by equality: whole
    texts, the beginnings and ends of the lengths that rules have, and for contained patterns their rarest run of three characters (of patterns
    of one or two characters the whole); what meets there is then tested as a whole. Only regular expressions are tested one by one."""
    texts = rows.select(key, F.lower(text_of(c)).alias("_text"), text_of(c).alias("_raw"))
    table = rules.select("ord", "name", "kind", F.col("pattern").alias("_regex"), F.lower("pattern").alias("_pattern"))
    of = lambda kind: table.filter((F.col("kind") == kind) & (F.col("_pattern") != "")).select("ord", "name", F.col("_pattern").alias("_k"))
    found = [texts.withColumnRenamed("_text", "_k").join(of(EXACT), "_k").select(key, "ord", "name")]
    for kind, end in ((STARTS, F.left), (ENDS, F.right)):
        lengths = [r[0] for r in of(kind).select(F.length("_k")).distinct().collect()]  # as many as patterns have different lengths
        if lengths:
            ends = F.array_compact(F.array(*[F.when(F.length("_text") >= n, end(F.col("_text"), F.lit(n))) for n in sorted(lengths)]))
            found.append(texts.select(key, F.explode(ends).alias("_k")).join(of(kind), "_k").select(key, "ord", "name"))
    inside = of(CONTAINS)
    for n in range(1, GRAM + 1):
        own = inside.filter(F.length("_k") >= n if n == GRAM else F.length("_k") == n)
        if own.isEmpty():
            continue
        grams = own.select("ord", "name", "_k", F.explode(_grams(F.col("_k"), n)).alias("_g"))
        held = grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
        keyed = grams.join(held, "_g").groupBy("ord", "name", "_k").agg(F.min_by("_g", F.struct("_df", "_g")).alias("_g"))
        met = texts.select(key, "_text", F.explode(_grams(F.col("_text"), n)).alias("_g")).join(keyed, "_g")
        found.append(met.filter(F.contains("_text", F.col("_k"))).select(key, "ord", "name"))
    shapes = table.filter(F.col("kind") == REGEX).limit(MOST_REGEX + 1).collect()
    if len(shapes) > MOST_REGEX:
        raise ValueError(f"more than {MOST_REGEX} regular expressions in one table")
    if shapes:
        tests = F.array_compact(F.array(*[F.when(F.col("_raw").rlike("(?iu)" + r["_regex"]), F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["name"]).alias("name"))) for r in shapes]))
        found.append(texts.select(key, F.explode(tests).alias("h")).select(key, "h.ord", "h.name"))
    return reduce(DataFrame.unionByName, found)


def first_hit_by_table(rows: DataFrame, key: str, c: str, rules: DataFrame) -> DataFrame:
    """P1 with rules as a table: key, rule: the first in order of those that hit. Equal texts are judged once, and of equal rules only the first is tried."""
    given = rows.select(key, text_of(c).alias("_given"))
    texts = given.select("_given").distinct().withColumn("_of", F.col("_given"))
    pattern = F.when(F.col("kind") == REGEX, F.col("pattern")).otherwise(F.lower("pattern")).alias("pattern")
    once = rules.groupBy("kind", pattern).agg(F.min(F.struct("ord", "name")).alias("_r")).select("_r.ord", "_r.name", "kind", "pattern")
    first = hits_by_table(texts, "_of", "_given", once).groupBy("_of").agg(F.min(F.struct("ord", "name")).alias("_h"))
    return given.join(first, F.col("_given") == F.col("_of")).groupBy(key).agg(F.min("_h").alias("_h")).select(key, F.col("_h.name").alias("rule"))


def folder_hit_by_table(paths: DataFrame, path: str, root: str, rules: DataFrame) -> DataFrame:
    """P2 with rules as a table: paths with rule; each distinct name of a folder is judged once."""
    rest = F.expr(f"substring({path}, length({root}) + 2)")
    folders = F.filter(F.split(rest, r"[\\/]"), lambda x: x != "")
    each = paths.select(F.col(path).alias("_path"), F.col(root).alias("_root"), F.posexplode(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))).alias("_at", "_folder")).distinct()
    names = each.select("_folder").distinct()
    judged = each.join(first_hit_by_table(names, "_folder", "_folder", rules), "_folder").groupBy("_path", "_root").agg(F.max_by("rule", "_at").alias("rule"))
    return paths.join(judged, (F.col(path) == F.col("_path")) & (F.col(root) == F.col("_root")), "left").select(*[paths[c] for c in paths.columns], "rule")


def scopes_of(files: DataFrame, file: str, directory: str, scopes: DataFrame) -> DataFrame:
    """P5, C4 for a table of scopes (scope_key, root, recursive), nested ones too: scope_key, file. A directory meets the roots above it by equality, as the
    list of its own ancestors."""
    d = files.select(file, path_key(directory).alias("_d"))
    parts = F.split("_d", r"\\")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "\\").alias("root"), (F.size(parts) - i).alias("depth")))
    roots = scopes.select("scope_key", "recursive", path_key("root").alias("root"))
    met = d.select(file, F.explode(above).alias("a")).select(file, "a.*").join(roots, "root")
    return met.filter(F.col("recursive") | (F.col("depth") == 0)).select("scope_key", file)
