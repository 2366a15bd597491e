"""Candidates by shared bigrams, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grammar import candidates_udf, parse_udf
from ..functions.rules import Rule, is_metadata_tag
from ..functions.text import CJK, bigrams, bounded_levenshtein, is_non_ascii, nfkc, normalize, squeeze, structured_parts, unwrapped
from ..sources.writers import settled

TOP, MATCH, CHOICE, LEAD = 24, 100, 60, 20


def grams(rows: DataFrame, key: str, name: str, whole_if_single: bool = True) -> DataFrame:
    return rows.select(key, F.explode(bigrams(name, whole_if_single)).alias("gram"))


def blocked(left: DataFrame, right: DataFrame, key: str, name: str, other: str, other_name: str, top: int | None = TOP) -> DataFrame:
    """Key, other, hits: pairs of names by the bigrams they share, of each left row the top by hits, then by name.

    Both sides are counted per distinct name first, and a pair's hits are summed in part before they move.  No gram is left out, however
    frequent; the join of a frequent gram is split by adaptive execution."""
    a, b = grams(left, key, name), grams(right, other, other_name)
    hits = a.join(b, "gram").groupBy(key, other).agg(F.count(F.lit(1)).alias("hits"))
    if top is None:
        return hits
    named = hits.join(right.select(other, F.lower(other_name).alias("_n")), other)
    w = Window.partitionBy(key).orderBy(F.desc("hits"), "_n", other)
    return named.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).select(key, other, "hits")


def with_short_names(hits: DataFrame, left: DataFrame, right: DataFrame, key: str, name: str, other: str) -> DataFrame:
    """J18's other branch: a name of fewer than two characters is met by every row of the right side, which is a stated list of folders."""
    short = left.filter(F.length(F.replace(F.col(name), F.lit(" "), F.lit(""))) < 2).select(key)
    return hits.unionByName(short.join(right.select(other), F.lit(True)).select(key, other, F.lit(0).cast("long").alias("hits")))


def blocked_by_prefix(left: DataFrame, right: DataFrame, key: str, name: str, other: str, other_name: str, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """What blocked() gives, and a report (round, grams, pairs): the commonest grams are joined only for the names whose answer they could change.

    A name's grams are put in order, those that fewest of the right side have first. In the first round half of them find candidates, whose hits are counted
    exactly; the top-th of these is a bound: whoever shares none of the first m - bound + 1 of m grams has fewer hits than it. So the second round
    looks at no more than that many, and only for names that the first round's half doesn't settle."""
    a = settled(left.select(key, bigrams(name).alias("grams")))
    b = settled(right.select(other, F.lower(other_name).alias("_n"), bigrams(other_name).alias("_grams")))
    postings = b.select(other, F.explode("_grams").alias("gram"))
    held = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))
    ranked = a.select(key, F.explode("grams").alias("gram")).join(held, "gram").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_df", "gram"))).alias("_g"))
    ranked = settled(ranked.select(key, F.transform("_g", lambda x: x["gram"]).alias("grams")))
    w = Window.partitionBy(key).orderBy(F.desc("hits"), "_n", other)

    def candidates(rows: DataFrame) -> DataFrame:
        """rows: key, grams, from, upto. The best of those who share one of the grams from, ..., upto."""
        looked = rows.select(key, F.explode(F.slice("grams", F.col("from"), F.greatest(F.col("upto") - F.col("from") + 1, F.lit(0)))).alias("gram")).join(postings, "gram").select(key, other).distinct()
        hits = looked.join(rows.select(key, "grams"), key).join(b, other).withColumn("hits", F.size(F.array_intersect("grams", "_grams")).cast("long"))
        return hits.select(key, other, "_n", "hits")

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)

    half = F.ceil(F.size("grams") / 2).cast("int")
    one = settled(candidates(ranked.withColumn("from", F.lit(1)).withColumn("upto", half)))
    first = settled(best(one))
    bound = first.filter(F.col("_r") == top).select(key, F.col("hits").alias("_bound"))
    todo = ranked.join(bound, key, "left").withColumn("upto", F.least(F.size("grams"), F.size("grams") - F.coalesce("_bound", F.lit(0)) + 1).cast("int")).withColumn("from", half + 1).filter("upto >= from")
    todo = settled(todo.select(key, "grams", "from", "upto"))
    two = settled(candidates(todo))
    out = best(first.drop("_r").unionByName(two).distinct())
    effort = lambda n, rows, grams: rows.agg(F.lit(n).alias("round"), F.count(F.lit(1)).alias("pairs")).crossJoin(grams)
    report = effort(1, one, ranked.agg(F.coalesce(F.sum(half), F.lit(0)).cast("long").alias("grams"))).unionByName(effort(2, two, todo.agg(F.coalesce(F.sum(F.col("upto") - F.col("from") + 1), F.lit(0)).cast("long").alias("grams"))))
    return out.select(key, other, "hits"), report.select("round", "grams", "pairs")


#: What may stand beside a complete name; what may stand before one at the front; brackets that a search takes for square ones, and those a region may have.
EDGE = r"[\s\[\]［］【】()（）{}<>「」『』\-_.,，、・·/\\+&!！?？:：;；]"
FRONT = r"^[\s\[({<]*$"
WIDE, PLAIN = "（）［］【】「」『』", "()[][][][]"
REGION, TAG, PIECES, MOST_PIECES = r"[\[\(【「『]\s*([^\]\)】」』]{1,80})\s*[\]\)】」』]", r"[\[［【]\s*([^\]］】]{1,100})\s*[\]］】]", r"[\s\u3000_\-]+", 4


def search_form(c: Column) -> Column:
    """A text in compatibility form as it is searched in: lower case, plain brackets, single spaces."""
    return squeeze(F.lower(F.translate(c, WIDE, PLAIN)))


def regions(c: Column) -> Column:
    """What stands in brackets, and the first pieces between spaces, underscores and hyphens, of a text in compatibility form."""
    inside = F.regexp_extract_all(c, F.lit(REGION), F.lit(1))
    pieces = F.filter(F.slice(F.split(c, PIECES), 1, MOST_PIECES), lambda x: F.trim(x) != "")
    return F.transform(F.concat(inside, pieces), search_form)


def complete_at(text: Column, name: Column, any_case: bool = False) -> Column:
    """where (from 1) the name first stands in the text with an edge or an end on both sides; 0 if nowhere."""
    quoted = F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")
    at = F.regexp_instr(text, F.concat(F.lit(f"{'(?iu)' if any_case else ''}(?:\\A|(?<={EDGE}))"), quoted, F.lit(f"(?:\\z|(?={EDGE}))")))
    return F.when((name != "") & (text != ""), at).otherwise(0)


def fuzzy_score(places: Column, identity: Column) -> Column:
    """The best of a file's regions: a name of three characters or more within the region or around it, lengths at 60 % or more, is worth 40, a region of two
    characters of kana or Han 45; a distance of exactly 1 from a name of four or more 70, of exactly 2 from one of six or more 55. Names of two
    characters are worth 40 at most."""
    n = F.length(identity)

    def one(region: Column) -> Column:
        m = F.length(region)
        small, large = F.least(m, n), F.greatest(m, n)
        inside = (n >= 3) & (F.contains(region, identity) | F.contains(identity, region)) & (small * 100 >= large * 60)
        part = F.when(inside & (small >= 3), 40).when(inside & (small == 2) & region.rlike(CJK), 45).otherwise(0)
        d = bounded_levenshtein(region, identity, 2)
        return F.when(region == "", 0).otherwise(F.greatest(part, F.when((d == 1) & (n >= 4), 70).when((d == 2) & (n >= 6), 55).otherwise(0)))

    best = F.coalesce(F.array_max(F.transform(places, one)), F.lit(0))
    return F.when(n == 0, 0).when(n <= 2, F.least(best, F.lit(40))).otherwise(best)


def identity_score(text: Column, raw: Column, places: Column, creators: Column, tags: Column, name: Column, raw_name: Column, confirmed: Column, folder: Column) -> Column:
    """A complete hit is worth 100 (a confirmed alias, or the name as it is written) or 95; the folder's own name, a creator's field, the front and
    brackets add to it, a metadata tag takes it away; never below 0. Without a complete hit E16 decides.
    text: the file in search_form; raw: as it is; places: its regions; creators, tags: norms; name: the identity's norm."""
    at = complete_at(text, name)
    n = F.length(name)
    front = F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0))).rlike(FRONT)
    around = F.concat(F.substring(text, F.greatest(at - 1, F.lit(1)), F.lit(1)), F.substring(text, at + n, F.lit(1)))
    bracketed = (at > 1) & around.isin("[]", "()")
    s = F.when(confirmed | (complete_at(raw, raw_name, True) > 0), 100).otherwise(95) + F.when(folder, 20).otherwise(0) + F.when(F.array_contains(creators, name), 30).otherwise(0)
    s = s + F.when(front, 15).otherwise(0) + F.when(bracketed, 10).otherwise(0) - F.when(F.exists(tags, lambda t: F.contains(t, name)), 100).otherwise(0)
    hit = F.greatest(F.when(n <= 2, F.least(s, F.lit(75))).otherwise(s), F.lit(0))
    return F.when((text == "") | (name == ""), 0).when(at > 0, hit).otherwise(fuzzy_score(places, name))


def prepared_files(files: DataFrame, id_: str, name: str, rules: list[Rule] | None = None) -> DataFrame:
    """Id, raw, text, places, creators, tags: each distinct name is prepared once."""
    each = files.select(F.col(name).alias("_name")).distinct().withColumn("raw", parse_udf()("_name")["identity_text"])
    each = each.withColumn("_form", F.coalesce(nfkc(F.when(is_non_ascii("raw"), F.col("raw"))), "raw")).withColumn("_found", candidates_udf(rules)("raw"))
    creators = F.flatten(F.transform("_found", lambda c: F.coalesce(structured_parts(c, compat=False)["creators"], F.array().cast("array<string>"))))
    tags = F.filter(F.transform(F.regexp_extract_all("raw", F.lit(TAG), F.lit(1)), lambda x: F.trim(x)), lambda x: is_metadata_tag(x, rules, compat=False))
    each = each.select("_name", "raw", search_form(F.col("_form")).alias("text"), regions(F.col("_form")).alias("places"), F.transform(creators, lambda c: normalize(c, compat=False)).alias("creators"), F.transform(tags, search_form).alias("tags"))
    return files.select(id_, F.col(name).alias("_name")).join(each, "_name").drop("_name")


def folder_identities(folders: DataFrame, aliases: DataFrame) -> DataFrame:
    """Folder, name, norm, confirmed, own: each name of a folder once, by its norm. folders: folder, name, preferred; aliases: folder, name (confirmed ones)."""
    row = lambda rows, c, at, confirmed: rows.select("folder", unwrapped(F.trim(F.col(c))).alias("name"), F.lit(at).alias("_at"), F.lit(confirmed).alias("confirmed"))
    every = row(folders, "name", 0, False).unionByName(row(folders.filter("preferred IS NOT NULL"), "preferred", 1, False)).unionByName(row(aliases, "name", 2, True))
    every = every.withColumn("norm", normalize("name")).filter("norm <> ''")
    return every.groupBy("folder", "norm").agg(F.min_by("name", F.struct("_at", "name")).alias("name"), F.max("confirmed").alias("confirmed"), (F.min("_at") < 2).alias("own"))


def scored_pairs(pairs: DataFrame, files: DataFrame, identities: DataFrame, id_: str) -> DataFrame:
    """Id, folder, score: of candidate pairs (id, folder), over all identities of the folder."""
    rows = pairs.select(id_, "folder").join(files, id_).join(identities, "folder")
    c = F.col
    score = identity_score(c("text"), c("raw"), c("places"), c("creators"), c("tags"), c("norm"), c("name"), c("confirmed"), c("own"))
    return folder_scores(rows.select(id_, "folder", score.alias("score")), [id_, "folder"])


def folder_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The best identity of a folder, and 20 more if two or more score 80."""
    return scores.groupBy(*keys).agg((F.max("score") + F.when(F.sum((F.col("score") >= 80).cast("int")) >= 2, 20).otherwise(0)).alias("score"))


def decided(scores: DataFrame, key: str, folder: str) -> DataFrame:
    """Key, status, folder (the first of equally good), score, runner_up, choices, candidates: the best at 100 with a lead of 20 is a match; at 60 it is a
    choice among all that have 60 themselves and are within 20 of it, best first; below that there is none. Folders without a score don't count."""
    ranked = scores.filter("score > 0")
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.lower(F.col(folder).cast("string")), folder)
    r = ranked.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("score").over(w), F.lit(0))).withColumn("_best", F.max("score").over(Window.partitionBy(key)))
    able = (F.col("score") >= CHOICE) & (F.col("score") + LEAD >= F.col("_best"))
    one = lambda c: F.max(F.when(F.col("_r") == 1, F.col(c)))
    r = r.groupBy(key).agg(one("score").alias("score"), one("_next").alias("runner_up"), one(folder).alias("_first"), F.array_sort(F.collect_list(F.when(able, F.struct("_r", F.col(folder).alias("f"))))).alias("_able"))
    out = scores.select(key).distinct().join(r, key, "left").withColumn("score", F.coalesce("score", F.lit(0))).withColumn("runner_up", F.coalesce("runner_up", F.lit(0)))
    status = F.when((F.col("score") >= MATCH) & (F.col("score") - F.col("runner_up") >= LEAD), "Matched").when(F.col("score") >= CHOICE, "Choice").otherwise("None")
    candidates = F.when(F.col("status") == "Choice", F.transform("_able", lambda x: x["f"])).otherwise(F.array().cast(f"array<{scores.schema[folder].dataType.simpleString()}>"))
    out = out.withColumn("status", status).withColumn("candidates", candidates)
    return out.select(key, "status", F.when(F.col("status") != "None", F.col("_first")).alias(folder), "score", "runner_up", F.size("candidates").cast("long").alias("choices"), "candidates")
