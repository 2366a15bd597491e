"""URL filter by the ratio of two character language models.  DataFrame functions only.

Rules decide the urls they fit; the rest is decided by two smoothed variable-order Markov
models of characters, one of accepted and one of rejected urls, learned from urls that rules decided.
Each order interpolates with the next shorter one (Witten and Bell's weights: a context's distinct
successors against all it had), down to a uniform distribution.  The models are kept as one table
of log-likelihood differences: by gram where a gram was seen, by context the difference of the
weights with which a shorter gram is used instead.  A url's score is the mean difference a character;
the threshold is the one that separates held-out training urls best.

The models are fitted on every distinct url that rules decide, as a whole and whatever its length, but every fifth by hash: those set the threshold. One exception: a url of
more than LONGEST characters that has more of them than all others of its kind together isn't learned from, as it would outweigh all the rest; at most one a kind, scored like any other.
Characters are counted by window (the ORDER at most that end at a place), and each distinct window's value is looked up once. Windows' values are a table with no
bound on its rows: up to BROADCAST rows it is broadcast, beyond that it is joined by key, frequent windows by broadcast. The model
meets the distinct windows by broadcast or key, by the same bound.

Defined cases: a null url or one without "://" has an empty host and path and an empty text, whose score is 0:
it's allowed unless the threshold says otherwise; a null page_id stays null; repeated rows come out repeated; other
columns are ignored; without training urls of both kinds everything undecided is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, joined_back

#: The rules of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER, LONGEST, ALPHABET, BROADCAST, PIECE = 4, 8_000, 256, 1_000_000, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, rest (after ://), host, path, rule, said (the rule's verdict)."""
    url = F.coalesce(pages["url"].cast("string"), F.lit(""))
    at = F.instr(url, "://")
    out = pages.select(pages["page_id"].alias("page_id"), F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("").alias("rest"))
    out = out.select("page_id", "rest", F.translate(F.regexp_extract("rest", r"(?s)^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))

    def fits(rule: str) -> Column:
        host, slash, path = rule.partition("/")
        return ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))

    ordered = sorted(rules, key=lambda r: -len(r[0]))
    hit = F.coalesce(*[F.when(fits(r), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("said"))) for r, v in ordered])
    return out.withColumn("hit", hit).select("page_id", "rest", "host", "path", "hit.rule", "hit.said")


def windows(rows: DataFrame, keep: list[str], order: int) -> DataFrame:
    """A row for each character of t: w, the order characters that end there, or as many as there are. A text is taken in pieces, each behind the last
    characters of the one before: finding a character costs no more in a long text than in a short one."""
    at, pieces = F.col("at"), F.col("pieces")
    each = rows.select(*keep, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))
    before = lambda i: F.when(i > 0, F.right(F.element_at(pieces, F.greatest(i, F.lit(1))), F.lit(order - 1))).otherwise("")
    each = each.select(*keep, F.explode(F.transform(pieces, lambda p, i: F.struct(F.length(before(i)).alias("n"), F.concat(before(i), p).alias("t")))).alias("p"))
    each = each.select(*keep, F.col("p.t").alias("t"), F.explode(F.sequence(F.col("p.n") + 1, F.length("p.t"))).alias("at"))
    return each.select(*keep, F.substring("t", F.greatest(at - F.lit(order - 1), F.lit(1)), F.least(at, F.lit(order))).alias("w"))


def fit(train: DataFrame, order: int) -> DataFrame:
    """key, gram (log-likelihood difference accepted - rejected), back (that of the weights of shorter grams). train: t, good."""
    n = windows(train, ["good"], order).groupBy("w").agg(F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("na"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("nr"))
    n = n.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.right("w", k))).alias("g"), "na", "nr").groupBy("g").agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    n = cut(n.withColumn("k", F.length("g")).withColumn("c", F.expr("substring(g, 1, k - 1)")), "op5-grams")
    contexts = n.groupBy("c").agg(*[f(x).alias(y) for x, y, f in (("na", "ca", F.sum), ("nr", "cr", F.sum))], F.sum((F.col("na") > 0).cast("long")).alias("ta"), F.sum((F.col("nr") > 0).cast("long")).alias("tr"))
    weight = lambda x: F.when(F.col(f"c{x}") > 0, F.col(f"t{x}") / (F.col(f"c{x}") + F.col(f"t{x}"))).otherwise(1.0)
    contexts = cut(contexts.select("c", "ca", "cr", weight("a").alias("wa"), weight("r").alias("wr"), "ta", "tr"), "op5-contexts")
    seen = lambda x: F.when(F.col(f"c{x}") > 0, F.col(f"n{x}") / (F.col(f"c{x}") + F.col(f"t{x}"))).otherwise(0.0)
    out = below = None
    for k in range(1, order + 1):
        own = n.filter(F.col("k") == k).join(contexts, "c").withColumn("s", F.expr("substring(g, 2)"))
        if below is None:
            own = own.withColumn("la", F.lit(1.0 / ALPHABET)).withColumn("lr", F.lit(1.0 / ALPHABET))
        else:
            own = own.join(below.select(F.col("g").alias("s"), F.col("pa").alias("la"), F.col("pr").alias("lr")), "s")
        below = own.select("g", (seen("a") + F.col("wa") * F.col("la")).alias("pa"), (seen("r") + F.col("wr") * F.col("lr")).alias("pr"))
        out = below if out is None else out.unionByName(below)
    by_gram = out.select(F.col("g").alias("key"), (F.log("pa") - F.log("pr")).alias("gram"))
    by_context = contexts.select(F.col("c").alias("key"), (F.log("wa") - F.log("wr")).alias("back"))
    return cut(by_gram.join(by_context, "key", "full"), "op5-model")


def values(each: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """w, size (its rows), value (the difference of its last character behind the others) of each window of each."""
    unseen = model.filter("key = ''").select("back").first()
    if model.count() <= BROADCAST:
        model = F.broadcast(model)
    sizes = cut(each.groupBy("w").agg(F.count(F.lit(1)).alias("size")), "op5-windows")
    own = [F.struct(F.lit(f"v{k}").alias("of"), F.when(F.length("w") >= k, F.right("w", F.lit(k))).alias("key")) for k in range(1, order + 1)]
    own += [F.struct(F.lit(f"b{k}").alias("of"), F.when(F.length("w") > k, F.left(F.right("w", F.lit(k + 1)), F.lit(k))).alias("key")) for k in range(1, order)]
    asked = sizes.select("w", "size", F.explode(F.array(*own)).alias("x")).select("w", "size", "x.of", "x.key").filter("key is not null").join(model, "key", "left")
    of = lambda x, y: F.max(F.when(F.col("of") == x, F.col(y))).alias(x)
    asked = asked.groupBy("w", "size").agg(*[of(f"v{k}", "gram") for k in range(1, order + 1)], *[of(f"b{k}", "back") for k in range(1, order)])
    value = F.coalesce(F.col("v1"), F.lit(float(unseen[0]) if unseen else 0.0))
    for k in range(2, order + 1):
        value = F.coalesce(F.col(f"v{k}"), F.coalesce(F.col(f"b{k - 1}"), F.lit(0.0)) + value)
    return cut(asked.select("w", "size", value.alias("value")), "op5-values", (sizes,))


def score(rows: DataFrame, keep: list[str], model: DataFrame, order: int) -> DataFrame:
    """keep, total, n: the sum of differences over a url's characters, and their number. rows: keep and t."""
    each = windows(rows, keep, order)
    known = values(each, model, order)
    if known.count() <= BROADCAST:
        each = each.join(F.broadcast(known.select("w", "value")), "w")
    else:
        each = joined_back(each, known, "w")
    return each.groupBy(*keep).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def url_filter(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    parts = url_parts(pages, rules).withColumn("t", F.translate("rest", UPPER, LOWER))
    known = parts.filter("said is not null and t <> ''").select("t", (F.col("said") == "allow").alias("good")).distinct()
    known = cut(known.select("t", "good", F.pmod(F.xxhash64("t"), F.lit(5)).alias("fold"), F.monotonically_increasing_id().alias("id")), "op5-known")
    train = known.filter("fold > 0")
    have = train.groupBy("good").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("total"), F.max(F.length("t")).alias("longest")).collect()
    if len(have) < 2:
        return parts.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    for kind in have:
        if kind["n"] > 1 and kind["longest"] > max(LONGEST, kind["total"] - kind["longest"]):
            train = train.filter((F.col("good") != kind["good"]) | (F.length("t") < kind["longest"]))
    model = fit(train, order)
    bound = threshold(score(known.filter("fold = 0"), ["good", "id"], model, order))
    rows = cut(parts.withColumn("row", F.monotonically_increasing_id()), "op5-rows")
    by_url = score(rows.filter("t <> ''").select("row", "t"), ["row"], model, order).select("row", (F.col("total") / F.col("n")).alias("score"))
    score_ = F.coalesce("score", F.lit(0.0))
    verdict = F.coalesce("said", F.when(score_ < bound, "block").otherwise("allow"))
    return rows.join(by_url, "row", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round(score_, 9).alias("score"))


def threshold(held: DataFrame) -> float:
    """Where the two kinds' shares on their own sides sum highest (half way to the next bin that has rows), over a histogram of 0.01 wide bins of at most 4,001."""
    bins = held.select("good", F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(100 * F.col("total") / F.col("n")))).cast("int").alias("bin"))
    bins = bins.groupBy("bin").agg(F.sum(F.col("good").cast("long")).alias("a"), F.sum((~F.col("good")).cast("long")).alias("r"))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy()
    gain = F.sum("r").over(up) / F.greatest(F.sum("r").over(all_), F.lit(1)) - F.sum("a").over(up) / F.greatest(F.sum("a").over(all_), F.lit(1))
    after = F.coalesce(F.lead("bin").over(Window.orderBy("bin")), F.col("bin") + 1)
    best = bins.withColumn("gain", gain).withColumn("after", after).orderBy(F.desc("gain"), F.abs("bin")).limit(1).collect()
    return (best[0]["bin"] + best[0]["after"]) / 200 if best and best[0]["gain"] > 0 else 0.0
