"""Name normalisation as Column builders.  Only Unicode compatibility folding needs Python (one Arrow UDF,
applied to strings that have non-ASCII characters); the rest stays in whole-stage codegen."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that names are rid of; brackets and punctuation that count as one.
ZERO_WIDTH = "​‌‍⁠﻿"
BRACKETS, PLAIN_BRACKETS = "（）［］【】", "()[][]"
MIDDLE_DOTS, DASHES, TILDES = "・･•", "‐‑‒–—―−－", "～〜"
FULL_STOPS = ".。．｡"
QUOTES = ('""', "''", "“”", "‘’", "「」", "『』")
WRAPPERS = ("[]", "［］", "【】", "()", "（）")
SEPARATORS = r"\s*[,，、&＆/／+＋]\s*"
#: Kana, and the blocks of Han characters that names use.
CJK = r"[぀-ヿ㐀-䶿一-鿿豈-﫿]"
SPACE = r"[\s   -     　\u0085]+"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def text_of(c: Column | str) -> Column:
    """Absence is the empty string."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, c being computed once however often f uses it: nested uses would otherwise multiply."""
    return F.element_at(F.transform(F.array(c), f), 1)


def is_non_ascii(c: Column | str) -> Column:
    """more bytes than characters."""
    return F.octet_length(text_of(c)) > F.char_length(text_of(c))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def folded(c: Column | str, compat: bool = True) -> Column:
    """Compatibility form without zero-width characters, with ASCII brackets and single spaces."""
    s = text_of(c)
    if compat:
        s = F.coalesce(nfkc(F.when(is_non_ascii(s), s)), s)  # only a null goes to Python where there is nothing to fold
    return squeeze(F.translate(s, BRACKETS + ZERO_WIDTH, PLAIN_BRACKETS))


def with_missing_closer(c: Column) -> Column:
    """Appends the one closer that is missing; leaves alone what has none or several missing, or a wrong one."""
    marks = F.split(F.regexp_replace(c, r"[^()\[\]]", ""), "")

    def step(state: Column, mark: Column) -> Column:
        opened = F.concat(state["open"], mark)
        matches = F.right(state["open"], F.lit(1)) == F.when(mark == ")", "(").otherwise("[")
        closed = F.substring(state["open"], F.lit(1), F.greatest(F.length(state["open"]) - 1, F.lit(0)))
        return (
            F.when(~state["fine"] | (mark == ""), state)
            .when(mark.isin("(", "["), F.struct(opened.alias("open"), F.lit(True).alias("fine")))
            .when(matches & (state["open"] != ""), F.struct(closed.alias("open"), F.lit(True).alias("fine")))
            .otherwise(F.struct(state["open"].alias("open"), F.lit(False).alias("fine")))
        )

    start = F.struct(F.lit("").alias("open"), F.lit(True).alias("fine"))
    end = F.aggregate(marks, start, step)
    tail = F.when(end["fine"] & (end["open"] == "("), ")").when(end["fine"] & (end["open"] == "["), "]").otherwise("")
    return F.when(c.rlike(r"[(\[]"), F.concat(c, tail)).otherwise(c)


def normalize(c: Column | str, compat: bool = True) -> Column:
    """what differs only by form is one name; inner spaces and punctuation stay."""
    s = F.regexp_replace(folded(c, compat), r" *([()\[\]]) *", "$1")
    return F.lower(F.trim(let(s, with_missing_closer)))


def normalize_cautious(c: Column | str, compat: bool = True) -> Column:
    """for candidates that a person confirms."""
    s = F.translate(normalize(c, compat), MIDDLE_DOTS + DASHES + TILDES, "·" * len(MIDDLE_DOTS) + "-" * len(DASHES) + "~" * len(TILDES))

    def unquoted(x: Column) -> Column:
        quoted = F.lit(False)
        for pair in QUOTES:
            quoted = quoted | (F.startswith(x, F.lit(pair[0])) & F.endswith(x, F.lit(pair[1])) & (F.length(x) >= 2))
        return F.when(quoted, F.trim(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)

    for _ in range(2):
        s = let(s, unquoted)
    s = let(s, without_extra_closer)
    return F.lower(F.trim(F.regexp_replace(s, r"(?<!\.)\.$", "")))


def without_extra_closer(c: Column) -> Column:
    """Drops a last closer if everything before it is balanced; counts never go below zero on the way."""
    head = F.substring(c, F.lit(1), F.greatest(F.length(c) - 1, F.lit(0)))
    marks = F.split(F.regexp_replace(head, r"[^()\[\]]", ""), "")
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(True).alias("fine"))

    def step(a: Column, m: Column) -> Column:
        p = a["p"] + F.when(m == "(", 1).when(m == ")", -1).otherwise(0)
        s = a["s"] + F.when(m == "[", 1).when(m == "]", -1).otherwise(0)
        return F.struct(p.alias("p"), s.alias("s"), (a["fine"] & (p >= 0) & (s >= 0)).alias("fine"))

    end = F.aggregate(marks, start, step)
    return F.when(F.substring(c, -1, 1).isin(")", "]") & (F.length(c) > 1) & end["fine"] & (end["p"] == 0) & (end["s"] == 0), head).otherwise(c)


def unwrapped(c: Column | str) -> Column:
    """up to two pairs of brackets around the whole name go."""

    def inner_of(x: Column) -> Column:
        wrapped = F.lit(False)
        for pair in WRAPPERS:
            wrapped = wrapped | (F.startswith(x, F.lit(pair[0])) & F.endswith(x, F.lit(pair[1])))
        inner = F.trim(F.substring(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0))))
        return F.when(wrapped & (F.length(x) >= 2) & (inner != ""), inner).otherwise(x)

    return let(let(F.trim(text_of(c)), inner_of), inner_of)


def without_full_stop(c: Column | str, compat: bool = True) -> Column:
    """one final full stop goes, an ellipsis stays."""
    return F.rtrim(F.regexp_replace(normalize(c, compat), f"(?<=[^{FULL_STOPS}])[{FULL_STOPS}]$", ""))


def cjk_joined(c: Column | str, compat: bool = True) -> Column:
    """two to four parts join if each has kana or Han characters."""

    def joined(s: Column) -> Column:
        parts = F.filter(F.split(s, " "), lambda p: p != "")
        return F.when(F.size(parts).between(2, 4) & F.forall(parts, lambda p: p.rlike(CJK)), F.array_join(parts, "")).otherwise(s)

    return let(normalize(c, compat), joined)


def structured_parts(c: Column | str, compat: bool = True) -> Column:
    """struct(society, creators) of "society (creator, creator)", or null."""
    shape = r"^\s*(.*?)\s*\(\s*(.*?)\s*\)\s*$"

    def parts(s: Column) -> Column:
        society = F.regexp_replace(F.trim(F.regexp_extract(s, shape, 1)), r"[ +＋]+$", "")
        names = F.filter(F.transform(F.split(F.trim(F.regexp_extract(s, shape, 2)), SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")
        return F.struct(society.alias("society"), let(names, first_by_norm).alias("creators"))

    out = let(unwrapped(F.trim(let(folded(c, compat), with_missing_closer))), parts)
    return let(out, lambda p: F.when((p["society"] != "") & (F.size(p["creators"]) > 0), p))


def first_by_norm(names: Column) -> Column:
    """Of names that are one when normalised (compatibility form aside) the first stays."""

    def kept(keys: Column) -> Column:
        key = lambda i: F.element_at(keys, (i + 1).cast("int"))
        return F.filter(names, lambda x, i: (key(i) != "") & (F.array_position(keys, key(i)) == i + 1))

    return let(F.transform(names, lambda x: normalize(x, compat=False)), kept)


def safe_segments(c: Column | str, compat: bool = True) -> Column:
    """F8: two or three parts of two or more characters, each with kana or Han characters; else none."""

    def segments(s: Column) -> Column:
        parts = F.split(s, " ")
        fine = ~s.rlike(r"[()\[\]]") & F.size(parts).between(2, 3) & F.forall(parts, lambda p: (F.length(p) >= 2) & p.rlike(CJK))
        return F.when(fine, first_by_norm(parts)).otherwise(F.array().cast("array<string>"))

    return let(let(folded(c, compat), with_missing_closer), segments)


def display(c: Column | str) -> Column:
    """F16: as a source shows a name."""
    return squeeze(F.translate(text_of(c), ZERO_WIDTH, ""))


def pretty_tag(c: Column | str) -> Column:
    return squeeze(F.translate(text_of(c), "_", " "))


def is_useful(c: Column | str) -> Column:
    s = F.trim(text_of(c))
    return (s != "") & (F.length(s) <= 300) & ~F.lower(s).isin("[]", "null", "n/a")


def split_names(c: Column | str) -> Column:
    """F16: names separated by comma, semicolon, bar or line break; the first spelling of each, case aside."""
    names = F.filter(F.transform(F.split(text_of(c), r"[,;|\r\n]"), display), is_useful)
    return let(names, first_spelling)


def first_spelling(names: Column) -> Column:
    """O10 on arrays."""
    keys = F.transform(names, F.lower)
    return F.filter(names, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def bigrams(c: Column | str, whole_if_single: bool = True) -> Column:
    """distinct pairs of adjacent characters, spaces aside."""
    s = F.replace(text_of(c), F.lit(" "), F.lit(""))
    n = F.length(s)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))
    none = F.array().cast("array<string>")
    return F.when(n >= 2, pairs).when((n == 1) & F.lit(whole_if_single), F.array(s)).otherwise(none)


BOUNDARY = r"[\s()\[\]（）［］【】\-_+,，、&＆/／・·.。!！?？:：~～]"


def has_complete(text: Column, name: Column) -> Column:
    """name stands in text with a boundary, or an end, on both sides."""
    b, q = F.lit(BOUNDARY), F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")
    return (name != "") & F.regexp(text, F.concat(F.lit("(?:^|(?<="), b, F.lit("))"), q, F.lit("(?:$|(?="), b, F.lit("))")))


def starts_with_complete(text: Column, name: Column, compat: bool = True) -> Column:
    """the normalised text starts with the name, then ends or goes on with a boundary."""

    def starts(t: Column, n: Column) -> Column:
        after = F.substring(t, F.length(n) + 1, F.lit(1))
        return (F.length(n) >= 2) & F.startswith(t, n) & ((after == "") | after.rlike(r"[\s(\[\-_・·／/]"))

    return let(F.struct(normalize(text, compat).alias("t"), normalize(unwrapped(name), compat).alias("n")), lambda p: starts(p["t"], p["n"]))


#: Fixed value: how names of events begin, before a number.
EVENT_PREFIX = r"(?i)^(?:(?:C|コミケ|COMITIA|コミティア|FF|SC|エアコミケ|関西コミティア)\s*\d{1,4}|COMIC1\s*[☆★＊*]?\s*\d{1,4}|例大祭\s*\d{0,4}|紅楼夢\s*\d{0,4})\S*\s+"


def event_then_identity(text: Column, name: Column, compat: bool = True) -> Column:
    """an event's description, then the complete name."""
    s = F.trim(nfkc(text_of(text)) if compat else text_of(text))
    return s.rlike(EVENT_PREFIX) & starts_with_complete(F.regexp_replace(s, EVENT_PREFIX, ""), name, compat)


def compact_identity(c: Column | str, compat: bool = True) -> Column:
    """letters and digits alone."""
    return F.regexp_replace(normalize(c, compat), r"[^\p{L}\p{Nd}]", "")


def content_hash(c: Column) -> Column:
    """equal exactly when the bytes are."""
    return F.sha2(c.cast("binary"), 256)


def blob_sha1(c: Column) -> Column:
    """the id that git gives a file of this content."""
    raw = c.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "utf-8"), F.unhex(F.lit("00")), raw))


def fingerprint(*cols: Column | str) -> Column:
    """of fields in order; where fields end counts."""
    return F.xxhash64(*[F.struct(F.length(text_of(c)), text_of(c)) for c in cols])


def rename_signature(size, modified, created, extension) -> Column:
    """F28."""
    stamp = lambda c: F.coalesce(F.unix_micros(F.col(c)).cast("string"), F.lit(""))
    return F.concat_ws("|", F.col(size).cast("string"), stamp(modified), stamp(created), F.upper(F.coalesce(F.col(extension), F.lit(""))))


def path_key(c: Column | str) -> Column:
    """paths that differ by case, kind of slash or a final slash are one."""
    return F.upper(F.regexp_replace(F.regexp_replace(text_of(c), r"/", r"\\"), r"(?<=[^:\\])\\+$", ""))


def relative_path(path: Column, root: Column) -> Column:
    """F29."""
    p, r = path_key(path), path_key(root)
    return F.when(p == r, "").when(F.startswith(p, F.concat(r, F.lit("\\"))), F.substring(path, F.length(r) + 2, F.length(path))).otherwise(path)


def work_score(works: Column, primary: Column) -> Column:
    """F32."""
    return F.when(works >= 3, F.when(primary, 92).otherwise(88)).when(works == 2, 88).when(works == 1, 75).otherwise(0)


def bounded_levenshtein(a: Column, b: Column, most: int = 2) -> Column:
    """the distance, or most + 1 if it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)
