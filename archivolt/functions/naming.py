"""Names of folders: numbers in groups, and authors in templates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import text_of

#: What a group's number looks like, by token; characters and names that a folder can't have.
TOKENS = {"{n}": r"\d+", "{n2}": r"\d{2,}", "{n3}": r"\d{3,}", "{A}": r"[A-Za-z]+", "{a}": r"[A-Za-z]+"}
FORBIDDEN, INSTEAD = '\\/:*?"<>|', "＼／：＊？＂＜＞｜"
RESERVED = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\..*)?$"
AUTHOR = "{author}"


def letters(number: int) -> str:
    """Bijective base 26: A ... Z, AA, AB ..."""
    out = ""
    while number > 0:
        number, digit = divmod(number - 1, 26)
        out = chr(65 + digit) + out
    return out


def from_letters(s: str) -> int:
    value = 0
    for c in s.upper():
        value = value * 26 + ord(c) - 64
    return value


@F.pandas_udf(T.StringType())
def letters_udf(n: pd.Series) -> pd.Series:
    return n.map(lambda x: letters(max(1, int(x))), na_action="ignore")


def token_of(template: str) -> str:
    found = [t for t in TOKENS if t in template]
    if len(found) != 1 or template.count(found[0]) != 1:
        raise ValueError(f"a group template has one of {', '.join(TOKENS)}, once: {template!r}")
    return found[0]


def group_name(template: str, number: Column) -> Column:
    """the folder of a group; numbers below 1 count as 1."""
    token, n = token_of(template), F.greatest(number.cast("int"), F.lit(1))
    head, tail = template.split(token)
    digits = n.cast("string")
    width = {"{n2}": 2, "{n3}": 3}.get(token)
    if width:
        digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), "0")
    elif token in ("{A}", "{a}"):
        digits = letters_udf(n)
        digits = F.lower(digits) if token == "{a}" else digits
    return F.concat(F.lit(head), digits, F.lit(tail))


def group_number(template: str, name: Column) -> Column:
    """the number back from a folder's name, null if it is none."""
    token = token_of(template)
    head, tail = (re.escape(x) for x in template.split(token))
    found = F.regexp_extract(name, f"^{head}({TOKENS[token]}){tail}$", 1)
    if token in ("{A}", "{a}"):
        codes = F.transform(F.split(F.upper(found), ""), lambda c: F.ascii(c) - 64)
        value = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a * 26 + c)
        return F.when((found != "") & (F.length(found) <= 6), value.cast("int"))
    return F.when(found != "", F.try_to_number(found, F.lit("9" * 18)).cast("int"))


def author_folder(template: str, author: Column) -> Column:
    """forbidden characters become full-width ones; no final spaces or points; 255 characters; reserved names get a mark."""
    safe = F.trim(F.regexp_replace(F.translate(text_of(author), FORBIDDEN, INSTEAD), r"[\x00-\x1f]", " "))
    head, _, tail = template.partition(AUTHOR)
    cut = lambda c: F.regexp_replace(c, r"[ .]+$", "")
    s = cut(F.concat(F.lit(head), safe, F.lit(tail)))
    s = cut(F.substring(F.when(s == "", "_").otherwise(s), 1, 255))
    return F.when(s.rlike(RESERVED), F.concat(F.lit("_"), s)).otherwise(s)


def author_of_folder(name: Column, templates: list[str]) -> Column:
    """by the template with most literal characters that fits; null if none does."""
    ordered = sorted(dict.fromkeys([*templates, AUTHOR]), key=lambda t: -len(t.replace(AUTHOR, "")))
    out = F.lit(None).cast("string")
    tries = []
    for t in ordered:
        head, _, tail = t.partition(AUTHOR)
        inner = F.trim(F.substring(name, F.lit(len(head) + 1), F.length(name) - len(head) - len(tail)))
        fits = F.startswith(F.lower(name), F.lit(head.lower())) & F.endswith(F.lower(name), F.lit(tail.lower())) & (F.length(name) > len(head) + len(tail)) & (inner != "")
        tries.append(F.when(fits, inner))
    return F.coalesce(out, *tries)
