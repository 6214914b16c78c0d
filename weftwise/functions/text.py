"""Names as text: trimming, folding, parsing of tags, lists and addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, also where the body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(c: Column) -> Column:
    """Absent values are empty strings throughout."""
    return F.coalesce(c, F.lit(""))


def utrim(c: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.regexp_replace(blank(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _letters(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-zA-Z]+", " "))


def normalize_a(c: Column) -> Column:
    """Lower case, umlauts written out with e, runs of anything but letters to one space."""
    s = F.lower(utrim(c))
    for umlaut, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = F.replace(s, F.lit(umlaut), F.lit(plain))
    return _letters(s)


def normalize_b(c: Column) -> Column:
    """As ``normalize_a``, with umlauts as their base letters."""
    return _letters(F.replace(F.translate(F.lower(utrim(c)), "äöü", "aou"), F.lit("ß"), F.lit("ss")))


def strip_tags(c: Column) -> Column:
    """Markup tags and runs of white space become one space."""
    return utrim(F.regexp_replace(F.regexp_replace(blank(c), "<[^>]*>", " "), r"\s+", " "))


def structured_words(c: Column) -> Column:
    """The non-empty ``word`` values of a JSON array of objects, joined by spaces; null if it isn't one."""
    shape = F.schema_of_variant(F.try_parse_json(c))
    words = F.transform(F.from_json(c, "array<struct<word:string>>"), lambda x: x["word"])
    joined = F.array_join(F.filter(words, lambda w: w.isNotNull() & (w != "")), " ")
    return F.when(shape.startswith("ARRAY<OBJECT") & shape.rlike("[<, ]word: STRING") & (joined != ""), joined)


def short_prefix(c: Column, n: int = 3) -> Column:
    return F.substring(c, 1, n)


def email_domain(c: Column) -> Column:
    """Lower-cased text behind the last @; empty without one."""
    return F.when(F.instr(blank(c), "@") > 0, F.lower(F.substring_index(c, "@", -1))).otherwise("")


def split_first(c: Column) -> Column:
    return F.split(utrim(c), " ", 2)[0]


def split_last(c: Column) -> Column:
    """All behind the first space; empty for one word."""
    return utrim(F.get(F.split(utrim(c), " ", 2), F.lit(1)))


def parse_list(c: Column, lower: bool) -> Column:
    """The non-empty, trimmed parts of a comma-separated list."""
    s = F.lower(blank(c)) if lower else blank(c)
    return F.filter(F.transform(F.split(s, ","), utrim), lambda x: x != "")


def fold_equal(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)
