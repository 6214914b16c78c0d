"""Likeness of names and the points that make a candidate's confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwise.functions.phonetic import koelner
from weftwise.functions.text import normalize_a, normalize_b

# Bonus for equal sound, points for a hint, most points of a stage.
PHONETIC_BONUS, HINT_BOOST, MOST_STAGE = 0.35, 10, 50


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length, at least 0; 0 for two empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.levenshtein(a, b) / longest))


def name_forms(c: Column) -> Column:
    """Both spellings of a name and its sound, to be made once a name."""
    return F.struct(normalize_a(c).alias("a"), normalize_b(c).alias("b"), koelner(normalize_b(c)).alias("code"))


def ratio_bound(a: Column, b: Column) -> Column:
    """What ``fuzzy_ratio`` can't exceed: the edit distance is at least the difference of the lengths."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1.0 - F.abs(F.length(a) - F.length(b)) / longest)


def match_quality_of(heard: Column, stored: Column, ratio=fuzzy_ratio) -> Column:
    """``match_quality`` of names as ``name_forms``; with ``ratio_bound`` what it can't exceed, without edit distances."""
    best = F.greatest(*[ratio(heard[x], stored[y]) for x in "ab" for y in "ab"])
    bonus = F.when((heard["b"] != "") & (stored["b"] != "") & (heard["code"] == stored["code"]), PHONETIC_BONUS).otherwise(0.0)
    return F.least(F.lit(1.0), best + bonus)


def match_quality(heard: Column, stored: Column) -> Column:
    """The best likeness of any two normalised spellings, plus a bonus for equal sound, at most 1."""
    return match_quality_of(name_forms(heard), name_forms(stored))


def stage_points(first_quality: Column, last_quality: Column) -> Column:
    return F.floor(50.0 * (0.35 * first_quality + 0.65 * last_quality) + 0.5).cast("int")


def hint_matches(hint: Column, last: Column) -> Column:
    """A hint that isn't blank begins the name in either spelling."""
    ha, hb = normalize_a(hint), normalize_b(hint)
    return (ha != "") & (normalize_a(last).startswith(ha) | normalize_b(last).startswith(hb))


def with_hint(points: Column, hinted: Column) -> Column:
    return F.when(hinted, F.least(F.lit(MOST_STAGE), points + HINT_BOOST)).otherwise(points)


def representation_points(hits: Column, total: Column) -> Column:
    return F.when(total == 0, 0).when(hits >= total, 30).when(4 * hits >= 3 * total, 20).when(2 * hits >= total, 10).otherwise(0)


def uniqueness_points(n: Column) -> Column:
    return F.when(n == 1, 20).when(n == 2, 10).otherwise(0)
