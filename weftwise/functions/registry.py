"""The scalar functions under names that SQL texts can call, for as long as the session lives."""

from __future__ import annotations

from pyspark.sql import SparkSession

_TRIM = r"regexp_replace(coalesce({0}, ''), r'^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '')"


def _letters(c: str) -> str:
    return f"trim(regexp_replace({c}, '[^a-zA-Z]+', ' '))"


def _sound() -> str:
    """The rules of ``functions.phonetic`` as nested calls."""
    from weftwise.functions.phonetic import _ALONE, _IN_CONTEXT

    s = "regexp_replace(upper(coalesce(s, '')), '[^A-Z]+', '')"
    for pattern, sound in _IN_CONTEXT:
        s = f"regexp_replace({s}, r'{pattern}', '{sound}')"
    letters, digits = "".join(_ALONE.values()), "".join(d * len(x) for d, x in _ALONE.items())
    return rf"regexp_replace(regexp_replace(replace(translate({s}, '{letters}H', '{digits}'), 'y', '48'), r'(.)\1+', '$1'), '(?<!^)0+', '')"


FUNCTIONS = {
    "trim_all": ("s string", "string", _TRIM.format("s")),
    "normalize_a": ("s string", "string", _letters("replace(replace(replace(replace(lower(trim_all(s)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')")),
    "normalize_b": ("s string", "string", _letters("replace(translate(lower(trim_all(s)), 'äöü', 'aou'), 'ß', 'ss')")),
    "sound_code": ("s string", "string", _sound()),
    "email_domain": ("s string", "string", "if(instr(coalesce(s, ''), '@') > 0, lower(substring_index(s, '@', -1)), '')"),
    "fuzzy_ratio": ("a string, b string", "double", "if(greatest(length(a), length(b)) = 0, 0.0D, greatest(0.0D, 1.0D - levenshtein(a, b) / greatest(length(a), length(b))))"),
    "match_quality": (
        "heard string, stored string", "double",
        "least(1.0D, greatest(fuzzy_ratio(normalize_a(heard), normalize_a(stored)), fuzzy_ratio(normalize_a(heard), normalize_b(stored)), fuzzy_ratio(normalize_b(heard), normalize_a(stored)), fuzzy_ratio(normalize_b(heard), normalize_b(stored))) "
        "+ if(normalize_b(heard) != '' and normalize_b(stored) != '' and sound_code(normalize_b(heard)) = sound_code(normalize_b(stored)), 0.35D, 0.0D))",
    ),
    "stage_points": ("first_quality double, last_quality double", "int", "cast(floor(50.0D * (0.35D * first_quality + 0.65D * last_quality) + 0.5D) as int)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark``; returns their names."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {returns} return {body}")
    return list(FUNCTIONS)
