"""Lookups of persons for a table of requests: by phone, by name, by prefix and by what follows the first letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwise.functions.phonetic import first_letter_variants
from weftwise.functions.text import split_first, split_last
from weftwise.sources.model import DIRECTORY, HELPDESK

DIRECTORY_PHONES = ("office_phone", "mobile_phone", "other_phone")
HELPDESK_PHONES = ("phone_no", "office_phone")


def searched_phones() -> Column:
    """The phone fields that a phone search looks at, by source."""
    own = F.when(F.col("source") == DIRECTORY, F.array(*DIRECTORY_PHONES)).otherwise(F.array(*HELPDESK_PHONES))
    return F.array_distinct(F.filter(own, lambda p: p != ""))


def by_phone(requests: DataFrame, person: DataFrame) -> DataFrame:
    """Persons with the very phone in any searched field, once for each request (request_id, phone)."""
    listed = person.withColumn("phone", F.explode(searched_phones()))
    return requests.select("request_id", "phone").filter("phone != ''").join(listed, "phone").drop("phone")


def by_name(requests: DataFrame, person: DataFrame) -> DataFrame:
    """Persons of equal first and last name, ignoring case (request_id, name)."""
    asked = requests.select("request_id", F.lower(split_first(F.col("name"))).alias("first_key"), F.lower(split_last(F.col("name"))).alias("last_key"))
    return asked.join(person, ["first_key", "last_key"])


def first_hits(found: DataFrame, by: list[str], limit: int | None) -> DataFrame:
    """At most ``limit`` persons of each group, those of the smallest record keys; all without a limit."""
    if limit is None:
        return found
    order = Window.partitionBy(*by).orderBy("record_key")
    return found.withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= limit).drop("__nth")


def domain_filter(found: DataFrame, requests: DataFrame) -> DataFrame:
    """Only persons of the request's e-mail domains; all if it names none. No domain matches no list."""
    asked = requests.select("request_id", F.col("domains").alias("wanted"))
    ok = (F.coalesce(F.size("wanted"), F.lit(0)) <= 0) | ((F.col("domain") != "") & F.array_contains("wanted", F.col("domain")))
    return found.join(asked, "request_id").filter(ok).drop("wanted")


def _lengths(probes: DataFrame) -> DataFrame:
    """The pairs of prefix lengths that occur: sixteen rows at most."""
    return F.broadcast(probes.select("first_n", "last_n").distinct())


def prefix_hits(probes: DataFrame, person: DataFrame, phonetic: bool = True) -> DataFrame:
    """(probe columns, record_key) of persons whose names begin with a probe's ``first_prefix`` and ``last_prefix``.

    Prefixes have 0 to 3 letters; length and prefix are join keys, so it stays an equality join. For helpdesk
    records the last name's first letter also stands for those that sound like it (``phonetic``).
    """
    probes = probes.withColumns({"first_n": F.length("first_prefix"), "last_n": F.length("last_prefix")})
    both = F.transform(F.lit([DIRECTORY, HELPDESK]), lambda s: F.struct(s.alias("source"), F.when((s == HELPDESK) & F.lit(phonetic), first_letter_variants(F.col("last_prefix"))).otherwise(F.array("last_prefix")).alias("variants")))
    asked = probes.select("*", F.inline(both)).withColumn("last_variant", F.explode("variants")).drop("variants")
    names = person.select("record_key", "source", "first_forms", "last_forms").join(_lengths(probes))
    cut = lambda forms, n: F.array_distinct(F.transform(F.filter(forms, lambda x: F.length(x) >= n), lambda x: F.substr(x, F.lit(1), n)))
    names = names.withColumn("first_prefix", F.explode(cut(F.col("first_forms"), F.col("first_n")))).withColumn("last_variant", F.explode(cut(F.col("last_forms"), F.col("last_n"))))
    names = names.select("record_key", "source", "first_n", "last_n", "first_prefix", "last_variant")
    hit = asked.join(names, ["source", "first_n", "last_n", "first_prefix", "last_variant"])
    return hit.select(*[c for c in probes.columns if c not in ("first_n", "last_n")], "record_key").distinct()


def suffix_hits(probes: DataFrame, person: DataFrame) -> DataFrame:
    """As ``prefix_hits``, for last names whose part from the second letter on begins with ``last_suffix`` (three letters at least)."""
    probes = probes.withColumn("first_n", F.length("first_prefix"))
    lengths = F.broadcast(probes.select("first_n").distinct())
    names = person.select("record_key", "first_forms", "last_forms").join(lengths)
    cut = F.array_distinct(F.transform(F.filter("first_forms", lambda x: F.length(x) >= F.col("first_n")), lambda x: F.substr(x, F.lit(1), F.col("first_n"))))
    names = names.withColumn("first_prefix", F.explode(cut)).withColumn("rest", F.explode(F.array_distinct(F.transform("last_forms", lambda x: F.substr(x, F.lit(2))))))
    names = names.select("record_key", "first_n", "first_prefix", "rest", F.substring("rest", 1, 3).alias("start"))
    hit = probes.withColumn("start", F.substring("last_suffix", 1, 3)).join(names, ["first_n", "first_prefix", "start"]).filter(F.col("rest").startswith(F.col("last_suffix")))
    return hit.select(*[c for c in probes.columns if c != "first_n"], "record_key").distinct()
