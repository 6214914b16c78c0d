"""Attribute maps: pairing names with values, merging by precedence, and nodes written from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwise.functions.text import blank, once, parse_list, utrim
from weftwise.sources.model import visible

NAMES, VALUES, TYPE = "ogit/Automation/systemVariableNames", "ogit/Automation/systemVariableValues", "/IntentType"
SUBJECT, ORIGIN, SCOPE, DEFAULT_SUBJECT = "ogit/subject", "ogit/Automation/originNode", "ogit/scope", "New issue"


def merge(*maps: Column) -> Column:
    """One map, later ones first; it doesn't depend on the session's rule for equal keys."""
    out = maps[0]
    for m in maps[1:]:
        out = once(F.struct(out.alias("base"), m.alias("later"), F.map_keys(m).alias("keys")), lambda x: F.map_concat(F.map_filter(x["base"], lambda k, v: ~F.array_contains(x["keys"], k)), x["later"]))
    return out


def system_variables(attrs: Column) -> Column:
    """Names and values of two comma-separated lists, paired by position.

    Blank names are dropped before pairing, blank values aren't; missing values are empty; of equal names the
    last counts.
    """
    listed = lambda key: F.transform(F.split(blank(F.element_at(attrs, key)), ","), utrim)
    names = F.filter(listed(NAMES), lambda n: n != "")
    paired = lambda x: F.array_sort(F.transform(x["names"], lambda n, i: F.struct(n.alias("n"), i.alias("i"), F.coalesce(F.get(x["values"], i), F.lit("")).alias("v"))))
    last = lambda pairs: F.filter(pairs, lambda p, k: ~(F.get(pairs, k + 1)["n"].eqNullSafe(p["n"])))
    pairs = once(once(F.struct(names.alias("names"), listed(VALUES).alias("values")), paired), last)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["n"], p["v"])))


def by_id(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each request's (id) visible node, with ``status`` ok or not_found; the node's columns are null if it isn't found."""
    found = visible(nodes).withColumn("__found", F.lit(True))
    return requests.join(found, "id", "left").withColumn("status", F.when(F.col("__found"), "ok").otherwise("not_found")).drop("__found", "is_deleted")


def raw_map(json: Column) -> Column:
    """A node's JSON as a map, every field of it unfiltered; null if it isn't an object."""
    return F.from_json(json, "map<string,string>")


def issue_variables(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """``by_id`` over stored issues (id, payload), with all variables of each as ``variables``."""
    return by_id(requests, stored).withColumn("variables", raw_map(F.col("payload"))).drop("payload")


def intents_for(requests: DataFrame, intents: DataFrame) -> DataFrame:
    """(request_id, id, attrs): the intents of each request's ``types``, a comma-separated text; all if it names none."""
    key = lambda all_, value: F.struct(F.lit(all_).alias("all"), value.alias("type"))
    wanted = F.array_distinct(parse_list(F.col("types"), lower=False))
    asked = F.when(F.size(wanted) > 0, F.transform(wanted, lambda t: key(False, t))).otherwise(F.array(key(True, F.lit(""))))
    # an intent answers to its type and to those that name none
    answers = F.array(key(False, F.coalesce(F.element_at("attrs", TYPE), F.lit(""))), key(True, F.lit("")))
    listed = intents.dropDuplicates(["id"]).select("id", "attrs", F.inline(answers))
    return requests.select("request_id", F.inline(asked)).join(listed, ["all", "type"]).select("request_id", "id", "attrs")


def intents_by_type(intents: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Intents of the given types, case-sensitive, each once; all if none is given."""
    wanted = [t for t in types or [] if t]
    found = intents.filter(F.element_at("attrs", TYPE).isin(wanted)) if wanted else intents
    return found.dropDuplicates(["id"])


def issue_attributes(issues: DataFrame) -> DataFrame:
    """Attributes of new issues (system, user: maps; subject, origin, scope): system, then user, then the arguments.

    The subject is the argument, else the attribute ``/subject``, else a default, and is always written.
    """
    subject = F.coalesce(F.nullif(utrim(F.col("subject")), F.lit("")), F.nullif(utrim(F.element_at("user", "/subject")), F.lit("")), F.lit(DEFAULT_SUBJECT))
    own = F.create_map(F.lit(SUBJECT), subject)
    for key, c in ((ORIGIN, "origin"), (SCOPE, "scope")):
        own = F.map_concat(own, F.when(blank(F.col(c)) != "", F.create_map(F.lit(key), F.col(c))).otherwise(F.create_map().cast("map<string,string>")))
    return issues.withColumn("attrs", merge(F.col("system"), F.col("user"), own))


def payload(node_type: str, meta: Column, attrs: Column) -> Column:
    """A node as flat JSON: its type and metadata with the attributes over them, keys in order."""
    whole = merge(F.create_map(F.lit("ogit/_type"), F.lit(node_type)), meta, attrs)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(whole))))

