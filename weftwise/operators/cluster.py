"""Which records are one person: links by key, the cascade across sources, clusters and their representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwise.functions.text import fold_equal
from weftwise.operators.components import FOLDED, connected_components, folded_labels, split_by_size
from weftwise.operators.lookup import DIRECTORY_PHONES
from weftwise.operators.work import dealt, parts_of, settle
from weftwise.sources.model import DIRECTORY


def usable_phones() -> Column:
    """Phones that link records: neither empty nor the placeholder 0; for helpdesk only its own number."""
    own = F.when(F.col("source") == DIRECTORY, F.array(*DIRECTORY_PHONES)).otherwise(F.array("phone_no"))
    return F.array_distinct(F.filter(own, lambda p: ~p.isin("", "0")))


def link_keys(exclude_phone: bool | Column = False) -> Column:
    """What records of one source must share to be linked, as strings; ``exclude_phone`` may differ by row."""
    email = F.when(F.col("email") != "", F.array(F.concat(F.lit("email "), F.lower("email")))).otherwise(F.array().cast("array<string>"))
    phones = F.transform(usable_phones(), lambda p: F.concat(F.lit("phone "), p))
    without = exclude_phone if isinstance(exclude_phone, Column) else F.lit(exclude_phone)
    return F.when(without, email).otherwise(F.concat(email, phones))


def key_leaders(records: DataFrame, scope: list[str], exclude_phone: bool | Column = False) -> DataFrame:
    """(scope, source, k, record_key, leader, members): each record's link keys with the smallest record of each and how many have it."""
    n = parts_of(4 * records.count())  # a record has four keys at most
    keyed = records.withColumn("k", F.explode(link_keys(exclude_phone))).select(*scope, "source", "k", "record_key")
    keyed = dealt(keyed, n, *scope, "source", "k").distinct()
    leader = keyed.groupBy(*scope, "source", "k").agg(F.min("record_key").alias("leader"), F.count(F.lit(1)).alias("members"))
    return keyed.join(leader, [*scope, "source", "k"])


def same_person(d: Column | str, h: Column | str) -> Column:
    """The first field that both sides have decides: e-mail, then phone, then name. A phone of 0 counts here.

    ``d`` (directory) and ``h`` (helpdesk) are structs, or names of joined tables.
    """
    side = lambda of: (lambda c: F.col(f"{of}.{c}")) if isinstance(of, str) else (lambda c: of[c])
    x, y = side(d), side(h)
    phones = [x(c) for c in DIRECTORY_PHONES]
    any_phone = (phones[0] != "") | (phones[1] != "") | (phones[2] != "")
    return (
        F.when((x("email") != "") & (y("email") != ""), fold_equal(x("email"), y("email")))
        .when((y("phone_no") != "") & any_phone, y("phone_no").isin(*phones))
        .otherwise(fold_equal(x("first_name"), y("first_name")) & fold_equal(x("last_name"), y("last_name")))
    )


def _cross_groups(records: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Records listed under their groups, the pairs of groups (source, group, leader, other_key, others) that are linked,
    the group's columns, and in how many parts the listed records are dealt.

    Each step of the cascade in ``same_person`` decides its own pairs: e-mail those in which both sides have one,
    phone those of the rest in which both have one, name what is left. So the records that share a key of a step,
    split by what they have, are groups of which either all or no members are linked, and only groups are joined.
    """
    has_email, own = F.col("email") != "", F.col("source") == DIRECTORY
    phones = F.array_distinct(F.filter(F.when(own, F.array(*DIRECTORY_PHONES)).otherwise(F.array("phone_no")), lambda p: p != ""))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    keys = F.concat(
        F.when(has_email, F.array(key("e", F.lower("email")))).otherwise(none), F.transform(phones, lambda p: key("p", p)),
        F.array(key("n", F.concat(F.lower("first_name"), F.lit("\x1f"), F.lower("last_name")))),
    )
    group = [*scope, "kind", "value", "has_email", "has_phone"]
    listed = records.select(*scope, "source", "record_key", has_email.alias("has_email"), (F.size(phones) > 0).alias("has_phone"), F.inline(keys))
    n = parts_of(5 * records.count())  # a record has five keys at most
    listed = dealt(listed, n, "source", *group)
    groups = settle(listed.groupBy("source", *group).agg(F.min("record_key").alias("leader"), F.count(F.lit(1)).alias("n")))
    # groups are joined source with source, a row for each of both sides
    groups = groups.withColumn("at", F.struct(*scope, "kind", "value"))
    near, far = (dealt(groups.filter(side), n, "at").alias(name) for side, name in ((own, "a"), (~own, "b")))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    decides = F.when(a("kind") == "e", True).when(a("kind") == "p", ~(a("has_email") & b("has_email"))).otherwise(~(a("has_email") & b("has_email")) & ~(a("has_phone") & b("has_phone")))
    met = near.join(far, a("at") == b("at")).filter(decides)  # as parts of a struct nulls are equal
    side = lambda x, y: F.struct(x("source").alias("source"), *[x(c).alias(c) for c in group], x("leader").alias("leader"), y("leader").alias("other_key"), y("n").alias("others"))
    return listed, dealt(met.select(F.inline(F.array(side(a, b), side(b, a)))), n, "source", *group), group, n


def cross_links(records: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, record_key, source, other_key, others): each record that is one person with records of the other source.

    ``others`` counts those records and ``other_key`` is the smallest of them; no pairs are made.
    """
    listed, met, group, n = _cross_groups(records, scope)
    met = met.groupBy("source", *group).agg(F.min("other_key").alias("other_key"), F.sum("others").alias("others"))
    linked = dealt(listed.join(met, ["source", *group]), n, *scope, "source", "record_key")
    return linked.groupBy(*scope, "source", "record_key").agg(F.min("other_key").alias("other_key"), F.sum("others").alias("others"))


def cross_scopes(records: DataFrame, scope: list[str]) -> DataFrame:
    """(scope) of those scopes in which a record is one person with one of the other source."""
    return _cross_groups(records, scope)[1].select(*scope).distinct()


def cross_edges(records: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, p, q): links that connect what ``same_person`` connects: linked groups by their leaders, and each
    member of such a group with its leader (they are one person by way of the other source)."""
    listed, met, group, n = _cross_groups(records, scope)
    between = met.select(*scope, F.col("leader").alias("p"), F.col("other_key").alias("q"))
    leaders = met.select("source", *group, "leader").distinct()
    within = listed.join(leaders, ["source", *group]).select(*scope, F.col("record_key").alias("p"), F.col("leader").alias("q"))
    return dealt(between.union(within).filter("p != q"), n, *scope, "p", "q").distinct()


def _node(scope: list[str], key: str) -> Column:
    return F.concat_ws("\x1f", *[F.col(c).cast("string") for c in scope], F.col(key))


def clusters(records: DataFrame, scope: list[str], exclude_phone: bool | Column = False, across: bool = False, folded: int = FOLDED) -> DataFrame:
    """``records`` with ``cluster``, the smallest record key of those that are one person within the scope.

    Scopes of up to ``folded`` records are put together in one row each, after one grouping; larger ones by joins,
    where records of one source that share a key hang on the key's smallest record, so no pairs are made. ``across``
    also links the two sources. ``records`` is read several times, so it should be a table (``settle``).
    """
    few, many = split_by_size(records, scope, folded)
    made = ([] if few is None else [_folded_clusters(few, scope, exclude_phone, across)]) + ([] if many is None else [_joined_clusters(many, scope, exclude_phone, across)])
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def keyed_records(records: DataFrame, exclude_phone: bool | Column = False) -> DataFrame:
    """``records`` with what a comparison looks at made once a record: link keys, folded e-mail and name, phones."""
    phones = F.array_distinct(F.filter(F.when(F.col("source") == DIRECTORY, F.array(*DIRECTORY_PHONES)).otherwise(F.array("phone_no")), lambda p: p != ""))
    return records.withColumns({"__keys": link_keys(exclude_phone), "__mail": F.lower("email"), "__name": F.concat_ws("\x1f", F.lower("first_name"), F.lower("last_name")), "__phones": phones})


def linked_within(a: Column, b: Column) -> Column:
    """Whether two structs of ``keyed_records`` are of one source and share a key."""
    return (a["source"] == b["source"]) & F.arrays_overlap(a["__keys"], b["__keys"])


def linked_across(a: Column, b: Column) -> Column:
    """``same_person`` of two structs of ``keyed_records``; false within a source."""
    return (
        F.when(a["source"] == b["source"], False).when((a["__mail"] != "") & (b["__mail"] != ""), a["__mail"] == b["__mail"])
        .when((F.size(a["__phones"]) > 0) & (F.size(b["__phones"]) > 0), F.arrays_overlap(a["__phones"], b["__phones"])).otherwise(a["__name"] == b["__name"])
    )


def linked(a: Column, b: Column) -> Column:
    """Either of the two."""
    return F.when(a["source"] == b["source"], F.arrays_overlap(a["__keys"], b["__keys"])).otherwise(linked_across(a, b))


def _folded_clusters(records: DataFrame, scope: list[str], exclude_phone: bool | Column, across: bool) -> DataFrame:
    return folded_labels(keyed_records(records, exclude_phone), scope, linked if across else linked_within, "record_key", "cluster").select(*records.columns, "cluster")


def _joined_clusters(records: DataFrame, scope: list[str], exclude_phone: bool | Column, across: bool) -> DataFrame:
    links = key_leaders(records, scope, exclude_phone).select(_node(scope, "record_key").alias("p"), _node(scope, "leader").alias("q"))
    if across:
        links = links.union(cross_edges(records, scope).select(_node(scope, "p"), _node(scope, "q")))
    nodes = records.select(_node(scope, "record_key").alias("node"))
    labels = connected_components(nodes, links)
    cluster, n = F.substring_index("label", "\x1f", -1), parts_of(records.count())
    return dealt(records.withColumn("node", _node(scope, "record_key")), n, "node").join(dealt(labels, n, "node"), "node").withColumn("cluster", cluster).drop("node", "label")


def field_score() -> Column:
    """Identifying fields that are filled; the placeholder phone counts."""
    fields = lambda *names: sum((F.col(c) != "").cast("int") for c in names)
    return F.when(F.col("source") == DIRECTORY, fields("email", *DIRECTORY_PHONES, "first_name", "last_name")).otherwise(fields("email", "phone_no", "first_name", "last_name"))


def ranked(r: Column) -> Column:
    """A struct of a record with its ``__score`` (``field_score``); ``representatives`` takes the smallest."""
    return F.struct((r["xid"] == "").alias("o"), (-r["__score"]).alias("s"), r["id"].alias("id"), r.alias("r"))


def best_of(rows: Column, source: str) -> Column:
    """The record of an array of structs that ``representatives`` takes for one source; null if it has none."""
    own = F.filter(rows, lambda r: r["source"] == source)
    return F.array_min(F.transform(own, ranked))["r"]


def representatives(clustered: DataFrame, by: list[str]) -> DataFrame:
    """The best record of each group and source: with an external id, then most filled, then the lowest id."""
    best = Window.partitionBy(*by, "source").orderBy((F.col("xid") != "").desc(), field_score().desc(), F.col("id").asc())
    return clustered.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")


def external_id(xid: Column, id_: Column) -> Column:
    return F.when(F.coalesce(xid, F.lit("")) != "", xid).otherwise(id_)
