"""One table for nodes of all types: (id, type, data), data being a VARIANT, whatever a node holds.

Nothing is checked when nodes are written. A reader names the fields that it needs, with their types; they are read by
path, and nodes that don't fit are told in a table of rejects, with the reason, instead of failing the job or vanishing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_nodes(rows: DataFrame, node_type: str, id_col: str = "id", json: Column | None = None) -> DataFrame:
    """(id, type, data) of rows: all their other columns as data, or a JSON text; data is null where that is none."""
    if json is None:
        json = F.to_json(F.struct(*[c for c in rows.columns if c != id_col]), {"ignoreNullFields": "false"})
    return rows.select(F.col(id_col).cast("string").alias("id"), F.lit(node_type).alias("type"), F.try_parse_json(json).alias("data"))


def field(name: str, kind: str) -> Column:
    """A field of ``data`` by its name, null if it is missing or can't be read as ``kind``."""
    return F.try_variant_get("data", f"$[{_quoted(name)}]", kind)


def _quoted(name: str) -> str:
    if '"' in name or "\\" in name:
        raise ValueError(f"a field's name can't have quotes or backslashes: {name}")
    return f'"{name}"'


def typed(nodes: DataFrame, node_type: str, schema: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The nodes of a type with the fields of ``schema`` ("name type, ..."; without ``id``, which is always there), and
    rejects (id, type, reason).

    A field may be missing or null unless it is ``required``; a value that can't be read as its type rejects the node,
    and so does data that isn't an object. A number is read as a text where a text is wanted; objects and arrays aren't.
    Repeated nodes stay repeated.
    """
    fields = [tuple(x.split()) for x in schema.split(", ") if x.split()[0] != "id"]
    own = nodes.filter(F.col("type") == node_type)
    shape = F.schema_of_variant("data")
    whole = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    said = []
    for name, kind in fields:
        raw = F.schema_of_variant(F.try_variant_get("data", f"$[{_quoted(name)}]", "variant"))
        there = raw.isNotNull() & (raw != "VOID")
        bad = there & (field(name, kind).isNull() | raw.startswith("OBJECT") | raw.startswith("ARRAY"))
        said.append(F.when(bad, F.lit(f"{name} is no {kind}")))
        if name in required:
            said.append(F.when(~there, F.lit(f"{name} is missing")))
    reason = F.when(~whole, F.lit("no object")).otherwise(F.nullif(F.concat_ws("; ", *said), F.lit("")))
    judged = own.withColumn("reason", reason)
    good = judged.filter("reason is null").select("id", *[field(name, kind).alias(name) for name, kind in fields])
    return good, judged.filter("reason is not null").select("id", "type", "reason")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
