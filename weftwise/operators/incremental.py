"""Clusters that are kept: persons who come are merged into them, and those who go have only their own cluster rebuilt.

The state is two written tables: ``links`` (node, key) of each record with what it shares (``cluster.link_keys``), and
``labels`` (node, label) of records and keys alike, the label being the smallest record. Coming records touch the labels
of their keys only: the components of a graph of labels, which has a node a touched cluster, say which labels become which.
Going records mark their labels; those clusters' links alone are put together anew. All else is one join with a small table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwise.operators.cluster import link_keys
from weftwise.operators.components import connected_components
from weftwise.operators.work import settle

#: Stands before keys, so that they sort behind all records.
_KEY = "~"


@dataclass(frozen=True)
class State:
    labels: DataFrame
    links: DataFrame


def _links(records: DataFrame) -> DataFrame:
    """(node, key) of each record; keys belong to a source."""
    return records.select(F.col("record_key").alias("node"), F.explode(link_keys()).alias("k"), "source").select("node", F.concat(F.lit(_KEY), "source", F.lit(" "), "k").alias("key")).distinct()


def _labelled(records: DataFrame, links: DataFrame) -> DataFrame:
    nodes = records.select("node").union(links.select(F.col("key").alias("node")))
    return connected_components(nodes, links.select("node", "key"))


def build(records: DataFrame) -> State:
    """The state of a table of persons (with ``model.with_keys``)."""
    links = settle(_links(records))
    return State(settle(_labelled(records.select(F.col("record_key").alias("node")), links)), links)


def update(state: State, coming: DataFrame, going: DataFrame) -> State:
    """The state after ``going`` (record_key) have left and then ``coming`` (persons) have joined.

    A record that is in both comes back as it is in ``coming``; one that comes and is there already is taken in its
    new form. Records that go and aren't there don't matter, nor do repeated rows.
    """
    gone = settle(going.select(F.col("record_key").alias("node")).union(coming.select("record_key")).distinct())
    return _added(_removed(state, gone), coming)


def _removed(state: State, gone: DataFrame) -> State:
    broken = settle(state.labels.join(gone, "node", "left_semi").select("label").distinct())
    if broken.isEmpty():
        return state
    hit = state.labels.join(broken, "label", "left_semi").select("node")
    left = hit.filter(~F.col("node").startswith(_KEY)).join(gone, "node", "left_anti")
    links = settle(state.links.join(gone, "node", "left_anti"))
    inside = settle(links.join(left, "node", "left_semi"))
    anew = _labelled(settle(left), inside)
    return State(settle(state.labels.join(broken, "label", "left_anti").select("node", "label").union(anew.select("node", "label"))), links)


def _added(state: State, coming: DataFrame) -> State:
    links = settle(_links(coming))
    records = coming.select(F.col("record_key").alias("node")).distinct()
    # a key that is known stands for its cluster
    known = links.join(state.labels.withColumnRenamed("node", "key"), "key", "left")
    graph = settle(known.select("node", F.coalesce("label", "key").alias("to")))
    touched = settle(connected_components(records.union(graph.select("to")), graph))
    fresh = links.select(F.col("key").alias("node")).distinct().join(state.labels, "node", "left_anti").union(records)
    old = state.labels.join(touched.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    return State(settle(old.union(touched.join(fresh, "node").select("node", "label"))), settle(state.links.union(links)))


def records(state: State) -> DataFrame:
    """(record_key, cluster) of the records."""
    return state.labels.filter(~F.col("node").startswith(_KEY)).select(F.col("node").alias("record_key"), F.col("label").alias("cluster"))
