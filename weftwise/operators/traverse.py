"""Paths along edges: a list of steps, each compiled to joins.

The frontier is (request_id, node), each pair once. A step finds the neighbours of the frontier's distinct nodes first:
edges are cut down to those that begin at one of them (a semi-join) and end at a node of the wanted type (another),
however many requests stand on a node. Only then do requests follow. Nothing is iterated on the driver but the list of steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT, IN = "out", "in"


@dataclass(frozen=True)
class Step:
    """Along edges of any of the (direction, verb) pairs to nodes of ``node_type``; to any if it is None.

    ``out`` follows an edge from its out_id to its in_id, ``in`` the other way.
    """

    along: tuple[tuple[str, str], ...]
    node_type: str | None = None


def neighbours(edges: DataFrame, step: Step) -> DataFrame:
    """(node, next) of the edges that a step follows."""
    ends = {OUT: ("out_id", "in_id"), IN: ("in_id", "out_id")}
    sides = []
    for direction, (a, b) in ends.items():
        verbs = [verb for way, verb in step.along if way == direction]
        if verbs:
            sides.append(edges.filter(F.col("verb").isin(*verbs)).select(F.col(a).alias("node"), F.col(b).alias("next")))
    return reduce(DataFrame.union, sides)


def follow(frontier: DataFrame, edges: DataFrame, step: Step, nodes: DataFrame | None = None) -> DataFrame:
    """The frontier after one step. Without a type to filter by, an edge to a node that doesn't exist is followed as well."""
    hops = neighbours(edges, step).join(frontier.select("node").distinct(), "node", "left_semi")
    if step.node_type is not None:
        wanted = nodes.filter(F.col("type") == step.node_type).select(F.col("id").alias("next"))
        hops = hops.join(wanted, "next", "left_semi")
    return frontier.join(hops.distinct(), "node").select("request_id", F.col("next").alias("node")).distinct()


def traverse(starts: DataFrame, edges: DataFrame, steps: list[Step], nodes: DataFrame | None = None) -> DataFrame:
    """(request_id, node): what each request reaches from its start (request_id, node) by all ``steps``, each node once.

    ``edges`` has out_id, verb and in_id, ``nodes`` id and type. Nulls reach nothing; repeated edges and starts count once;
    without steps the starts come back.
    """
    frontier = starts.select("request_id", "node").filter("node is not null").distinct()
    return reduce(lambda at, step: follow(at, edges, step, nodes), steps, frontier)
