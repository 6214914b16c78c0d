"""Connected components: of the rows of small groups by a fold within one row, of anything by rounds of joins.

The fold is for groups of a checked size (``split_by_size``). Of the joins, each round hangs every node on its smallest neighbour's smallest
and then links what nodes hang on instead of the nodes; both are
equality joins and an aggregate. Rounds are written to the shared folder, so plans stay short and a lost executor costs one
round. Labels are the smallest key, so the result doesn't depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwise.operators.work import dealt, parts_of, sent_if_few, settle


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of every row of ``nodes`` (node); ``links`` has two columns of nodes, in either direction.

    Each round hangs every node on its smallest neighbour, or on that one's, and then goes on with what it hangs on
    instead: links within one such group are gone, those between groups become one. So a round has only what the one
    before hasn't settled, and all nodes are looked at once, at the end, when the rounds are put together.
    """
    a, b = links.columns
    pairs = settle(links.select(F.col(a).alias("p"), F.col(b).alias("q")).filter("p != q"))
    rounds = []
    while left := pairs.count():
        n = parts_of(2 * left)
        ends = pairs.select(F.inline(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q")))))
        low = dealt(ends, n, "p").groupBy(F.col("p").alias("node")).agg(F.min("q").alias("low"))
        low = settle(low.select("node", F.least("node", "low").alias("low")))
        step = dealt(low, n, "low").alias("x").join(dealt(low, n, "node").alias("y"), F.col("x.low") == F.col("y.node")).select("x.node", F.col("y.low").alias("label"))
        step = settle(step)
        rounds.append((n, step))
        of = lambda end: dealt(step.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), n, end)  # noqa: E731, B023
        between = dealt(dealt(pairs, n, "p").join(of("p"), "p"), n, "q").join(of("q"), "q").select(F.col("p_label").alias("p"), F.col("q_label").alias("q"))
        # what a node hangs on may itself hang on another
        above = dealt(step.select(F.col("label").alias("node")), n, "node").distinct().join(dealt(step, n, "node"), "node").select(F.col("node").alias("p"), F.col("label").alias("q"))
        pairs = between.union(above).filter("p != q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
        pairs = settle(dealt(pairs, n, "p", "q").distinct())
    most = parts_of(nodes.count())
    nodes = dealt(nodes.select("node"), most, "node").distinct()
    if not rounds:
        return nodes.select("node", F.col("node").alias("label"))
    _, labels = rounds.pop()
    while rounds:
        n, step = rounds.pop()
        last = dealt(labels.select(F.col("node").alias("label"), F.col("label").alias("last")), n, "label")
        labels = dealt(step, n, "label").join(last, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return settle(nodes.join(dealt(labels, most, "node"), "node", "left").select("node", F.coalesce("label", "node").alias("label")))


#: Groups of up to so many rows are put together in one row each.
FOLDED = 1024


def folded_components(items: Column, linked: Callable[[Column, Column], Column]) -> Column:
    """An array of structs as an array of its components; ``linked`` tells whether two structs hang together.

    Each struct joins all the components so far that hold one it is linked to, which merges them. Every two structs
    are compared at most, so the array has to be short.
    """

    def join(made: Column, item: Column) -> Column:
        marked = F.transform(made, lambda g: F.struct(F.exists(g, lambda other: linked(other, item)).alias("hit"), g.alias("g")))
        split = lambda m, hit: F.transform(F.filter(m, lambda x: x["hit"] == hit), lambda x: x["g"])
        # the array of one element stands for a name: what is marked is worked out once
        return F.transform(F.array(marked), lambda m: F.concat(split(m, False), F.array(F.concat(F.flatten(split(m, True)), F.array(item)))))[0]

    return F.aggregate(items, F.slice(F.array(items), 1, 0), join)


def split_by_size(rows: DataFrame, scope: list[str], most: int = FOLDED) -> tuple[DataFrame | None, DataFrame | None]:
    """``rows`` of groups of at most ``most`` rows, and of larger ones; none where there are no such groups.

    One small job reads a row's worth of counts; ``rows`` should be a table. Groups are told apart by null keys too.
    The larger ones are joined by sort-merge, as their files' sizes say little of what they are in memory (``settle``).
    """
    sizes = rows.groupBy(*scope).count()
    seen = sizes.agg(F.min("count").alias("least"), F.max("count").alias("most")).first()
    if seen["most"] is None or seen["most"] <= most:
        return rows, None
    if seen["least"] > most:
        return None, rows.hint("merge")
    large = sent_if_few(settle(sizes.filter(F.col("count") > most).select(*[F.col(c).alias(f"__{c}") for c in scope])))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in scope]
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi").hint("merge")


def gathered(rows: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, rows): the rows of each group as an array of structs; for groups of a checked size."""
    return rows.groupBy(*scope).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in scope])).alias("rows"))


def folded_labels(rows: DataFrame, scope: list[str], linked: Callable[[Column, Column], Column], key: str, label: str) -> DataFrame:
    """``rows`` of small groups with ``label``, the smallest ``key`` of those that hang together."""
    parts = gathered(rows, scope).select(*scope, F.explode(folded_components(F.col("rows"), linked)).alias("part"))
    parts = parts.select(*scope, F.array_min(F.transform("part", lambda r: r[key])).alias(label), F.inline("part"))
    return parts.select(*rows.columns, label)
