"""Connected components of a link table by alternating large-star and small-star steps.

Each step groups the links by node and hangs neighbours on the smallest one; both are plain joins and
aggregates, so a node with very many links is aggregated before the shuffle and its join can be split.
Before the steps, tasks of about ``TASK_LINKS`` links each fold them with a union-find; where one task holds
all, that is the answer, and else it leaves little to do. Every round is written to the shared folder, so the plan doesn't grow and lost executors don't
start it over. Labels are the smallest id of the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwise.llm.common import drop_path, materialise

#: Links that one union-find holds at a time, and links of a task on average.
FOLD, TASK_LINKS = 1_000_000, 250_000


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def folded(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([np.asarray(p.column(k)) for p in parts]) for k in (0, 1))
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = flat[: len(a)], flat[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = root.copy()
            np.minimum.at(low, u, root[v])
            np.minimum.at(low, v, root[u])
            np.minimum.at(low, root[u], root[v])
            np.minimum.at(low, root[v], root[u])
            low = low[low]
            if np.array_equal(low, root):
                break
            root = low
        some = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= FOLD:
            yield folded(held)
            held = []
    if held:
        yield folded(held)


def connected_components(links: DataFrame, work: str, task_links: int = TASK_LINKS) -> DataFrame:
    """``links``: two long columns. Returns (node, label) for every node whose label is not itself."""
    a, b = links.columns
    tasks = -(-links.count() // task_links)
    pairs = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    if tasks <= 1:
        now = materialise(pairs.coalesce(1).mapInArrow(_fold, "u long, v long"), f"{work}/0")
        return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    now = materialise(pairs.coalesce(tasks).mapInArrow(_fold, "u long, v long").distinct(), f"{work}/0")
    seen, k = None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen, k = state, k + 1
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.union(least).distinct(), f"{work}/{k}")
        if k > 1:
            drop_path(now.sparkSession, f"{work}/{k - 2}")
