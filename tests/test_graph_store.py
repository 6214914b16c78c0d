"""Paths along edges, clusters kept over batches, and the store of nodes."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_plans import FIELDS, closure, d, h, table

from weftwise.operators import cluster, incremental
from weftwise.operators.graph import TO_ACCOUNTS, TO_PERSONS, TO_TICKETS
from weftwise.operators.nodes import NodeStore
from weftwise.operators.traverse import IN, OUT, Step, traverse

EDGE = "out_id string, verb string, in_id string"


def walked(starts, edges, steps, kinds):
    """The same by plain sets."""
    at = {(q, n) for q, n in starts if n is not None}
    for step in steps:
        hops = set()
        for o, verb, i in edges:
            hops |= {(o, i)} if (OUT, verb) in step.along else set()
            hops |= {(i, o)} if (IN, verb) in step.along else set()
        at = {(q, b) for q, n in at for a, b in hops if a == n and (step.node_type is None or kinds.get(b) == step.node_type)}
    return sorted(at)


def test_paths_against_plain_sets(spark):
    rng = random.Random(6)
    persons, tickets, accounts = ([f"{c}{i}" for i in range(12)] for c in "pta")
    edges = [(rng.choice(tickets), rng.choice(["affects", "assignedTo", "relates"]), rng.choice(persons)) for _ in range(40)]
    edges += [(rng.choice(persons), "opens", rng.choice(tickets + ["gone"])) for _ in range(15)] + [(rng.choice(accounts), "connects", rng.choice(persons)) for _ in range(15)]
    edges += edges[:5]
    kinds = {**dict.fromkeys(persons, "person"), **dict.fromkeys(tickets, "ticket"), **dict.fromkeys(accounts, "account")}
    starts = [(q, rng.choice(persons)) for q in range(8)] + [(3, "p1"), (3, "p1"), (9, None), (10, "nowhere")]
    typed = lambda s, t: Step(s.along, t)
    for steps in ([], [TO_TICKETS], [typed(TO_TICKETS, "ticket")], [TO_TICKETS, TO_PERSONS], [typed(TO_TICKETS, "ticket"), typed(TO_PERSONS, "person"), typed(TO_ACCOUNTS, "account")], [Step(((IN, "affects"), (OUT, "affects")))] * 3):
        got = traverse(spark.createDataFrame(starts, "request_id int, node string"), spark.createDataFrame(edges, EDGE), steps, spark.createDataFrame(list(kinds.items()), "id string, type string"))
        assert sorted(map(tuple, got.collect())) == walked(starts, edges, steps, kinds)
    assert traverse(spark.createDataFrame(starts, "request_id int, node string"), spark.createDataFrame([], EDGE), [TO_TICKETS]).count() == 0


def people_of(rng, ids):
    rows = []
    for i in ids:
        p = dict(zip(FIELDS, (d if i % 3 else h)(f"{i:03d}", email=rng.choice(["", "a@x", "b@x", "c@x", "e@x", "f@x"])), strict=True))
        for c in ("office_phone", "mobile_phone") if i % 3 else ("phone_no",):
            p[c] = rng.choice(["", "", "0", f"+{rng.randrange(40)}"])
        rows.append(tuple(p[c] for c in FIELDS))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_batches_equal_a_rebuild(spark, seed):
    """After each random batch of persons who come, go, or come back changed."""
    rng = random.Random(seed)
    now = {r[0]: r for r in people_of(rng, range(40))}
    state = incremental.build(table(spark, list(now.values())))
    for batch in range(3):
        going = rng.sample(sorted(now), 8) + ["nobody"]
        coming = {r[0]: r for r in people_of(rng, [*range(40 + 10 * batch, 50 + 10 * batch), *rng.sample(range(40), 6)])}
        gone = spark.createDataFrame([(f"{s}:{i}",) for i in going for s in ("directory", "helpdesk")], "record_key string")
        state = incremental.update(state, table(spark, list(coming.values())), gone)
        now = {k: v for k, v in now.items() if k not in going} | coming
        keyed = table(spark, list(now.values())).select("record_key", "source", cluster.link_keys().alias("keys")).collect()
        links = [(a["record_key"], b["record_key"]) for a in keyed for b in keyed if a["source"] == b["source"] and set(a["keys"]) & set(b["keys"])]
        got = {r["record_key"]: r["cluster"] for r in incremental.records(state).collect()}
        assert got == closure([r["record_key"] for r in keyed], links)


def test_batches_of_nobody(spark):
    people = table(spark, people_of(random.Random(3), range(9)))
    state, none = incremental.build(people), people.limit(0)
    again = incremental.update(state, none, none.select("record_key"))
    assert sorted(map(tuple, incremental.records(again).collect())) == sorted(map(tuple, incremental.records(state).collect()))
    empty = incremental.update(state, none, people.select("record_key"))
    assert incremental.records(empty).count() == 0 and incremental.records(incremental.update(empty, people, none.select("record_key"))).count() == 9
    assert incremental.records(incremental.build(none)).count() == 0


def issues(spark, numbers):
    return spark.createDataFrame([(i,) for i in numbers], "n long").select(F.create_map(F.lit("/n"), F.col("n").cast("string")).alias("attrs"))


def test_store_of_nodes(spark, tmp_path):
    store = NodeStore(spark, f"file://{tmp_path}/nodes")
    assert store.read().count() == 0 and store.commits() == []
    first = store.write(issues(spark, [1, 2, 2, 3]), "T")
    assert first.count() == 3 and len(store.commits()) == 1
    # a rerun adds nothing, an overlap only what is new
    assert store.write(issues(spark, [3, 2, 1]), "T").count() == 3 and len(store.commits()) == 1
    store.write(issues(spark, [3, 4]), "T")
    assert sorted(json.loads(r["payload"])["/n"] for r in store.read().collect()) == ["1", "2", "3", "4"] and len(store.commits()) == 2
    assert store.read().select("id").distinct().count() == 4
    assert store.write(issues(spark, []), "T").count() == 0 and len(store.commits()) == 2
    assert NodeStore(spark, f"file://{tmp_path}/nodes").read().count() == 4


def test_broken_and_rival_writes(spark, tmp_path, monkeypatch):
    """Data without a commit isn't read; who commits second looks again and adds only what the first hasn't."""
    store, rival = (NodeStore(spark, f"file://{tmp_path}/nodes") for _ in range(2))
    store.write(issues(spark, [1]), "T")
    issues(spark, [9]).select(F.lit("x").alias("id"), F.lit("{}").alias("payload")).write.parquet(f"{tmp_path}/nodes/data/lost")
    (tmp_path / "nodes/commits/000000000001.json").write_text("")  # created, not yet written out
    assert store.read().count() == 1
    commit, met = store._commit, []

    def late(number, entry):
        if not met:
            met.append(rival.write(issues(spark, [2, 3]), "T"))
        return commit(number, entry)

    monkeypatch.setattr(store, "_commit", late)
    store.write(issues(spark, [3, 4]), "T")
    assert sorted(json.loads(r["payload"])["/n"] for r in store.read().collect()) == ["1", "2", "3", "4"]
    assert len(store.commits()) == 3
