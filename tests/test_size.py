"""What must not grow faster than the tables: what is sent through the driver, shuffled, or worked out more than once."""

from pyspark.sql import functions as F
from test_plans import FIELDS, d, h, table

from weftwise import queries
from weftwise.operators import cluster, components, work
from weftwise.operators.components import split_by_size
from weftwise.operators.work import settle
from weftwise.plans import match, resolve
from weftwise.sources import index as person_index
from weftwise.sources.index import PersonIndex
from weftwise.sources.model import MATCH_REQUEST, RESOLVE_REQUEST


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_of_many_rows_are_not_broadcast(spark):
    """Files of repeated values are far below Spark's limit for broadcasts, however many rows they hold."""
    rows = settle(spark.range(400_000).select("id", F.lit("x" * 400).alias("text"), (F.col("id") % 2).alias("q")))
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10 * 2**20
    assert "Broadcast" not in plan_of(rows.filter("id > 1").join(rows.select("id", "text"), "id"))
    many = split_by_size(rows.union(spark.range(1).select("id", F.lit("").alias("text"), F.lit(9).cast("long").alias("q"))), ["q"], 5)[1]
    grouped = many.groupBy("q", "text").count()
    assert "Broadcast" not in plan_of(many.alias("a").join(grouped, ["q", "text"])).split("SortMergeJoin")[0]
    few = settle(spark.range(10))
    assert "BroadcastHashJoin" in plan_of(rows.join(few, "id", "left_semi").select("id")) or "BroadcastHashJoin" in plan_of(few.join(few, "id"))


def test_renderings_that_are_spelt_alike_are_worked_out_once(spark):
    person = table(spark, [d("1", "Maik", "Lander"), d("2", "Maike", "Lande"), h("3", "Maik", "Lander")])
    asked = spark.createDataFrame([(1, ("Maik", " maik ", "<a>Maike</a>", None, None), ("Lander", "lander", "<b>Lander</b>", None, None), [], "")], MATCH_REQUEST)
    reps = match.representations(asked)
    _, heard = match.heard_groups(asked, reps, person)
    assert {tuple(sorted(r["same"])) for r in heard.collect()} == {("nlp", "raw"), ("tagged",)}
    kept = match.best_groups(asked, reps, person).collect()
    by_rep = {rep: {(r["cluster"], r["record_key"], r["stage_points"]) for r in kept if r["rep"] == rep} for rep in ("raw", "nlp", "tagged")}
    assert by_rep["raw"] == by_rep["nlp"] and len(by_rep["raw"]) == len(by_rep["tagged"]) == 3
    assert {r["rep"] for r in match.scoring_report(heard).collect()} == {"raw", "nlp", "tagged"}


def test_index_records_are_fetched_once_for_equal_probes(spark, tmp_path):
    """Ten times the probes, all of them alike: ten times the rows, and no more records read from the index."""
    person = table(spark, [(d if i % 2 else h)(str(i), "Maik", "Lander", email=f"p{i}@x.example") for i in range(50)])
    index = PersonIndex.write(person, f"file://{tmp_path}/x", buckets=2, spread=2)
    fields = {"prefix": ("last_prefix", "lan", index.prefix_hits, index.records_by_prefix, index._different_prefix_hits), "suffix": ("last_suffix", "ander", index.suffix_hits, index.records_by_suffix, index._different_suffix_hits)}
    for column, value, hits, records, different in fields.values():
        asked = spark.range(10).select(F.col("id").alias("request_id"), F.lit("mai").alias("first_prefix"), F.lit(value).alias(column))
        asked = asked.union(asked.limit(1))
        got, want = records(asked, ["record_key", "email"]), index.fetched(hits(asked)).select(*asked.columns, "record_key", "email")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 500
        assert different(asked)[1].count() == 50
    index.close(spark)


def test_rounds_have_only_what_is_not_settled(spark, monkeypatch):
    """Small components are done after a round, so what later rounds write is of the chain alone."""
    written = []
    monkeypatch.setattr(components, "settle", lambda df: written.append(settle(df)) or written[-1])
    chain, small = [(f"a{i:02d}", f"a{i + 1:02d}") for i in range(20)], [(f"c{i:03d}", f"b{i:03d}") for i in range(200)]
    links = spark.createDataFrame(chain + small, "p string, q string")
    nodes = links.select(F.col("p").alias("node")).union(links.select("q"))
    got = dict(map(tuple, components.connected_components(nodes, links).collect()))
    assert got == {x: "a00" if x[0] == "a" else f"b{x[1:]}" for x in {y for link in chain + small for y in link}}
    sizes = [w.count() for w in written]
    assert max(sizes[3:-1]) <= 42


def same_named(spark, n):
    """Persons of both sources, all of one name, some of whom share an e-mail address or phone."""
    people = []
    for i in range(n):
        p = dict(zip(FIELDS, (d if i % 3 else h)(str(i), "Maik", "Lander", email=f"p{i // 6}@x.example" if i % 2 else ""), strict=True))
        p["phone_no" if i % 3 == 0 else "office_phone"] = f"+{i // 4}" if i % 5 else ""
        people.append(tuple(p[c] for c in FIELDS))
    return table(spark, people)


def merged_by_bytes(df):
    """Shuffles of rows whose number of parts is Spark's, which merges them by their bytes."""
    return [x for x in plan_of(df).splitlines() if "hashpartitioning" in x and "REPARTITION_BY_NUM" not in x]


def test_links_are_dealt_by_rows(spark, monkeypatch):
    """However well the rows compress, a task has only so many of them, and the links are the same."""
    people = settle(same_named(spark, 400).withColumn("r", F.lit(0)))
    want = sorted(map(str, cluster.cross_links(people, ["r"]).collect()))
    monkeypatch.setattr(work, "ROWS_A_TASK", 50)
    for links in (cluster.cross_links(people, ["r"]), cluster.cross_edges(people, ["r"]), cluster.key_leaders(people, ["r"])):
        assert merged_by_bytes(links) == [] and links.rdd.getNumPartitions() > 4
    links = cluster.cross_links(people, ["r"])
    assert sorted(map(str, links.collect())) == want and max(map(len, links.rdd.glom().collect())) <= 100


def test_persons_of_a_request_do_not_meet_in_a_task(spark, monkeypatch):
    """One name, asked for once: its persons are dealt by cluster, and only the best of each go on."""
    asked = spark.createDataFrame([(1, "", "Maik Lander", []), (2, "", "No One", [])], RESOLVE_REQUEST)
    people = settle(same_named(spark, 400))
    found = settle(resolve.candidates(asked, people))
    want = [r.asDict() for r in resolve.facts_in_rows(found).collect()]
    monkeypatch.setattr(work, "ROWS_A_TASK", 50)
    written = []
    monkeypatch.setattr(resolve, "settle", lambda df: written.append(df) or settle(df))
    facts = resolve.facts_by_joins(found)
    assert "Window" not in plan_of(facts) and all(merged_by_bytes(df) == [] for df in written) and written
    # what is left to Spark's own shuffles has a row a request and part
    assert all("request_id" in x.split("hashpartitioning(")[1].split(",")[0] and "source" not in x.split("hashpartitioning(")[1].split(")")[0] for x in merged_by_bytes(facts))
    assert [r.asDict() for r in facts.collect()] == want
    assert "Broadcast" in plan_of(resolve.candidates(asked, people)) and [r["status"] for r in resolve.resolve(asked, people, folded=9).orderBy("request_id").collect()] == ["ambiguous", "not_found"]


def asked_and_records(spark, index, kind, probes):
    column, value = ("last_prefix", "lan") if kind == "prefix" else ("last_suffix", "ander")
    asked = spark.range(probes).select(F.col("id").alias("request_id"), F.expr("left('mai', int(2 + id % 2))").alias("first_prefix"), F.expr(f"left('{value}', int({len(value) - 1} + id % 2))").alias(column))
    return asked, getattr(index, f"records_by_{kind}")(asked, ["record_key", "email"])


def probes_are_dealt(spark, tmp_path, monkeypatch, kind):
    """Copies of probes are dealt in parts by rows; Spark takes them for one copy, which it would send to all tasks."""
    index = PersonIndex.write(table(spark, [(d if i % 2 else h)(str(i), "Maik", "Lander", email=f"p{i}@x.example") for i in range(50)]), f"file://{tmp_path}/x", buckets=2, spread=2)
    monkeypatch.setattr(work, "ROWS_A_TASK", 500)
    asked, got = asked_and_records(spark, index, kind, 200)
    joins = [x for x in plan_of(got).splitlines() if "Join" in x and "__dealt" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    assert not any("__dealt" in x for x in merged_by_bytes(got)) and got.rdd.getNumPartitions() > 4
    whole = "lan" if kind == "prefix" else "ander"
    want = [(i, "mai"[: 2 + i % 2], whole[: len(whole) - 1 + i % 2], f"{'directory' if n % 2 else 'helpdesk'}:{n}") for i in range(200) for n in range(50)]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    monkeypatch.setattr(person_index, "FEW", 1)  # so many different pairs that they aren't sent to all either
    many = asked_and_records(spark, index, kind, 200)[1]
    assert "Broadcast" not in plan_of(many) and many.count() == len(want)
    index.close(spark)


def test_probes_of_prefixes_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    probes_are_dealt(spark, tmp_path, monkeypatch, "prefix")


def test_probes_of_suffixes_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    probes_are_dealt(spark, tmp_path, monkeypatch, "suffix")


def test_an_index_of_many_persons_has_more_buckets(spark, monkeypatch):
    people = settle(same_named(spark, 400))
    assert queries._index(spark, "", people).buckets == 8
    monkeypatch.setattr(work, "ROWS_A_TASK", 40)
    assert queries._index(spark, "", people).buckets == 10
