"""Resolving, matching, graph steps, attributes and the stream wrapper on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftwise.operators import attributes, cluster, graph
from weftwise.operators.components import connected_components
from weftwise.operators.nodes import NodeStore
from weftwise.plans.match import candidates, match_status, requests_of, responses
from weftwise.plans.resolve import candidates as resolve_candidates
from weftwise.plans.resolve import resolve, with_account
from weftwise.sources.model import MATCH_REQUEST, PERSON, RESOLVE_REQUEST, in_scope, ingest, with_keys
from weftwise.sources.settings import Settings
from weftwise.streaming import serve

FIELDS = [c.split()[0] for c in PERSON.split(", ")]


def person(id_, source="directory", **values):
    base = {"id": id_, "source": source, "is_deleted": False} | ({"org_code": "DG", "status": "ACTIVE"} if source == "helpdesk" else {})
    return tuple((base | values).get(c) for c in FIELDS)


def table(spark, rows):
    return with_keys(in_scope(ingest(spark.createDataFrame(rows, PERSON))))


def d(id_, first="Maik", last="Lander", **v):
    return person(id_, first_name=first, last_name=last, **v)


def h(id_, first="Maik", last="Lander", **v):
    return person(id_, "helpdesk", first_name=first, last_name=last, **v)


def test_components(spark):
    cases = {"none": ("abc", []), "all": ("abc", ["ab", "bc", "ac"]), "chain": ("abcdefgh", ["ab", "bc", "cd", "de", "ef", "fg", "gh"]), "two": ("abcd", ["ab", "cd"])}
    want = {"none": "abc", "all": "aaa", "chain": "a" * 8, "two": "aacc"}
    for name, (nodes, links) in cases.items():
        got = connected_components(spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame([tuple(x) for x in links], "a string, b string")).collect()
        assert "".join(x["label"] for x in sorted(got)) == want[name]


@pytest.mark.parametrize(
    "rows, exclude, n",
    [
        ([h("1", email="a@x", phone_no="0"), h("2", email="A@x", phone_no="0")], False, 1),
        ([h("1", email="a@x", phone_no="+1"), h("2", email="b@x", phone_no="+1")], False, 1),
        ([h("1", email="a@x", phone_no="0"), h("2", email="b@x", phone_no="0")], False, 2),
        ([h("1", email="a@x", phone_no="+1"), h("2", email="b@x", phone_no="+1")], True, 2),
        ([d("1", mobile_phone="+1"), d("2", office_phone="+1")], False, 1),
    ],
)
def test_clusters(spark, rows, exclude, n):
    assert cluster.clusters(table(spark, rows).withColumn("r", F.lit(1)), ["r"], exclude_phone=exclude).select("cluster").distinct().count() == n


def test_representative(spark):
    def best(rows):
        return cluster.representatives(table(spark, rows).withColumn("g", F.lit(1)), ["g"]).first()["id"]

    assert best([d("1", email="a@x", office_phone="1"), d("2", xid="X")]) == "2"
    assert best([d("1"), d("2", email="a@x")]) == "2"
    assert best([d("2"), d("1")]) == "1"


RESOLVE = [
    # persons, phone, name, domains, status, directory, helpdesk
    ([d("1", email="a@x", office_phone="+1"), h("2", email="A@X", phone_no="+2", office_phone="+1")], "+1", "", [], "ok", "1", "2"),
    ([h("2", phone_no="+1")], "+1", "", [], "ok", None, "2"),
    ([d("1", other_phone="+1")], "+1", "", [], "ok", "1", None),
    ([d("1")], "+9", "", [], "not_found", None, None),
    ([d("1", email="a@x", office_phone="+1"), d("2", email="b@x", office_phone="+1")], "+1", "", [], "ambiguous", None, None),
    ([d("1", email="a@x", office_phone="+1"), h("2", email="b@x", phone_no="+1")], "+1", "", [], "ambiguous", None, None),
    ([d("1", office_phone="+1"), h("2", phone_no="+1")], "+1", "", [], "ok", "1", "2"),
    ([d("1", office_phone="+1"), h("2", phone_no="+2")], "", "maik LANDER", [], "ambiguous", None, None),
    ([d("1"), h("2")], "", "Maik Lander", [], "ok", "1", "2"),
    ([d("1", office_phone="+1"), h("2", phone_no="0")], "", "Maik Lander", [], "ambiguous", None, None),
    ([d("1", email="a@x"), d("3", email="A@x", xid="X3")], "", "Maik Lander", [], "ok", "3", None),
    ([d("1", email="a@x"), d("2", email="b@x"), d("3", email="b@x")], "", "Maik Lander", [], "ambiguous", None, None),
    ([d("1", email="a@x"), d("3", email="a@x", office_phone="+5", xid="X"), h("2", phone_no="+5", email="")], "", "Maik Lander", [], "ok", "3", "2"),
    ([d("1", email="a@x"), d("2", email="b@y")], "", "Maik Lander", ["x"], "ok", "1", None),
    ([d("1", email="a@x"), d("2", email="b@y")], "", "Maik Lander", ["x", "y"], "ambiguous", None, None),
    ([d("1", email="a@x")], "", "Maik Lander", ["z"], "not_found", None, None),
    ([d("1", email="a@x", is_deleted=True)], "", "Maik Lander", [], "not_found", None, None),
    ([h("1", status="INACTIVE")], "", "Maik Lander", [], "not_found", None, None),
    ([d("1")], "", " ", [], "bad_request", None, None),
    ([d("1")], "+1", "Maik Lander", [], "bad_request", None, None),
]


def test_resolve(spark):
    # every case's persons get a domain of their own requests by living in their own name space
    rows, requests = [], []
    for i, (persons, phone, name, domains, *_) in enumerate(RESOLVE):
        for p in persons:
            p = dict(zip(FIELDS, p, strict=True))
            p["id"] = f"{i:02}-{p['id']}"
            for c in ("office_phone", "mobile_phone", "other_phone", "phone_no"):
                if p[c] and p[c] != "0":
                    p[c] = f"{p[c]}/{i}"
            p["last_name"] += f"{i}"
            rows.append(tuple(p[c] for c in FIELDS))
        requests.append((i, f"{phone}/{i}" if phone else phone, f"{name}{i}" if name.strip() else name, domains))
    got = {r["request_id"]: r for r in resolve(spark.createDataFrame(requests, RESOLVE_REQUEST), table(spark, rows)).collect()}
    for i, (*_, status, one, two) in enumerate(RESOLVE):
        full = lambda x: x and f"{i:02}-{x}"  # noqa: B023, E731
        assert (got[i]["status"], got[i]["directory_id"], got[i]["helpdesk_id"]) == (status, full(one), full(two)), (i, got[i])
    assert got[10]["directory_xid"] == "X3" and got[1]["helpdesk_xid"] == "01-2" and got[0]["display_name"] == "Maik Lander0"


def heard(first, last, reps=("raw",)):
    return [{r: x for r in reps} for x in (first, last)]


def stt(values):
    return tuple(values.get(k) for k in ("raw", "nlp", "tagged", "slotted", "structured"))


MATCH = [
    # persons, first, last, renderings, hint
    ([d("1")], "Maik", "Lander", ("raw", "nlp"), None), ([d("1")], "M", "L", ("raw",), None), ([d("1"), d("2", "Max", "Lehmann")], "M", "L", ("raw",), None), ([d("1"), d("2", "Max", "Lehmann")], "M", "L", ("raw",), "Land"),
    ([d("1", email="a@", xid="DX"), h("2", email="A@")], "Maik", "Lander", ("raw",), None), ([d("1")], "Mike", "Lander", ("raw",), None), ([d("1", "Thomas", "Sellner")], "Thomas", "Fellner", ("raw",), None),
    ([d(str(i), "Maik", f"L{'abcdefg'[i]}") for i in range(7)], "M", "L", ("raw",), None), ([d("1")], "Zoe", "Quist", ("raw",), None),
]


def test_match(spark):
    # each case's persons are kept to its request by an e-mail domain of their own
    rows, requests = [], []
    for i, (persons, first, last, reps, hint) in enumerate(MATCH):
        for p in persons:
            p = dict(zip(FIELDS, p, strict=True))
            p["email"] = f"{p['email'] or p['id'] + '@'}case{i}"
            p["id"] = f"{i}-{p['id']}"
            rows.append(tuple(p[c] for c in FIELDS))
        f, x = heard(first, last, reps)
        requests.append((i, stt(f), stt(x), [f"case{i}"], hint))
    got = {i: [] for i in range(len(MATCH))}
    for r in candidates(spark.createDataFrame(requests, MATCH_REQUEST), table(spark, rows)).orderBy("request_id", "nth").collect():
        got[r["request_id"]].append(r)
    points = lambda r: (r["stage_points"], r["representation_points"], r["uniqueness_points"], r["confidence"])
    assert points(got[0][0]) == (50, 30, 20, 100) and points(got[1][0]) == (10, 30, 20, 60)
    assert [points(r)[::2] for r in got[2]] == [(10, 10), (10, 10)]
    assert got[3][0]["last_name"] == "Lander" and points(got[3][0]) == (20, 30, 10, 60)
    assert [(r["directory_xid"], r["helpdesk_xid"]) for r in got[4]] == [("DX", "4-2")]
    assert got[5][0]["stage_points"] == 47 and got[6][0]["stage_points"] == 45 and len(got[7]) == 5 and got[8] == []


def test_match_status(spark):
    rows = [(1, stt({"raw": "M", "nlp": "M"}), stt({"raw": "L"}), [], None), (2, stt({"raw": "M"}), stt({"nlp": "L"}), [], None)]
    assert {tuple(r) for r in match_status(spark.createDataFrame(rows, MATCH_REQUEST)).collect()} == {(1, "ok"), (2, "bad_request")}


def test_graph(spark):
    edges = spark.createDataFrame([("t1", "affects", "p"), ("t1", "assignedTo", "p"), ("p", "opens", "t2"), ("t3", "relates", "p"), ("t9", "affects", "p"), ("a1", "connects", "p"), ("a2", "connects", "p"), ("a3", "connects", "q")], "out_id string, verb string, in_id string")
    cols = ["id", "xid", "ext_id", "ticket_id", "description", "clean_description"]
    tickets = spark.createDataFrame([("t1", "X1", "E1", "T1", "raw", "clean"), ("t2", "", "T1", "", "raw", ""), ("t3", "", "", "", "", "")], ", ".join(f"{c} string" for c in cols))
    people = spark.createDataFrame([("p",), ("q",)], "person_id string")
    got = {r["ticket_node"]: (r["xid"], r["description"]) for r in graph.person_tickets(people, edges, tickets).collect()}
    assert got == {"t1": ("X1", "clean"), "t2": ("t2", "raw")}
    assert [tuple(r) for r in graph.dangling_edges(edges, tickets).select("person_id", "ticket_node").collect()] == [("p", "t9")]
    asked = spark.createDataFrame([(1, "T1", "p"), (2, "t3", "p"), (3, "none", "p")], "request_id long, key string, person_id string")
    assert {(r["request_id"], r["id"]) for r in graph.ticket_by_any_id(asked, tickets).collect()} == {(1, "t2"), (2, "t3")}
    assert {r["request_id"] for r in graph.owned_tickets(asked, edges, tickets).collect()} == {1}
    accounts = spark.createDataFrame([("a1", "", "foreign", "x"), ("a2", "AX", "directory", "on"), ("a3", "", "foreign", "x")], "id string, xid string, source string, status string")
    assert {tuple(r) for r in graph.person_account(people, edges, accounts).collect()} == {("p", "a2", "AX", "on"), ("q", None, None, None)}


def test_attributes(spark, tmp_path):
    cases = [(" /a , /b", "true, x, y", {"/a": "true", "/b": "x"}), ("/a, /b", "1", {"/a": "1", "/b": ""}), ("/a,,/b", "1,2,3", {"/a": "1", "/b": "2"}), ("", "", {}), ("/a,/a", "1,2", {"/a": "2"})]
    rows = [({attributes.NAMES: n, attributes.VALUES: v},) for n, v, _ in cases]
    got = spark.createDataFrame(rows, "attrs map<string,string>").select(attributes.system_variables(F.col("attrs")).alias("m")).collect()
    assert [r["m"] for r in got] == [c[2] for c in cases]
    issue = spark.createDataFrame([({"/a": "sys", "/b": "sys", "ogit/scope": "s"}, {"/b": "user", "/subject": " sub "}, None, "n1", "sc")], "system map<string,string>, user map<string,string>, subject string, origin string, scope string")
    made = attributes.issue_attributes(issue)
    assert made.first()["attrs"] == {"/a": "sys", "/b": "user", "/subject": " sub ", "ogit/subject": "sub", "ogit/Automation/originNode": "n1", "ogit/scope": "sc"}
    store = NodeStore(spark, f"file://{tmp_path}/nodes")
    written = store.write(made, "ogit/Automation/AutomationIssue")
    assert json.loads(written.first()["payload"])["ogit/_type"] == "ogit/Automation/AutomationIssue" and written.count() == 1
    # a rerun adds nothing
    store.write(made, "ogit/Automation/AutomationIssue")
    store.write(made.withColumn("attrs", F.create_map(F.lit("/x"), F.lit("1"))), "ogit/Automation/AutomationIssue")
    assert store.read().select("id").distinct().count() == store.read().count() == 2


def test_nodes_by_id(spark):
    stored = spark.createDataFrame([("1", '{"ogit/status":"OPEN","/n":5,"/list":[1,2]}', False), ("2", "{}", True), ("3", "no json", None)], "id string, payload string, is_deleted boolean")
    asked = spark.createDataFrame([(i, str(i)) for i in (1, 2, 3, 4)], "request_id int, id string")
    got = {r["request_id"]: (r["status"], r["variables"]) for r in attributes.issue_variables(asked, stored).collect()}
    assert got == {1: ("ok", {"ogit/status": "OPEN", "/n": "5", "/list": "[1,2]"}), 2: ("not_found", None), 3: ("ok", None), 4: ("not_found", None)}
    intents = spark.createDataFrame([("a", {attributes.TYPE: "A"}), ("b", {attributes.TYPE: "B"}), ("b", {attributes.TYPE: "B"}), ("c", {})], "id string, attrs map<string,string>")
    lists = spark.createDataFrame([(1, " A ,, b"), (2, ""), (3, None), (4, "A,A,B")], "request_id int, types string")
    found = sorted((r["request_id"], r["id"]) for r in attributes.intents_for(lists, intents).collect())
    assert found == [(1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b"), (3, "c"), (4, "a"), (4, "b")]


def test_links_across_sources_are_those_of_the_cascade(spark):
    """Every combination of what records have, against the cascade over all pairs."""
    mails, phones, names = ("", "a@x", "A@X", "b@x"), ("", "0", "+1", "+2"), (("Maik", "Lander"), ("MAIK", "lander"), ("", ""), ("Ida", "Lander"))
    rows, k = [], 0
    for mail in mails:
        for phone in phones:
            for first, last in names:
                k += 1
                rows.append(d(f"d{k}", first, last, email=mail, office_phone=phone, other_phone="+2" if k % 7 == 0 else ""))
                rows.append(h(f"h{k}", first, last, email=mail, phone_no=phone, office_phone="+1"))
    people = table(spark, rows).withColumn("r", F.lit(1)).cache()
    one, two = (people.filter(F.col("source") == s).alias(a) for s, a in (("directory", "d"), ("helpdesk", "h")))
    pairs = one.join(two, cluster.same_person("d", "h")).select("d.record_key", F.col("h.record_key").alias("other")).collect()
    want = {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            want.setdefault(x, []).append(y)
    got = {r["record_key"]: (r["other_key"], r["others"]) for r in cluster.cross_links(people, ["r"]).collect()}
    assert got == {x: (min(ys), len(ys)) for x, ys in want.items()} and len(pairs) > 500


def closure(nodes, links):
    label = {x: x for x in nodes}
    for a, b in links:
        a, b = sorted((label[a], label[b]))
        label = {x: a if y == b else y for x, y in label.items()}
    return label


@pytest.mark.parametrize("seed", range(3))
def test_clusters_across_sources_are_those_of_all_pairs(spark, seed):
    """Records that are linked by several keys at once to different records: nothing falls apart."""
    rng = random.Random(seed)
    one = lambda kind, i: kind(str(i), rng.choice(["Maik", "Ida", "Jan", "Kai"]), rng.choice(["Lander", "Weber", "Voss"]), email=rng.choice(["", "", "a@x", "b@x", "c@x"]))
    rows = []
    for i in range(70):
        p = dict(zip(FIELDS, one(d if i % 3 else h, i), strict=True))
        for c in ("office_phone", "mobile_phone") if i % 3 else ("phone_no",):
            p[c] = rng.choice(["", "", "0", f"+{rng.randrange(12)}"])
        rows.append(tuple(p[c] for c in FIELDS))
    people = table(spark, rows).withColumn("r", F.lit(1)).cache()
    x, y = (people.filter(F.col("source") == s).alias(a) for s, a in (("directory", "d"), ("helpdesk", "h")))
    links = [tuple(r) for r in x.join(y, cluster.same_person("d", "h")).select("d.record_key", F.col("h.record_key").alias("other")).collect()]
    keyed = people.select("record_key", "source", F.explode(cluster.link_keys()).alias("k")).collect()
    links += [(a["record_key"], b["record_key"]) for a in keyed for b in keyed if a["source"] == b["source"] and a["k"] == b["k"]]
    got = {r["record_key"]: r["cluster"] for r in cluster.clusters(people, ["r"], across=True).collect()}
    assert got == closure(list(got), links)


def test_account_and_limit(spark):
    people = table(spark, [d("1", office_phone="+1"), d("2", office_phone="+1"), h("3", phone_no="+1"), d("4", office_phone="+4")])
    asked = spark.createDataFrame([(1, "+1", "", []), (2, "+4", "", []), (3, "+9", "", [])], RESOLVE_REQUEST)
    assert sorted((r["request_id"], r["record_key"]) for r in resolve_candidates(asked, people, 1).select("request_id", "record_key").collect()) == [(1, "directory:1"), (1, "helpdesk:3"), (2, "directory:4")]
    edges = spark.createDataFrame([("a1", "connects", "4")], "out_id string, verb string, in_id string")
    accounts = spark.createDataFrame([("a1", "AX", "directory", "ENABLED")], "id string, xid string, source string, status string")
    got = {r["request_id"]: (r["status"], r["account_xid"], r["account_status"]) for r in with_account(resolve(asked, people), edges, accounts).collect()}
    assert got == {1: ("ambiguous", None, None), 2: ("ok", "AX", "ENABLED"), 3: ("not_found", None, None)}


def test_json_requests_and_responses(spark):
    body = {"request_id": 1, "first": {"raw": "Maik", "type": "x"}, "last": {"raw": "Lander", "confidence": 0.3}, "domains": [], "last_name_hint": "", "language": "de"}
    requests = requests_of(spark.createDataFrame([(json.dumps(body),), (json.dumps({"request_id": 2}),), (json.dumps(body | {"request_id": 3, "first": {"raw": "Zoe"}}),)], "body string"))
    assert requests.columns == ["request_id", "first", "last", "domains", "last_name_hint"]
    found = {r["request_id"]: (r["status"], r["body"]) for r in responses(requests, candidates(requests, table(spark, [d("1")]))).collect()}
    assert found[2] == ("bad_request", None) and found[3] == ("ok", "[]") and [x["confidence"] for x in json.loads(found[1][1])] == [100]


def test_settings(spark):
    assert Settings.of(spark, {}) == Settings(Settings.of(spark, {}).checkpoint_dir) and Settings.of(spark, {}).limit is None
    assert Settings.of(spark, {"WEFTWISE_LOOKUP_LIMIT": "20", "WEFTWISE_ORG_CODE": "XX"}).limit == 20
    spark.conf.set("spark.weftwise.org_code", "YY")
    try:
        assert Settings.of(spark, {"WEFTWISE_ORG_CODE": "XX"}).org_code == "YY"
    finally:
        spark.conf.unset("spark.weftwise.org_code")


def test_stream(spark, tmp_path):
    rows = [(1, "+1", "", []), (2, "", "Maik Lander", [])]
    spark.createDataFrame(rows, RESOLVE_REQUEST).write.parquet(str(tmp_path / "in"))
    people = table(spark, [d("1", office_phone="+1")])
    stream = spark.readStream.schema(RESOLVE_REQUEST).parquet(str(tmp_path / "in"))
    serve(stream, lambda r: resolve(r, people), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r["request_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "ok"), (2, "ok")}
