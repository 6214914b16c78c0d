"""Closure within requests: the fold in one row against the joins, and scoring by bounds against scoring all."""

import random

import pytest
from pyspark.sql import functions as F
from test_plans import FIELDS, d, h, table

from weftwise.functions import similarity as S
from weftwise.operators import cluster
from weftwise.operators.components import split_by_size
from weftwise.plans import match
from weftwise.plans.resolve import resolve
from weftwise.sources.model import MATCH_REQUEST, RESOLVE_REQUEST


def people_of(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = d if i % 3 else h
        p = dict(zip(FIELDS, kind(str(i), rng.choice(["Maik", "Ida", "Jan", "maik"]), rng.choice(["Lander", "Weber", "lander"]), email=rng.choice(["", "", "a@x", "A@X", "b@x", "c@x"])), strict=True))
        for c in ("office_phone", "mobile_phone") if i % 3 else ("phone_no",):
            p[c] = rng.choice(["", "", "0", f"+{rng.randrange(25)}"])
        rows.append(tuple(p[c] for c in FIELDS))
    return rows


def parts(rows, *by):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[c] for c in by[:-1]), {})[r[by[-1]]] = r["cluster"]
    return out


@pytest.mark.parametrize("across", [False, True])
def test_fold_equals_joins(spark, across):
    """Requests of 1 to 60 records (one with a null id): all folded, all joined, or split at 20, it is the same."""
    rng, people = random.Random(1), table(spark, people_of(0))
    sizes = {1: 1, 2: 2, 3: 20, 4: 21, 5: 60, None: 9}
    asked = [(q, f"{'directory' if i % 3 else 'helpdesk'}:{i}") for q, n in sizes.items() for i in rng.sample(range(90), n)]
    rows = spark.createDataFrame(asked, "request_id int, record_key string").join(people, "record_key").filter("request_id is not null" if across else "true").cache()
    got = [parts(cluster.clusters(rows.filter("request_id is not null") if n == 0 else rows, ["request_id"], across=across, folded=n).collect(), "request_id", "record_key") for n in (256, 20, 0)]
    assert {k: v for k, v in got[0].items() if k[0] is not None} == {k: v for k, v in got[1].items() if k[0] is not None} == got[2]
    assert sum(map(len, got[0].values())) == rows.count() and any(len(set(v.values())) < len(v) for v in got[0].values())


def test_split_by_size(spark):
    rows = spark.createDataFrame([(q, i) for q, n in ((1, 3), (None, 4), (2, 5)) for i in range(n)], "q int, i int")
    few, many = split_by_size(rows, ["q"], 3)
    assert {r["q"] for r in few.collect()} == {1} and {r["q"] for r in many.collect()} == {None, 2}
    assert split_by_size(rows, ["q"], 5)[1] is None and split_by_size(rows, ["q"], 2)[0] is None
    few, many = split_by_size(rows.limit(0), ["q"], 3)
    assert few.count() == 0 and many is None


def test_resolve_in_rows_equals_by_joins(spark):
    people = table(spark, people_of(4))
    asked = [(i, f"+{i}", "", ["x"] if i % 5 == 4 else []) for i in range(25)] + [(100 + i, "", n, []) for i, n in enumerate(["Maik Lander", "ida weber", "Jan Lander", "No One", "", "Jan Weber"])] + [(200, "+1", "Jan Weber", []), (201, None, None, None)]
    requests = spark.createDataFrame(asked, RESOLVE_REQUEST)
    got = [sorted(map(str, resolve(requests, people, folded=n).collect())) for n in (256, 2, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(asked)
    assert {r["status"] for r in resolve(requests, people).collect()} == {"ok", "ambiguous", "not_found", "bad_request"}


def test_renderings_are_merged_alike(spark):
    rng = random.Random(3)
    rows = [(q, rep, f"c{rng.randrange(8)}", f"r{rng.randrange(25)}", 1) for q in range(6) for rep in ("raw", "nlp", "tagged") for _ in range(3 + 4 * q)]
    groups = spark.createDataFrame(rows, "request_id int, rep string, cluster string, record_key string, stage_points int").distinct().cache()

    def partition(n):
        out = {}
        for r in match.merged_renderings(groups, n).collect():
            out.setdefault((r["request_id"], r["label"]), set()).add((r["rep"], r["cluster"], r["record_key"]))
        return sorted((q, sorted(x)) for (q, _), x in out.items())

    assert partition(256) == partition(15) == partition(0)


def heard_of(spark, names, hint=""):
    person = table(spark, [d(str(i), f, x) for i, (f, x) in enumerate(names)])
    one = lambda t: (t, None, None, None, None)
    asked = spark.createDataFrame([(1, one("Maik"), one("Lander"), [], hint), (2, one("Ma"), one("La"), [], "")], MATCH_REQUEST)
    reps = match.representations(asked)
    return asked, reps, person


def test_bounds_hold_and_lose_nothing(spark):
    """Only groups that may be among the best are scored; the best are those of scoring all, ties included."""
    rng = random.Random(8)
    ends = ["er", "es", "ermann", "ergrenstein-hohenau", "", "au", "ler", "ner"]
    names = list({(f"Mai{rng.choice(['k', 'ke', 'kolauskowitz', ''])}", f"Lan{rng.choice('dtgk')}{rng.choice(ends)}{i if i % 4 == 0 else ''}") for i in range(160)})
    for hint in ("", "Lang"):
        asked, reps, person = heard_of(spark, names, hint)
        _, heard = match.heard_groups(asked, reps, person)
        exact = heard.withColumn("stage_points", match._points())
        assert exact.filter("stage_points > most_points").isEmpty()
        want = match.kept_groups(match.scored_groups(asked, reps, person)).select("request_id", "rep", "cluster", "record_key", "stage_points")
        got = match.best_groups(asked, reps, person).select("request_id", "rep", "cluster", "record_key", "stage_points")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        report = match.scoring_report(heard).collect()
        assert sum(r["scored"] for r in report) < sum(r["groups"] for r in report) and all(min(15, r["groups"]) <= r["scored"] for r in report)


def test_few_groups_are_all_scored(spark):
    asked, reps, person = heard_of(spark, [("Maik", "Lander"), ("Maike", "Lande"), ("", "")])
    _, heard = match.heard_groups(asked, reps, person)
    assert all(r["scored"] == r["groups"] for r in match.scoring_report(heard).collect())


def test_ratio_bound(spark):
    words = ["", "a", "ab", "lander", "landers", "xyz", "aaaaaaaaaaaa"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert pairs.filter(S.fuzzy_ratio(a, b) > S.ratio_bound(a, b)).isEmpty()
