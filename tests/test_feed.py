"""The change feed against a dictionary."""

import random

import pytest
from test_plans import FIELDS, d, h

from weftwise.sources import feed
from weftwise.sources.model import PERSON

CHANGE = PERSON + ", seq long"


def frame(spark, rows):
    return spark.createDataFrame(rows, CHANGE)


def state(kept):
    return {r["record_key"]: (r["email"], r["last_key"], r["domain"], r["seq"]) for r in feed.current(kept).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_against_a_dictionary(spark, seed):
    rng = random.Random(seed)
    want, kept = {}, feed.start(spark.createDataFrame([], PERSON))
    for batch in range(3):
        rows = []
        for _ in range(40):
            p = dict(zip(FIELDS, rng.choice([d, h])(str(rng.randrange(9)), last=rng.choice(["Weber", "Voss"]), email=rng.choice([None, "a@X.org", "b@y.org"])), strict=True))
            p["is_deleted"] = rng.choice([None, False, False, True])
            rows.append((*[p[c] for c in FIELDS], 100 * rng.randrange(1 + batch * 2) + rng.randrange(100) * 1000 + len(rows)))
        for r in rows:
            key, seq = (r[FIELDS.index("source")], r[0]), r[-1]
            if key not in want or seq > want[key][0]:
                want[key] = (seq, r)
        kept = feed.merge(kept, frame(spark, rows)).cache()
        assert kept.count() == len(want)
        live = {f"{s}:{i}": r for (s, i), (_, r) in want.items() if not r[FIELDS.index("is_deleted")]}
        got = state(kept)
        assert {k: (v[0], v[3]) for k, v in got.items()} == {k: (r[FIELDS.index("email")] or "", r[-1]) for k, r in live.items()}
        assert all(v[2] == (v[0].split("@")[1].lower() if v[0] else "") for v in got.values())
        assert state(feed.merge(kept, frame(spark, rows))) == got


def test_delete_and_come_back(spark):
    change = lambda seq, **v: (*d("1", **v), seq)
    kept = feed.start(spark.createDataFrame([d("1", email="a@x"), h("1", email="h@x")], PERSON), 1)
    kept = feed.merge(kept, frame(spark, [change(5, is_deleted=True)]))
    assert set(state(kept)) == {"helpdesk:1"}
    kept = feed.merge(kept, frame(spark, [change(3, email="late@x"), change(None, email="none@x"), (None, *change(9)[1:])]))
    assert set(state(kept)) == {"helpdesk:1"}
    kept = feed.merge(kept, frame(spark, [change(6, email="back@x", last="Neu"), change(6, is_deleted=False, email="back@x", last="Neu"), change(4, email="older@x")]))
    assert state(kept)["directory:1"] == ("back@x", "neu", "x", 6) and state(kept)["helpdesk:1"][3] == 1
    # of two changes with one number a tombstone counts
    assert "directory:1" not in state(feed.merge(kept, frame(spark, [change(7, email="z@x"), change(7, is_deleted=True)])))
    assert state(feed.merge(kept, frame(spark, []))) == state(kept)
