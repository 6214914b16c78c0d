"""One table of nodes: fields by path, and what is rejected."""

import pytest

from weftwise.sources.nodes import as_nodes, field, typed, union

ROWS = [
    ("1", '{"a/b": "x", "n": 5, "d": "2024-01-02"}'), ("2", '{"a/b": 7, "n": "12"}'), ("3", '{"a/b": {"deep": 1}, "n": 1}'), ("4", '{"n": "many", "a/b": null}'), ("5", "[1]"), ("6", "oops"), ("7", None),
    ("8", '{"a/b": "x", "n": 5, "d": "no day", "more": [1, 2]}'), ("1", '{"a/b": "x", "n": 5, "d": "2024-01-02"}'), ("9", "{}"), (None, '{"a/b": "y"}'),
]


def test_fields_and_rejects(spark):
    rows = spark.createDataFrame(ROWS, "id string, body string")
    nodes = union([as_nodes(rows, "T", json=rows["body"]), as_nodes(spark.createDataFrame([("z", 1)], "id string, n int"), "U")])
    good, bad = typed(nodes, "T", "id string, a/b string, n int, d date", ("a/b",))
    found = [(r["id"], r["a/b"], r["n"], str(r["d"])) for r in good.collect()]
    assert sorted(found, key=str) == sorted([("1", "x", 5, "2024-01-02"), ("1", "x", 5, "2024-01-02"), ("2", "7", 12, "None"), (None, "y", None, "None")], key=str)
    assert {r["id"]: r["reason"] for r in bad.collect()} == {
        "3": "a/b is no string", "4": "a/b is missing; n is no int", "5": "no object", "6": "no object", "7": "no object", "8": "d is no date", "9": "a/b is missing",
    }
    assert typed(nodes, "U", "n int")[0].collect()[0]["n"] == 1 and typed(nodes, "V", "n int")[0].count() == 0


def test_nodes_are_written_and_read(spark, tmp_path):
    as_nodes(spark.createDataFrame([("1", "x", None)], "id string, name string, none string"), "T").write.parquet(str(tmp_path / "n"))
    nodes = spark.read.parquet(str(tmp_path / "n"))
    good, bad = typed(nodes, "T", "name string, none string")
    assert [tuple(r) for r in good.collect()] == [("1", "x", None)] and bad.count() == 0
    assert typed(nodes, "T", "none string", ("none",))[1].first()["reason"] == "none is missing"
    assert typed(nodes.limit(0), "T", "name string")[0].count() == 0


def test_odd_names():
    with pytest.raises(ValueError):
        field('a"b', "string")
