"""License scan against plain Python for the base phrases, and cases for the rules."""

import pathlib
import re

import duckdb
import pytest

from weftwise.llm.license_scan import rules, scan_licenses
from weftwise.llm.oracle import ORACLE

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORD.findall((text or "").translate(LOW))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


CASES = {
    None: "", "": "", "no label here": "", "CC BY": "cc-by", "cc-by cc by, CC_BY; ccby": "cc-by", "All rights reserved. All Rights\nReserved": "reserved",
    "GNU General Public License": "gpl", "the general public license, all rights reserved cc by": "cc-by,gpl,reserved", "ALL RİGHTS RESERVED": "", "licenſe general public licenſe": "",
    "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "gpl,gpl-2.0-or-later",
    "CC BY-SA 4.0": "cc-by,cc-by-sa-4.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "cc cc by by cc by": "cc-by", "a " * 3000 + "cc by" + " z" * 3000: "cc-by",
}


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    for i, (t, labels) in enumerate(CASES.items()):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert r["_labels"] == labels and r["labels"] == "x", (t, r["_labels"])
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)


def test_hundreds_of_rules_with_a_gate_each():
    made = rules()
    assert len(made) > 300
    assert all(gate.isalnum() and after.startswith(gate) for _, _, _, gate, _, after in made)


def test_odd_rows_and_ties(spark):
    """Null ids and repeated rows come out alike; of equal intervals and priorities the first rule stays."""
    text = "SPDX-License-Identifier: MIT. Licensed under the MIT license."
    df = spark.createDataFrame([(None, text), (None, text), (3, text), (4, "MIT License"), (5, "mit license " * 3000)], "doc_id long, text string").repartition(3)
    got = scan_licenses(df).collect()
    assert len({str(tuple(r)[2:]) for r in got if r["text"] == text}) == 1 and len(got) == 5
    one = next(r for r in got if r["doc_id"] == 4)
    assert one["labels"] == "mit" and len(one["detections"]) == 1
    long_ = next(r for r in got if r["doc_id"] == 5)
    # "mit license" and, across them, "license mit"
    assert long_["labels"] == "mit" and len(long_["detections"]) == 3000 + 2999


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_against_sql(spark):
    db = duckdb.connect()
    db.sql("create view documents as select doc_id, text from '/root/testdata/sf0.001/documents.parquet' union all select 9000 + n, t from (values (0, 'Apache License, Version 2.0'), (1, 'GNU GPL v3 or the Apache License'), (2, null), (3, '')) x(n, t)")
    got = scan_licenses(spark.createDataFrame(db.sql("select doc_id, text from documents").fetchall(), "doc_id long, text string"))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = db.sql(ORACLE["op3_license_scan"]).select(*names).fetchall()
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want) and sum(r[6] != "" for r in want) > 5


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
