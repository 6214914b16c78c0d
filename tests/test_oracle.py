"""Queries against their SQL in DuckDB, on the smallest data."""

import glob
import pathlib

import duckdb
import pytest

from weftwise.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
#: The rest run in the driver's comparison; these cover each family in little time.
CHECKED = ["normalize_words", "koelner_words", "match_quality_pairs", "lookup_phone_directory", "lookup_prefix_helpdesk", "lookup_suffix", "link_pairs_cross", "clusters_mixed", "resolve_by_phone", "match_candidates", "person_tickets", "person_account", "issue_payload_json", "issue_variables", "intents_by_type_lists", "auth_response", "match_responses", "lookup_limit", "sql_functions_words", "alias_probe_first", "match_scored_counts", "lookup_index_prefix", "traverse_three_steps", "clusters_after_batches", "issues_written_and_read", "issues_followed", "lookup_other_settings"]


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", CHECKED)
def test_equal(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"create view {pathlib.Path(f).stem} as select * from '{f}'")
    got = QUERIES[name](spark, DATA)
    want = db.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))
