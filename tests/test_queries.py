"""Registered queries against their SQL. SULATAN_ALL_QUERIES=1 runs every one."""

import os

import pytest

from check import compare, duck
from sulatan.plans.registry import oracle_sql, queries

SF_DIR = os.environ.get("SULATAN_SF_DIR", "/root/testdata/sf0.001")
SOME = ["transliterate", "syllable_breakdown", "wordlist_load", "resolve_lines", "words_by_gap", "words_by_gap_refined", "row_clusters", "component_to_band",
        "fit_baseline", "merge_boxes", "ovo_vote", "classification_metrics", "sanitize_detections", "archive_write", "held_steady", "session_log_stream"]
NAMES = sorted(queries()) if os.environ.get("SULATAN_ALL_QUERIES") else SOME


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    ok, message = compare(spark, name, queries()[name], oracle_sql().get(name), SF_DIR, con)
    assert ok, message
