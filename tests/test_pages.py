"""Box and line queries deal pages as text, and neither boxes nor words."""

import re

import pytest

from sulatan.plans import views as V
from sulatan.plans.registry import queries

QUERIES = queries()

ROWS = [(1, "jig fib\n\nlate ijs\n"), (2, "a\tb  c"), (2, "Quick ij\nöé😀 it"), (None, "dig\nit"), (None, "dig it"), (3, None), (4, ""), *[(n, f"line {n}\nij {n * n}") for n in range(5, 40)]]
TALK = [(1, 0, "late dig"), (1, 1, "it jig rig"), (2, 0, None)]
NAMES = ["box_geometry", "otsu_split", "words_by_gap", "words_by_gap_pen", "row_clusters", "dot_owner", "outlier_boxes", "position_fix"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(TALK, "conv_id long, turn int, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture
def shuffled(spark):
    """Joins as on large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, old)


@pytest.mark.parametrize("name", NAMES)
def test_only_texts_are_dealt(spark, tables, shuffled, name):
    df = QUERIES[name](spark, tables)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"doc_id"}


@pytest.mark.parametrize("name", ["resolve_lines", "resolution_status_counts"])
def test_words_stay_with_their_lines(spark, tables, shuffled, name):
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) <= {"doc_id", "status"}


def test_parts_do_not_change_rows(spark, tables, shuffled, monkeypatch):
    def rows(name):
        return sorted(map(repr, QUERIES[name](spark, tables).collect()))

    whole = {name: rows(name) for name in ("box_geometry", "words_by_gap")}
    monkeypatch.setattr(V, "TASK_TEXT", 8)
    assert V.pages(spark, tables).rdd.getNumPartitions() > 40
    assert {name: rows(name) for name in whole} == whole and all(whole.values())
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_letters_of_a_line(spark, tables):
    found = {(r["page_id"], r["line_no"], r["pos"], r["char"]) for r in V.v_char_boxes(spark, tables).where("page_id = 2").collect()}
    want = {(2, i, k, c) for n, text in ROWS if n == 2 for i, line in enumerate(text.split("\n")) for k, c in enumerate(line) if not c.isspace()}
    assert found == want
