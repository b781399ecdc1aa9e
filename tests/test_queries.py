"""Every registered query: against its SQL on DuckDB, or for rows where it has none."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import compare, database  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from textdist.registry import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    text, good = compare(spark, duck, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert good, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "value"] and df.count() == 14


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["prdc", "ball_membership", "self_bleu", "distinct_n", "leave_one_out_matches", "in_context_examples", "pr_curve"])
def test_no_row_level_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_sample_is_a_bounded_top_n(spark):
    assert "TakeOrderedAndProject" in plan(spark, "seeded_sample")


@pytest.mark.parametrize("name", ["self_bleu", "distinct_n", "reference_text", "divergence_curve", "entity_facts", "collate_left"])
def test_no_python_in_sql_operators(spark, name):
    text = plan(spark, name)
    assert "MapInArrow" not in text and "Python" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "reference_text")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
