"""Registered queries against their SQL counterparts on the smallest data, and what plans look like."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from convsignals.plans.catalog import all_oracles, all_queries

SLOW = {"similar_conversations", "benchmark_similarity"}
TABLES = "events documents embeddings pages benchmark labels conversations".split()
CHECKED = [n for n in all_oracles() if n not in SLOW]


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [tuple(round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v for v in (r[i] for i in order)) for r in rows]
    return sorted(flat, key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, db, name):
    df = all_queries()[name](spark, sf)
    expected = db.sql(all_oracles()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert normal(df.columns, df.collect()) == normal(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    "session_outcome_summary",
    "message_sessions",
    "prefix_text",
    "prefix_behavior_features",
    "stratified_split",
    "exact_duplicates",
    "in_conversation_repeats",
    "metrics_by_fraction",
    "turn_violations",
    "nested_violations",
    "phrase_hits",
    "coverage_gaps",
    "unused_combinations",
    "allocated_ids",
    "fuzzy_matches",
    "tfidf_weights",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_global_window(spark, sf, name):
    text = plan(all_queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"windowspecdefinition\(specifiedwindowframe", text)


def test_prefix_features_move_messages_once(spark, sf):
    """Windows run per time block; the final aggregate receives partial rows only."""
    text = plan(all_queries()["prefix_behavior_features"](spark, sf))
    assert len(re.findall(r"Exchange hashpartitioning\(_slot#\d+", text)) >= 1
    final = text.index("Exchange hashpartitioning(conversation_id")
    assert "partial_count" in text[final:]


def test_columns_are_pruned_and_filters_pushed(spark, sf):
    text = plan(all_queries()["session_outcome_summary"](spark, sf))
    assert "value:double" not in text
    assert "props" not in text
