"""Registered queries against their SQL on the smallest tables, and the shape of the plans.

Queries that share their whole computation with another one are left to the driver's check.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from topicflow.plans.oracle import ORACLE_SQL
from topicflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def rounded(row):
    return tuple(round(v, 5) if isinstance(v, float) else v for v in row)


COVERED_BY_OTHERS = {
    "chart_centrality", "chart_emerging", "chart_topic_trends", "enrichment_counters",
    "missing_fields", "papers_of_year_limited", "question_contexts", "question_contexts_by_year", "term_statistics",
    "topic_centrality", "topic_cooccurrence", "trend_report",
}


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - COVERED_BY_OTHERS))
def test_against_sql(spark, database, name):
    frame = entry.queries()[name](spark, SF)
    relation = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(frame.columns)
    expected = sorted(map(repr, map(rounded, relation.fetchall())))
    assert sorted(map(repr, map(rounded, frame.select(*names).collect()))) == expected


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 40


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize(
    "name", ["topic_trends", "topic_cooccurrence", "top_terms_tfidf", "knn_exact", "summary_coverage", "retrieved_by_question"]
)
def test_plans_have_no_cross_joins(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_retrieval_does_not_shuffle_texts(spark):
    plan = entry.queries()["question_contexts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin [paper_id" in plan


def test_text_columns_are_pruned(spark):
    plan = entry.queries()["papers_per_year"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


@pytest.mark.parametrize("name", ["papers_of_year_limited", "knn_exact", "knn_year_filtered", "knn_many_queries"])
def test_limits_need_no_window(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
