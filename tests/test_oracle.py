"""Queries against their SQL on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from dqspark import queries

SF = "/root/testdata/sf0.001"
NAMES = ["rule_counts", "rule_examples", "rule_rollup", "severity_rows", "normalize_text", "country_alias", "column_profile", "infer_dtype", "numeric_summary", "corr_long", "constraint_violations", "clean_pipeline", "quality_score", "drift_measures", "drift_shares", "lof_scores", "inject_anomalies", "roc_auc", "classify_columns", "tfidf_terms"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    r = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, r.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20


def test_sql_names_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
