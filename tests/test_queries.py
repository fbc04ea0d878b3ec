"""Every registered query against its SQL."""

import datetime
import math
import os

import pytest

from riskstream.plans import streams  # noqa: F401  (registers the streaming queries)
from riskstream.plans.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str, datetime.datetime)):
        return v
    return round(float(v), 6)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    order = sorted(df.columns)
    ours = [tuple(cell(r[c]) for c in order) for r in df.collect()]
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == order
    place = [rel.columns.index(c) for c in order]
    theirs = [tuple(cell(r[i]) for i in place) for r in rel.fetchall()]
    assert sorted(map(str, ours)) == sorted(map(str, theirs))
    assert ours


def test_gbt_scores_are_probabilities(spark):
    rows = QUERIES["gbt_score"](spark, DIR).collect()
    assert rows and all(0 <= r.fraud_probability <= 1 and r.fraud_prediction == (r.fraud_probability >= 0.5) for r in rows)


def test_no_python_in_batch_plans(spark):
    for name in (n for n in QUERIES if n != "gbt_score" and not n.startswith(("boosted_", "stream_"))):
        plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name


def test_scan_is_pruned_and_filtered(spark):
    plan = QUERIES["impossible_travel"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan


@pytest.mark.parametrize("name, shuffles", [("high_value", 1), ("velocity_trailing", 1), ("impossible_travel", 1), ("velocity", 1), ("window_sliding", 1)])
def test_windows_share_a_shuffle(spark, name, shuffles):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == shuffles


@pytest.mark.parametrize("name, most", [("kpis", 2), ("unified_events", 2), ("customer_risk_summary", 2), ("alerts_by_type", 2), ("quality_report", 0)])
def test_silver_is_one_scan_and_one_of_the_labels(spark, name, most):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    # what the report reads was written before
    assert plan.count("/events.parquet") <= most
    assert name == "quality_report" or plan.count("/events.parquet") > 0


def test_streams_keep_no_rows_in_the_driver():
    import inspect

    assert "memory(" not in inspect.getsource(streams)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["gbt_score", "boosted_score"])
def test_training_reads_features_that_were_written_once(spark, monkeypatch, name):
    from riskstream import ml
    from riskstream.ml import trees

    seen = []
    module = ml if name == "gbt_score" else trees
    train = module.train
    monkeypatch.setattr(module, "train", lambda df, *a: seen.append(df._jdf.queryExecution().executedPlan().toString()) or train(df, *a))
    monkeypatch.setattr("riskstream.plans.queries._BOOSTED", trees.Params(trees=1, depth=2))
    assert QUERIES[name](spark, DIR).count()
    # neither events nor windows over them: a scan and a filter
    assert seen and "/events.parquet" not in seen[0] and "Window" not in seen[0] and "Exchange" not in seen[0]
