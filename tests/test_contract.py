"""The registered queries against an independent engine, and their plans."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as contract
from varimill.plans import catalog, oracle

SMALL, SF_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES = catalog.queries()
ORACLE = oracle.oracle_sql()
STREAMS = {n for n in QUERIES if n.startswith("stream_")}
# Run jobs, settle letters by a join.
JOINED = {"store_after_replay", "compacted_store", "ingested_twice", "incremental_forecast"} | {n for n in QUERIES if n.startswith("corrected_")}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry_gives_rows(spark):
    df = contract.entry(spark)
    assert df.columns == [
        "symbol", "ts", "rv_daily", "rv_weekly", "rv_monthly", "mamba_pred", "lstm_pred", "har_pred"
    ]
    assert df.count() == 4


def test_every_oracle_has_a_query():
    assert ORACLE.keys() == QUERIES.keys()
    assert QUERIES.keys() <= contract.queries().keys() and ORACLE.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR) is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = sorted(QUERIES.keys() - STREAMS - JOINED - {"parallelism_sweep", "tick_counter"})


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "SortAggregate" not in text


@pytest.mark.parametrize(
    "name, shuffles", [("bars_5m", 1), ("daily_rv", 2), ("rv_features", 3), ("har_predictions", 3),
                       ("model_sequences", 3), ("request_payloads", 3), ("scored_status", 4)]
)
def test_shuffles(spark, name, shuffles):
    text = plan(QUERIES[name](spark, SMALL))
    assert text.count("Exchange hashpartitioning") == shuffles == text.count("Exchange ")
    assert text.count("Join") == 0


def test_day_bound_reaches_the_scan(spark):
    assert "GreaterThanOrEqual(ts,2024-01-05" in plan(QUERIES["ingest_window"](spark, SMALL))


def test_forecasts_stay_in_the_jvm_and_prune_the_scan(spark):
    text = plan(QUERIES["har_predictions"](spark, SMALL))
    assert "Python" not in text and "Arrow" not in text
    assert "GreaterThan(value,0.0)" in text
    bars = plan(QUERIES["bars_5m"](spark, SMALL))
    assert "partial_min_by" in bars and "partial_max_by" in bars
