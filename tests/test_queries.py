"""Every query with a SQL twin must return the same rows; the others must run."""

import pytest
from check import connect, rows

from tablewright import workload

workload.load_all()
# covered by the invariant tests, and slow to train
TRAINED = {
    "leaderboard", "leaderboard_regression", "evaluate_holdout", "feature_importance", "stacked_ensemble", "goal_search",
    "bagged_ensemble",
    "mlp", "shap_model", "autopilot_run", "review_steps", "batch_run", "kmeans_auto", "gmm_auto", "hierarchical",
    "lag_forecast", "forecast_race",
}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    df = workload.QUERIES[name](spark, sf)
    found = duck.execute(workload.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.ORACLES) - TRAINED))
def test_runs(spark, sf, name):
    assert workload.QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
