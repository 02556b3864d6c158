"""Plans hold no pairing of all rows and read only the columns they need."""

import pytest

from tablewright import workload

workload.load_all()
# a three-row side
SMALL_SIDE = {"sql_join_theta"}


def plan(spark, sf, name):
    return workload.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    "asof_join backtest_mae classification_report confusion_matrix f_classif fit_gap infer_frequency interpolate_gaps "
    "mutual_info random_split regularize_series roc_auc seasonal_naive sql_join_inner stratified_split trend_linear".split(),
)
def test_no_cross_join_and_no_row_python(spark, sf, name):
    text = plan(spark, sf, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in text


def test_only_needed_columns_are_read(spark, sf):
    text = plan(spark, sf, "duplicate_rows")
    read = text[text.index("ReadSchema") :].split("\n")[0]
    assert "l_quantity" in read and "l_orderkey" not in read and "l_shipdate" not in read


def test_filters_reach_the_scan(spark, sf):
    text = plan(spark, sf, "asof_join")
    assert "EqualTo(event_type,purchase)" in text and "EqualTo(event_type,view)" in text


def test_top_values_are_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(spark, sf, "categorical_top5")


def test_splits_do_not_shuffle_the_rows(spark, sf):
    """Only bucket counts and the rows of the cut buckets are exchanged."""
    from tablewright.operators.ranking import row_hash
    from tablewright.operators.sampling import split_rows

    df = workload.table(spark, sf, "orders")
    text = split_rows(df, row_hash("o_orderkey"), ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    sure = text.split("Window")[0]
    assert "Exchange" not in sure
