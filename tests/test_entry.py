"""Driver contract, and a cross-section of the SQL twins on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "panel_from_events", "read_panel_csv", "infer_frequency", "train_val_test", "meta_windows", "compute_features", "decompose", "evaluate_forecasts",
    "fc_ets", "fc_arima", "nearest_series", "bootstrap_metrics", "meta_training_set", "register_model",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["series_id", "value"] and df.count() > 0


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


@pytest.mark.parametrize("name", SAMPLE)
def test_sql_twin(spark, duck, name):
    assert compare(spark, duck, SF, entry.queries()[name], entry.oracle_sql()[name]) is None
