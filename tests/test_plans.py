"""What the physical plans must and must not hold."""

import re

import pytest

from __spark_entry__ import queries
from tests.test_oracle import FOLDER

PLANNED = [
    "features_full", "incremental_features", "long_series_rolling", "correlation_matrix", "describe",
    "boxplot_stats", "transition_matrix", "histogram_20", "gap_report", "alert_events", "dedup_upsert",
    "latest_row", "new_rows_only", "kde_curve", "standard_scale", "temporal_split", "prediction_monitor",
    "forecast_heuristic", "staleness_check", "payload_explode", "weekday_profile",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "LocalTableScan"):
        assert unwanted not in text


@pytest.mark.parametrize("name", ["features_full", "rolling_std_24", "aqi_change_rate", "gap_report"])
def test_row_windows_are_split_within_a_series(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    shuffles = re.findall(r"hashpartitioning\(series_id#\d+L, _chunk#\d+L", text)
    assert len(shuffles) >= 2
    assert "WindowGroupLimit" in text and "Partial" in text


def test_only_needed_columns_are_read(spark):
    text = plan(queries()["hourly_profile"](spark, FOLDER))
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"ts", "user_id", "value"}
