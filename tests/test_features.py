"""Typing, keys, checks and calendar fields."""

import datetime
import json
import math

from pyspark.sql import functions as F

from brisa.operators import checks, features
from brisa.operators.upsert import dedup, dedup_upsert, new_rows_only
from brisa.schemas import KEY, MODEL_FEATURES, TARGET, TIME
from tests.conftest import hours


def test_weekend_flag(spark):
    days = [datetime.datetime(2024, 1, d) for d in (5, 6, 7, 8)]  # Friday to Monday
    df = features.add_calendar(spark.createDataFrame([(d,) for d in days], "datetime timestamp")).orderBy(TIME)
    assert [(r["day_of_week"], r["is_weekend"]) for r in df.collect()] == [(4, 0), (5, 1), (6, 1), (0, 0)]


def test_hour_floor(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 5, 59, 59),)], "datetime timestamp")
    assert features.floor_to_hour(df).first()[TIME] == hours(5)


def test_coercion_makes_bad_values_null(spark):
    rows = [("3", "x", math.nan, "4.9"), ("bad", "1.5", 2.0, None)]
    df = spark.createDataFrame(rows, "aqi string, co string, pm10 double, hour string")
    got = [tuple(r) for r in features.coerce_types(df).collect()]
    assert got == [(3, None, None, 4), (None, 1.5, 2.0, None)]


def test_label_type(make_readings):
    df = make_readings([(1, 0, 3.7)])
    assert features.compute_features(df).first()[TARGET] == 3
    kept = features.compute_features(df, label_type="double").first()
    assert kept[TARGET] == 3.7
    # The windows see the value before it is truncated.
    assert features.compute_features(df).first()["rolling_aqi_3h"] == 3.7


def test_event_id_depends_on_key_only(make_readings):
    one = features.add_event_id(make_readings([(1, 0, 3), (1, 1, 3), (2, 0, 3)])).collect()
    two = features.add_event_id(make_readings([(1, 0, 1)])).first()
    assert len({r["event_id"] for r in one}) == 3
    assert two["event_id"] in {r["event_id"] for r in one}


def test_missing_feature_is_zero(make_readings):
    df = features.align_features(make_readings([(1, 0, 3)]).drop("nh3"))
    assert df.columns == MODEL_FEATURES
    assert df.first()["nh3"] == 0.0


def test_only_numeric_inputs_remain(make_readings):
    df = features.compute_features(make_readings([(1, 0, 3)])).withColumn("note", F.lit("x"))
    assert set(features.drop_non_features(df).columns) == set(MODEL_FEATURES)


def test_checks(make_readings):
    good = features.compute_features(make_readings([(1, 0, 3)]))
    assert all(r["passed"] for r in checks.validate(good).collect())
    empty = checks.required_columns_check(make_readings([]).drop("nh3")).where("NOT passed")
    assert {r["check"] for r in empty.collect()} == {"nh3", "not_empty"}
    rows = [(1, 0, 5), (1, 1, 6), (1, 2, -1), (1, 3, None)]
    ranges = {r["rule"]: r["violations"] for r in checks.range_check(make_readings(rows)).collect()}
    assert ranges == {"aqi_0_4": 3, "aqi_0_5": 2, "pm2_5_0_500": 0}
    assert make_readings(rows).where(checks.in_range()).count() == 1
    types = {r["column"]: r["passed"] for r in checks.integer_type_check(make_readings(rows)).collect()}
    assert types == {"aqi": False, "no": False}


def test_expectations(spark, make_readings):
    suite = {
        "expectation_suite_name": "s",
        "meta": {},
        "expectations": [
            {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1, "max_value": 2}},
            {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "aqi"}},
            {
                "expectation_type": "expect_column_values_to_be_between",
                "kwargs": {"column": "aqi", "min_value": 1, "max_value": None},
            },
        ],
    }
    listed = checks.expectation_list(checks.suite_frame(spark, suite)).orderBy("position").collect()
    assert [r["column"] for r in listed] == ["N/A", "aqi", "aqi"]
    assert listed[0]["params"] == {"min_value": "1", "max_value": "2"}
    assert json.loads(checks.suite_frame(spark, suite).first()["value"]) == suite
    run = checks.expectation_run(make_readings([(1, 0, 0), (1, 1, None), (1, 2, 2)]), suite).orderBy("position")
    assert [(r["unexpected"], r["passed"]) for r in run.collect()] == [(1, False), (1, False), (1, False)]


def test_upserts(make_readings):
    stored = make_readings([(1, 0, 1), (1, 5, 1)])
    batch = make_readings([(1, 4, 2), (1, 5, 2), (2, 0, 2), (2, 0, 3)])
    # All or nothing: series 1 has no newer hour, so its late hour 4 is dropped.
    assert {(r[KEY], r[TIME]) for r in new_rows_only(batch, stored).collect()} == {(2, hours(0))}
    fresh = sorted((r[KEY], r[TIME], r[TARGET]) for r in dedup_upsert(batch, stored).collect())
    assert fresh == [(1, hours(4), 2.0), (2, hours(0), 3.0)]
    assert dedup(batch).count() == 3
