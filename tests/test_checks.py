"""Checks answer for any frame; splits take any id; stored results follow their input."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from brisa.catalog import registry
from brisa.operators import checks, metrics
from brisa.operators.features import compute_features
from brisa.schemas import KEY, TARGET


def passed(df):
    return {r["check"]: r["passed"] for r in checks.validate(df).collect()}


def test_the_four_ways_to_fail(make_readings):
    good = compute_features(make_readings([(1, h, h % 5) for h in range(5)]))
    assert set(passed(good).values()) == {True}
    absent = passed(good.drop("no", "pm2_5"))
    assert {c for c, ok in absent.items() if not ok} == {"no", "pm2_5", "integer:no", "pm2_5_0_500"}
    wrong_type = passed(good.withColumn(TARGET, F.col(TARGET).cast("double")))
    assert {c for c, ok in wrong_type.items() if not ok} == {f"integer:{TARGET}"}
    out_of_range = passed(good.withColumn(TARGET, F.lit(7).cast("bigint")))
    assert {c for c, ok in out_of_range.items() if not ok} == {"aqi_0_4", "aqi_0_5"}
    empty = passed(good.where("false"))
    assert {c for c, ok in empty.items() if not ok} == {"not_empty"}


def test_nan_is_in_no_range_and_out_of_none(spark):
    df = spark.createDataFrame([(math.nan, 501.0), (2.0, math.nan), (None, 3.0)], "aqi double, pm2_5 double")
    found = {r["rule"]: r["violations"] for r in checks.range_check(df).collect()}
    assert found == {"aqi_0_4": 0, "aqi_0_5": 0, "pm2_5_0_500": 1}
    assert df.where(checks.in_range()).count() == 3


def test_expectation_about_an_absent_column(spark):
    suite = {
        "expectation_suite_name": "s",
        "expectations": [
            {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "gone"}},
            {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "a"}},
        ],
    }
    rows = checks.expectation_run(spark.createDataFrame([(1,)], "a int"), suite).orderBy("position").collect()
    assert [(r["unexpected"], r["passed"]) for r in rows] == [(None, False), (0, True)]


def test_expectations_answer_for_any_column_and_rule(spark):
    df = spark.createDataFrame(
        [(1.0, "7", "a", datetime.date(2024, 1, 1), [1]), (math.nan, "x", "b", datetime.date(2024, 5, 1), [2]), (900.0, None, None, None, None)],
        "n double, t string, s string, d date, l array<int>",
    )
    between, one_of, present = (f"expect_column_values_to_{w}" for w in ("be_between", "be_in_set", "not_be_null"))
    rules = [
        (between, {"column": "n", "min_value": 0, "max_value": 500}, 1),
        (between, {"column": "n", "min_value": "0"}, 0),
        (between, {"column": "t", "min_value": 0, "max_value": 5}, 2),
        (between, {"column": "s", "max_value": "a"}, 1),
        (between, {"column": "d", "min_value": "2024-02-01"}, 1),
        (between, {"column": "d", "min_value": "no date"}, None),
        (between, {"column": "l", "min_value": 0}, None),
        (one_of, {"column": "n", "value_set": [1, 2.5, "z"]}, 1),
        (one_of, {"column": "t", "value_set": [7]}, 1),
        (one_of, {"column": "s", "value_set": ["a", None]}, 1),
        (one_of, {"column": "s"}, None),
        (present, {"column": "n"}, 1),
        (present, {"column": "l"}, 1),
        (present, {}, None),
        ("expect_column_values_to_rhyme", {"column": "s"}, None),
        ("expect_table_row_count_to_be_between", {"min_value": "2", "max_value": 2}, 1),
    ]
    suite = {"expectation_suite_name": "s", "expectations": [{"expectation_type": k, "kwargs": a} for k, a, _ in rules] + [{}]}
    found = checks.expectation_run(df, suite).orderBy("position").collect()
    assert [r["unexpected"] for r in found] == [n for *_, n in rules] + [None]
    assert [r["passed"] for r in found] == [n == 0 for *_, n in rules] + [False]


@pytest.mark.parametrize("ids", [[2**60, 2**63 - 1, -(2**63), 5], ["click", "view", "", "7"]])
def test_any_series_can_be_split(spark, ids):
    kind = "string" if isinstance(ids[0], str) else "bigint"
    every_hour = F.explode(F.sequence(F.lit(0), F.lit(400 * 3600), F.lit(3600)))
    rows = spark.createDataFrame([(i,) for i in ids], f"{KEY} {kind}").withColumn("second", every_hour)
    rows = rows.withColumn("datetime", F.timestamp_seconds("second"))
    share = metrics.train_val_split(rows).agg(F.avg(F.col("is_train").cast("int"))).first()[0]
    assert 0.75 < share < 0.85


def test_stored_results_follow_their_input(spark, tmp_path):
    folder = str(tmp_path)
    write = lambda n: spark.range(n).coalesce(1).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    count = lambda: registry.once(spark, folder, "n", lambda: spark.read.parquet(f"{folder}/events.parquet").count())
    write(3)
    assert (count(), count()) == (3, 3)
    write(5)
    assert count() == 5
