"""Split windows give what plain windows give, wherever a series is cut."""

import datetime
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brisa.operators import windows
from brisa.operators.features import (
    compute_features,
    incremental_features,
    lag_and_rolling,
)
from brisa.operators.profile import gap_report
from brisa.schemas import KEY, TARGET, TIME
from tests.conftest import START, hours, same_rows


def ragged(seed=3):
    """A long series, a sparse one with huge gaps, a dense short one, one row, and null values."""
    r = random.Random(seed)
    rows = [(1, h, r.choice([0, 1, 2, 3, 4, None])) for h in range(600) if r.random() < 0.8]
    rows += [(2, h * 211, r.randint(0, 4)) for h in range(60)]
    rows += [(3, h, h % 5) for h in range(30)]
    rows += [(4, 17, 2)]
    return rows


def plain(df, build):
    return df.withColumns(build(Window.partitionBy(KEY).orderBy(TIME)))


@pytest.mark.parametrize("chunk_hours", [1, 5, 24, 24 * 90])
def test_row_windows_equal_plain_windows(make_readings, chunk_hours):
    df = make_readings(ragged()).select(KEY, TIME, TARGET)
    split = windows.with_row_windows(df, lag_and_rolling, [TARGET], 23, chunk_hours=chunk_hours)
    same_rows(split, plain(df, lag_and_rolling))


@pytest.mark.parametrize("rows_per_chunk", [1, 10, 100, 100_000])
def test_row_windows_over_balanced_chunks(make_readings, rows_per_chunk):
    df = make_readings(ragged()).select(KEY, TIME, TARGET)
    split = windows.with_row_windows(df, lag_and_rolling, [TARGET], 23, rows_per_chunk=rows_per_chunk)
    same_rows(split, plain(df, lag_and_rolling))
    back = windows.with_next(df, {"next": TARGET}, rows_per_chunk=rows_per_chunk)
    same_rows(back, plain(df, lambda w: {"next": F.lead(TARGET).over(w)}))


def test_balanced_chunks_hold_about_as_many_rows_as_asked(spark):
    """Nearly all rows of a year fall on one day."""
    rows = [(1, hours(24 * d)) for d in range(365)]
    rows += [(1, START + datetime.timedelta(days=90, seconds=7 * i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "series_id bigint, datetime timestamp")
    sizes = windows._with_balanced_chunks(df, (KEY,), TIME, 500).groupBy(windows.CHUNK).count().collect()
    assert len(sizes) == 11
    assert max(r["count"] for r in sizes) < 500 + 2 * 60 / 7


def test_a_hot_minute_is_split(spark):
    """A hundred thousand rows in one minute of one series, half of them at one moment, spread evenly over chunks and tasks."""
    moment = F.when(F.col("id") % 2 == 0, F.lit(30_000_000)).otherwise(F.col("id") * 600)
    rows = spark.range(100_000).select(
        F.lit(1).alias(KEY), F.timestamp_micros(F.unix_micros(F.lit(START).cast("timestamp")) + moment).alias(TIME),
        F.col("id").alias("event_id"), (F.col("id") % 11).cast("double").alias(TARGET),
    )
    for ties in ((), ("event_id",)):
        chunked = windows._with_balanced_chunks(rows, (KEY,), TIME, 1000, ties)
        sizes = [r["count"] for r in chunked.groupBy(windows.CHUNK).count().collect()]
        assert len(sizes) == 100 and set(sizes) == {1000}
        assert chunked.select("_rank").distinct().count() == 100_000
    split = windows.rolling_means(rows, {"m": 24}, tie_breakers=("event_id",), rows_per_chunk=1000)
    window = Window.partitionBy(KEY).orderBy(TIME, "event_id").rowsBetween(-23, 0)
    same_rows(split.select("event_id", "m"), rows.withColumn("m", F.avg(TARGET).over(window)).select("event_id", "m"))


@pytest.mark.parametrize("chunk_hours", [24, 31])
def test_time_windows_over_seconds_equal_plain_windows(spark, chunk_hours):
    rows = [(i % 3 if i % 7 else None, START + datetime.timedelta(seconds=i * i % 7919, microseconds=i % 5), i, None if i % 9 == 0 else float(i % 11)) for i in range(3000)]
    rows += [(1, hours(50 * i), 5000 + i, float("nan") if i % 4 == 0 else 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, f"{KEY} bigint, {TIME} timestamp, event_id bigint, {TARGET} double").where(F.col(KEY).isNotNull())
    sizes = {"m1": 1, "m24": 24}
    seconds = Window.partitionBy(KEY).orderBy(F.unix_timestamp(TIME))
    known = F.when(~F.isnan(TARGET), F.col(TARGET))
    want = df.withColumns({n: F.avg(known).over(seconds.rangeBetween(1 - h * 3600, 0)) for n, h in sizes.items()})
    got = windows.rolling_means_by_time(df, sizes, many_per_second=True, chunk_hours=chunk_hours)
    same_rows(got.select("event_id", *sizes), want.select("event_id", *sizes))


def test_windows_over_seconds_add_each_row_a_fixed_number_of_times(spark):
    """A frame that slides over the seconds of a day is added up anew for each row; running sums start where their group does."""
    rows = spark.range(10).selectExpr("1L AS series_id", "timestamp_seconds(id * 1000) AS datetime", "double(id) AS aqi")
    means = windows.rolling_means_by_time(rows, {"mean_3h": 3, "mean_24h": 24}, many_per_second=True)
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\((\w+), (\S+),", plan)
    assert frames and all(low == "unboundedpreceding$()" for _, low in frames)


@pytest.mark.parametrize("chunk_hours", [1, 7, 24 * 90])
def test_next_equals_lead(make_readings, chunk_hours):
    df = make_readings(ragged()).select(KEY, TIME, TARGET)
    lead = plain(df, lambda w: {"next": F.lead(TARGET).over(w)})
    same_rows(windows.with_next(df, {"next": TARGET}, chunk_hours=chunk_hours), lead)


@pytest.mark.parametrize("chunk_hours", [24, 31, 24 * 90])
def test_time_windows_equal_plain_windows(make_readings, chunk_hours):
    df = make_readings(ragged()).select(KEY, TIME, TARGET)
    sizes = {"m3": 3, "m24": 24}
    seconds = Window.partitionBy(KEY).orderBy(F.unix_timestamp(TIME))
    want = df.withColumns({n: F.avg(TARGET).over(seconds.rangeBetween(1 - h * 3600, 0)) for n, h in sizes.items()})
    same_rows(windows.rolling_means_by_time(df, sizes, chunk_hours=chunk_hours), want)


def test_time_window_longer_than_chunk_is_refused(make_readings):
    with pytest.raises(ValueError):
        windows.rolling_means_by_time(make_readings([(1, 0, 1)]), {"m": 24}, chunk_hours=12)


def test_ties_are_broken_by_further_columns(spark):
    rows = [(1, hours(h // 5), h, float(h * h % 11)) for h in range(100)]
    df = spark.createDataFrame(rows, "series_id bigint, datetime timestamp, event_id bigint, aqi double")
    window = Window.partitionBy(KEY).orderBy(TIME, "event_id").rowsBetween(-5, 0)
    want = df.withColumn("m", F.avg(TARGET).over(window))
    for split in ({"chunk_hours": 2}, {"rows_per_chunk": 13}):
        same_rows(windows.rolling_means(df, {"m": 6}, tie_breakers=("event_id",), **split), want)


def test_gap_stretches_row_windows_but_not_time_windows(make_readings):
    df = make_readings([(1, 0, 4), (1, 1, 2), (1, 6, 0)])
    by_rows = {r[TIME]: r["m"] for r in windows.rolling_means(df, {"m": 3}).collect()}
    by_time = {r[TIME]: r["m"] for r in windows.rolling_means_by_time(df, {"m": 3}).collect()}
    assert by_rows[hours(6)] == 2.0
    assert by_time[hours(6)] == 0.0


def test_single_row(make_readings):
    features = compute_features(make_readings([(1, 0, 3)])).first()
    assert features["aqi_change_rate"] == 0.0
    assert features["rolling_aqi_3h"] == features["rolling_aqi_24h"] == 3.0
    assert windows.rolling_spread(make_readings([(1, 0, 3)])).first()["rolling_std_24"] is None


def test_empty_input_keeps_the_schema(make_readings):
    empty, one = make_readings([]), make_readings([(1, 0, 3)])
    assert compute_features(empty).schema == compute_features(one).schema
    assert compute_features(empty).count() == 0


def test_null_target_takes_its_place_and_leaves(make_readings):
    rows = {r[TIME]: r for r in compute_features(make_readings([(1, 0, 4), (1, 1, None), (1, 2, 1)])).collect()}
    assert set(rows) == {hours(0), hours(2)}
    # The previous value is missing, so the change counts as 0; the mean skips it.
    assert rows[hours(2)]["aqi_change_rate"] == 0.0
    assert rows[hours(2)]["rolling_aqi_3h"] == 2.5


@pytest.mark.parametrize("cut", [1, 100, 450, 5000])
def test_incremental_equals_full(make_readings, cut):
    df = make_readings(ragged())
    when = F.lit(hours(cut))
    old, new = df.where(F.col(TIME) < when), df.where(F.col(TIME) >= when)
    same_rows(incremental_features(old, new), compute_features(df).where(F.col(TIME) >= when))


def test_late_rows_change_the_rows_after_them(make_readings):
    df = make_readings(ragged())
    late = (F.hour(TIME) == 5) & (F.col(KEY) != 3)
    full = compute_features(df)
    got = incremental_features(df.where(~late), df.where(late))
    got_keys = got.select(KEY, TIME)
    same_rows(got, full.join(got_keys, [KEY, TIME], "left_semi").select(got.columns))
    # Every row whose features differ without the late rows is among them.
    before = compute_features(df.where(~late))
    changed = full.exceptAll(before).select(KEY, TIME)
    assert changed.join(got_keys, [KEY, TIME], "left_anti").count() == 0


def test_gap_report(make_readings):
    missing = gap_report(make_readings([(1, 0, 1), (1, 3, 1), (2, 5, 1), (2, 6, 1)])).collect()
    assert [(r[KEY], r["missing_hour"]) for r in sorted(missing)] == [(1, hours(1)), (1, hours(2))]
