"""Payloads, tables, snapshots, CSV and the ingestion job."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from brisa.operators import features
from brisa.operators.features import compute_features
from brisa.operators.shape import latest_row
from brisa.plans import ingest
from brisa.schemas import FEATURES_SCHEMA, KEY, READINGS_SCHEMA, TARGET, TIME
from brisa.session import new_dir, shared_dir
from brisa.sources import files, payload, store, tiers
from tests.conftest import hours, same_rows
from tests.test_windows import ragged


def test_payloads(spark):
    entry = {"dt": 1704067200, "main": {"aqi": 3}, "components": {"co": 200.5, "pm2_5": 12.0, "nh3": None}}
    later = {**entry, "dt": 1704070800, "main": {"aqi": 5}}
    texts = [
        {"series_id": 1, "list": [entry, later]},
        {"series_id": 2, "cod": "200", "list": [later]},
        {"series_id": 3, "cod": "401", "message": "Invalid key"},
        {"series_id": 4, "cod": "404", "list": [entry]},
        {"series_id": 5},
    ]
    df = payload.parse_payloads(spark.createDataFrame([(json.dumps(t),) for t in texts], "value string"))
    rows = payload.payload_explode(df).orderBy(KEY, TIME).collect()
    assert [(r[KEY], r[TIME], r[TARGET]) for r in rows] == [(1, hours(0), 2.0), (1, hours(1), 4.0), (2, hours(1), 4.0)]
    assert (rows[0]["co"], rows[0]["nh3"], rows[0]["o3"]) == (200.5, 0.0, 0.0)
    assert [(r[KEY], r[TARGET]) for r in payload.payload_current(df).orderBy(KEY).collect()] == [(1, 2.0), (2, 4.0)]
    errors = {r[KEY]: r["message"] for r in payload.payload_errors(df).collect()}
    assert errors == {3: "Invalid key", 4: "Unknown error", 5: "Unknown error"}


def test_payload_round_trip(spark, make_readings):
    readings = make_readings([(1, h, h % 5) for h in range(50)] + [(2, 3, 1)])
    path = new_dir(spark, "payloads")
    payload.to_payloads(readings).write.json(path)
    same_rows(payload.payload_explode(payload.read_payloads(spark, path)), readings)


def test_csv_round_trip(spark, make_readings):
    features = compute_features(make_readings(ragged())).select([f.name for f in FEATURES_SCHEMA.fields])
    path = new_dir(spark, "csv")
    files.write_csv(features, path)
    same_rows(files.read_csv(spark, path, FEATURES_SCHEMA), features, digits=15)


def test_windows_of_a_stored_table(spark, make_readings):
    path = new_dir(spark, "features")
    assert store.read_table(spark, path).count() == 0
    store.append_rows(compute_features(make_readings([(1, h, 1) for h in range(24 * 40)])), path)
    table = store.read_table(spark, path)
    assert store.batch_window(table).count() == 25
    assert store.batch_window(table, F.lit(hours(100)).cast("timestamp"), 3).count() == 4
    assert store.history_window(table, 2).count() == 49
    assert store.history_window(table, 30).count() == 30 * 24 + 1
    assert store.history_window(table, 300).count() == 40 * 24
    plan = store.batch_window(table, F.lit(hours(100)).cast("timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(datetime)" in plan


def test_insert_new_is_idempotent(spark, make_readings):
    path = new_dir(spark, "features")
    features = compute_features(make_readings(ragged())).select([f.name for f in FEATURES_SCHEMA.fields])
    store.insert_new(features.where(F.col(TIME) < F.lit(hours(300))), path)
    store.insert_new(features.where(F.col(TIME) > F.lit(hours(200))), path)
    store.insert_new(features, path)
    same_rows(store.read_table(spark, path).drop("date"), features)


def test_snapshots(spark, make_readings):
    path = new_dir(spark, "snapshots")
    assert store.snapshot_versions(spark, path) == []
    features = compute_features(make_readings([(1, h, 1) for h in range(10)]))
    assert store.write_snapshot(features, path) == 1
    assert store.write_snapshot(features.limit(4), path) == 2
    x, y = store.read_snapshot(spark, path)
    assert (x.count(), TARGET in x.columns, y.columns) == (4, False, [KEY, TIME, TARGET])
    assert store.read_snapshot(spark, path, 1)[0].count() == 10


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [2, 0, 3, 1], [3, 3, 2, 1, 0, 0]])
def test_ingested_batches_equal_one_computation(spark, make_readings, order):
    """Batches in any order, some of them twice, over short and very sparse series."""
    readings = make_readings(ragged())
    part = F.floor(F.unix_timestamp(TIME) / 3600 / 157) % 4
    path = new_dir(spark, "ingest")
    for revision, number in enumerate(order):
        ingest.ingest_batch(readings.where(part == number), path, revision)
    got = ingest.current_features(spark.read.parquet(f"{path}/features").drop("date"))
    same_rows(got, compute_features(readings).select(got.columns))
    stored = store.read_table(spark, f"{path}/readings", READINGS_SCHEMA)
    assert stored.count() == readings.count()


def test_repeat_after_a_crash_between_the_two_writes(spark, make_readings, monkeypatch):
    readings = make_readings(ragged())
    path = new_dir(spark, "ingest")
    append, calls = store.append_rows, []

    def fails_once(df, target):
        calls.append(target)
        if len(calls) == 2:
            raise RuntimeError("lost")
        append(df, target)

    monkeypatch.setattr(ingest, "append_rows", fails_once)
    with pytest.raises(RuntimeError):
        ingest.ingest_batch(readings, path, 0)
    ingest.ingest_batch(readings, path, 0)
    got = ingest.current_features(spark.read.parquet(f"{path}/features").drop("date"))
    want = compute_features(readings)
    same_rows(got, want.select(got.columns))


def test_rejected_readings_are_not_stored(spark, make_readings):
    path = new_dir(spark, "ingest")
    ingest.ingest_batch(make_readings([(1, 0, 9), (1, 1, -1), (1, 2, 3)]), path, 0)
    assert store.read_table(spark, f"{path}/readings", READINGS_SCHEMA).count() == 1
    ingest.ingest_batch(make_readings([(1, 3, 9)]), path, 1)
    assert store.read_table(spark, f"{path}/readings", READINGS_SCHEMA).count() == 1
    rejected = spark.read.parquet(f"{path}/rejected").collect()
    assert sorted((r[TARGET], r["reason"]) for r in rejected) == [(v, "out of range") for v in (-1.0, 9.0, 9.0)]


def windowed_rows(monkeypatch):
    """The numbers of rows that windows are computed over from now on."""
    counts, compute = [], features.affected_rows

    def counting(rows, **split):
        counts.append(rows.count())
        return compute(rows, **split)

    monkeypatch.setattr(features, "affected_rows", counting)
    return counts


def test_a_late_hour_in_a_long_series_windows_few_rows(spark, make_readings, monkeypatch):
    every = make_readings([(1, h, h % 5) for h in range(3000)] + [(2, 40 * h, h % 3) for h in range(70)])
    late = F.col(TIME).isin([hours(h) for h in (2000, 2020, 0)])
    counts = windowed_rows(monkeypatch)
    got = features.incremental_features(every.where(~late & (F.col(KEY) == 1)), every.where(late & (F.col(KEY) == 1)))
    want = compute_features(every.where(F.col(KEY) == 1)).where(F.col(TIME).between(hours(2000), hours(2043)) | (F.col(TIME) <= hours(23)))
    same_rows(got, want)
    path = new_dir(spark, "ingest")
    ingest.ingest_batch(every.where(~late), path, 0)
    ingest.ingest_batch(every.where(late & (F.col(TIME) == hours(2000)) & (F.col(KEY) == 1)), path, 1)
    ingest.ingest_batch(every.where(late), path, 2)
    assert counts[0] < 200 and counts[2] < 100 and counts[3] < 600
    got = ingest.current_features(spark.read.parquet(f"{path}/features").drop("date"))
    same_rows(got, compute_features(every).select(got.columns))


def test_neighbours_are_not_met_by_series_alone(spark, make_readings):
    every = make_readings(ragged())
    late = F.hour(TIME) == 5
    plan = features.incremental_features(every.where(~late), every.where(late))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("_day" in line for line in joins)


def test_newest_rows_equal_those_of_all_history(spark, make_readings, monkeypatch):
    """Many batches in any order of time, a series that falls silent at once, a revised newest row."""
    monkeypatch.setattr(tiers, "FAN", 2)
    readings = make_readings([(1, h, h % 5) for h in range(60)] + [(2, 3, 1)] + [(3, 7 * h, h % 4) for h in range(30)])
    path = new_dir(spark, "ingest")
    for number, part in enumerate((3, 0, 2, 2, 1)):
        ingest.ingest_batch(readings.where(F.floor(F.unix_timestamp(TIME) / 3600 / 11) % 4 == part), path, number)
    table = ingest.current_features(spark.read.parquet(f"{path}/features").drop("date"))
    newest = store.newest_rows(spark, f"{path}/features")
    same_rows(newest, latest_row(table))
    assert newest.count() == 3
    assert len(tiers.runs(spark, store.newest_path(f"{path}/features"))) <= 3
    assert all(f"{path}/features_newest/" in file for file in newest.inputFiles())


def test_a_repeated_batch_writes_its_quarantine_once(spark, make_readings):
    path = new_dir(spark, "ingest")
    bad = make_readings([(1, 0, 9), (1, 1, 2), (2, 1, 7)])
    failed = payload.parse_payloads(spark.createDataFrame([('{"series_id": 9, "cod": "401", "message": "Invalid key"}',)], "value string"))
    for _ in range(2):
        ingest.keep_errors(failed, path, 4)
        ingest.ingest_batch(bad, path, number=4)
    assert spark.read.parquet(f"{path}/rejected").count() == 2
    assert spark.read.parquet(f"{path}/payload_errors").count() == 1
    assert spark.read.parquet(f"{path}/features").count() == 1
    checks = {r["check"]: r["passed"] for r in spark.read.parquet(f"{path}/checks").collect()}
    assert checks["aqi_0_4"] and checks["integer:aqi"] and len(checks) > 10


def test_rows_without_a_required_column_are_rejected(spark, make_readings):
    path = new_dir(spark, "ingest")
    ingest.ingest_batch(make_readings([(1, 0, 1), (1, 1, 2)]).drop("pm10", "o3"), path, 0)
    assert {r["reason"] for r in spark.read.parquet(f"{path}/rejected").collect()} == {"no column o3, pm10"}
    assert store.read_table(spark, f"{path}/readings", READINGS_SCHEMA).count() == 0


def test_incomplete_readings_keep_their_place_in_the_windows(spark, make_readings):
    readings = make_readings([(1, 0, 4), (1, 1, 0), (1, 2, 2), (1, 3, 4), (1, 4, 1)])
    gone = F.when(F.col(TIME) != F.lit(hours(1)), F.col("pm2_5"))
    nan = F.when(F.col(TIME) == F.lit(hours(3)), F.lit(float("nan"))).otherwise(F.col(TARGET))
    readings = readings.withColumn("pm2_5", gone).withColumn(TARGET, nan)
    path = new_dir(spark, "ingest")
    for hour in (3, 0, 4, 1, 2):
        ingest.ingest_batch(readings.where(F.col(TIME) == F.lit(hours(hour))), path)
    got = ingest.current_features(spark.read.parquet(f"{path}/features").drop("date"))
    same_rows(got, compute_features(readings).select(got.columns))
    rates = {r[TIME]: (r["aqi_change_rate"], r["rolling_aqi_3h"]) for r in got.collect()}
    assert rates == {hours(0): (0.0, 4.0), hours(2): (2.0, 2.0), hours(4): (0.0, 1.5)}


def test_shared_folder_comes_from_the_session(spark):
    assert new_dir(spark, "x").startswith(shared_dir(spark) + "/x-")
    assert new_dir(spark, "x") != new_dir(spark, "x")


def session_stub(master, **conf):
    context = SimpleNamespace(master=master, applicationId=f"stub-{master}")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)), sparkContext=context)


def test_only_a_local_master_may_make_its_own_folder():
    named = {"spark.checkpoint.dir": "hdfs://store/work/"}
    assert shared_dir(session_stub("yarn", **named)) == "hdfs://store/work"
    for cluster in ("yarn", "local-cluster[2,1,1024]", "spark://local:7077"):
        with pytest.raises(ValueError):
            shared_dir(session_stub(cluster))
    assert shared_dir(session_stub("local[2]")) == shared_dir(session_stub("local[2]"))


def test_a_small_batch_has_few_parts(spark, make_readings, monkeypatch):
    """Steps of a batch after the first have as many parts as their rows need, not as shuffles have partitions."""
    parts, append = [], ingest.append_rows
    monkeypatch.setattr(ingest, "append_rows", lambda df, path: (parts.append(df.rdd.getNumPartitions()), append(df, path)))
    before, path = spark.conf.get("spark.sql.shuffle.partitions"), new_dir(spark, "job")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for number, offset in enumerate((30, 0)):
            ingest.ingest_batch(make_readings([(s, h * 7 + offset, h % 5) for s in range(3) for h in range(30)]), path, number)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(parts) == 4 and max(parts) < 40


def test_neighbour_rows_are_those_of_the_nearest_days(spark, make_readings):
    """Against plain Python, for series of a row an hour, a day, a fortnight and of one row only, and new days beside and far from stored ones."""
    steps = {1: 1, 2: 24, 3: 24 * 14, 4: 24 * 400}
    stored = [(s, h, 1) for s, step in steps.items() for h in range(0, 24 * 700, step) if not 4000 < h < 4100]
    fresh = [(s, h, 2) for s in (*steps, 5) for h in (4030, 4050, 24 * 365 + 1, 24 * 701)]
    table = make_readings(stored).withColumn("date", F.to_date(TIME))
    new = make_readings(fresh)
    days = lambda df: sorted(r[0] for r in df.select(F.to_date(TIME)).distinct().collect())
    ends = days(table)
    got = ingest.neighbour_rows(table, new, days(new), ends[0], ends[-1])
    want = set()
    for s in steps:
        held = sorted(h // 24 for t, h, _ in stored if t == s)
        for at in {h // 24 for t, h, _ in fresh if t == s}:
            before, after = [d for d in held if d < at], [d for d in held if d > at]
            low, high = before[-23:][:1] or [at], after[:23][-1:] or [at]
            want |= {(s, h) for t, h, _ in stored if t == s and low[0] <= h // 24 <= high[0]}
    found = {(r[KEY], int((r[TIME] - hours(0)).total_seconds()) // 3600) for r in got.collect()}
    assert found == want and got.count() == len(want)
