"""Streams against the same computation on the whole input."""

import pytest
from pyspark.sql import functions as F

from brisa.operators.features import compute_features
from brisa.plans.ingest import current_features
from brisa.schemas import KEY, READINGS_SCHEMA, TARGET, TIME
from brisa.session import new_dir
from brisa.sources.payload import parse_payloads, to_payloads
from brisa.sources import tiers
from brisa.streaming import jobs, keyed
from tests.conftest import same_rows
from tests.test_windows import ragged


def source(spark, df, files):
    """A folder of files that are not in order of time."""
    path = new_dir(spark, "source")
    typed = df.select([F.col(f.name).cast(f.dataType) for f in READINGS_SCHEMA.fields])
    typed.repartition(files, F.floor(F.unix_timestamp(TIME) / 86400)).write.parquet(path)
    return path


def finish(query):
    query.awaitTermination()


def test_ingest_in_two_runs(spark, make_readings):
    readings = make_readings(ragged()).where(F.col(TARGET).isNotNull())
    path, folder = new_dir(spark, "job"), source(spark, readings.where(F.col(KEY) != 3), 3)
    run = lambda: finish(
        jobs.stream_ingest(jobs.stream_files(spark, folder, READINGS_SCHEMA, "parquet", files_per_batch=1), path)
    )
    run()
    readings.where(F.col(KEY) == 3).write.mode("append").parquet(folder)
    run()
    got = current_features(spark.read.parquet(f"{path}/features").drop("date"))
    same_rows(got, compute_features(readings).select(got.columns))


def test_payload_files(spark, make_readings):
    readings = make_readings([(1, h, h % 5) for h in range(60)])
    folder, path = new_dir(spark, "payloads"), new_dir(spark, "job")
    failed = spark.createDataFrame([('{"series_id": 9, "cod": "401", "message": "Invalid key"}',)], "value string")
    to_payloads(readings).unionByName(parse_payloads(failed)).repartition(2).write.json(folder)
    finish(jobs.stream_ingest_payloads(jobs.stream_payloads(spark, folder), path))
    errors = spark.read.parquet(f"{path}/payload_errors").collect()
    assert [(r["cod"], r["message"]) for r in errors] == [("401", "Invalid key")]
    got = current_features(spark.read.parquet(f"{path}/features").drop("date"))
    same_rows(got, compute_features(readings).select(got.columns))


def late_files(spark, df):
    """Files of a day each, the last days first."""
    path = new_dir(spark, "source")
    typed = df.select([F.col(f.name).cast(f.dataType) for f in READINGS_SCHEMA.fields])
    for day in range(3, -1, -1):
        typed.where(F.floor(F.unix_timestamp(TIME) / 86400) % 4 == day).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("files", [1, 2, None])
def test_late_rows_are_kept(spark, make_readings, files):
    readings = make_readings([(s, h, h % 5) for s in (1, 2) for h in range(40)] + [(1, 80, 2), (2, 70, 1)])
    folder = late_files(spark, readings.unionByName(readings))
    stream = lambda: jobs.stream_files(spark, folder, READINGS_SCHEMA, "parquet", files)
    path = new_dir(spark, "job")
    finish(jobs.stream_dedup(stream(), f"{path}/dedup"))
    same_rows(spark.read.parquet(f"{path}/dedup/rows").drop("date"), readings)
    finish(jobs.stream_hourly_avg(stream(), f"{path}/means", TARGET))
    means = {(r[KEY], r[TIME]): (r["mean"], r["count"]) for r in jobs.hourly_means(spark, f"{path}/means").collect()}
    assert means == {(r[KEY], r[TIME]): (r[TARGET], 2) for r in readings.collect()}


def test_alerts(spark, make_readings):
    folder, path = source(spark, make_readings([(1, h, h % 5) for h in range(20)]), 2), new_dir(spark, "job")
    stream = jobs.stream_files(spark, folder, READINGS_SCHEMA, "parquet")
    finish(jobs.stream_alerts(stream, path, F.lit("here")))
    levels = {r["level"]: r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("level").count().collect()}
    assert levels == {"moderate": 4, "unhealthy_sensitive": 4, "unhealthy": 4, "hazardous": 4}


def in_files(spark, df, parts):
    """A source of one file per part, in the order of the numbers that ``parts`` gives, and the row that ends it."""
    path = new_dir(spark, "source")
    for number in range(4):
        df.where(parts % 4 == number).coalesce(1).write.mode("append").parquet(path)
    keyed.end_marker(spark, path, df.schema)
    return path


def typed(df):
    return df.select([F.col(f.name).cast(f.dataType) for f in READINGS_SCHEMA.fields])


@pytest.mark.parametrize("files, delay", [(1, "1 hour"), (2, "30 hours"), (1, "4000 hours")])
def test_rolling_state_equals_one_computation(spark, make_readings, files, delay):
    """Files in an order that makes most rows late, with copies, incomplete and sparse rows."""
    readings = typed(make_readings(ragged()))
    gone = F.when(F.hour(TIME) != 7, F.col("pm2_5"))
    nan = F.when(F.hour(TIME) == 9, F.lit(float("nan"))).otherwise(F.col(TARGET))
    readings = readings.withColumn("pm2_5", gone).withColumn(TARGET, nan)
    part = F.pmod(F.floor(F.unix_timestamp(TIME) / 3600 / 31) * 3, F.lit(4))
    folder, path = in_files(spark, readings.unionByName(readings.where(F.hour(TIME) == 3)), part), new_dir(spark, "job")
    stream = jobs.stream_files(spark, folder, READINGS_SCHEMA, "parquet", files)
    finish(keyed.rolling_by_state(stream, path, delay))
    got = keyed.rolling_features(spark, path)
    same_rows(got, compute_features(readings).select(got.columns))
    rows = spark.read.parquet(f"{path}/rows")
    assert delay != "1 hour" or files != 1 or not rows.where("late = 'true'").isEmpty()


def test_rolling_state_is_bounded(spark, make_readings):
    """A series that goes on and one that falls silent keep the rows that windows look back at, not their history."""
    path, folder = new_dir(spark, "job"), new_dir(spark, "source")
    readings = typed(make_readings([(1, h, h % 5) for h in range(900)] + [(2, h, 1) for h in range(200)]))
    for part in range(3):
        readings.where(F.floor(F.unix_timestamp(TIME) / 3600 / 300) % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    keyed.end_marker(spark, folder, READINGS_SCHEMA)
    query = keyed.rolling_by_state(jobs.stream_files(spark, folder, READINGS_SCHEMA, "parquet", 1), path, "10 hours")
    finish(query)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * (keyed.KEPT + 2)
    got = keyed.rolling_features(spark, path)
    same_rows(got, compute_features(readings).select(got.columns))


@pytest.mark.parametrize("files", [1, 2, None])
def test_late_rows_of_keyed_streams_are_kept(spark, make_readings, files):
    """Days in falling order and a watermark of an hour: nearly all rows are late, and none is missing."""
    readings = typed(make_readings([(s, h, h % 5) for s in (1, 2) for h in range(40)] + [(1, 80, 2), (2, 70, 1), (3, 1, None)]))
    twice = readings.unionByName(readings)
    folder = in_files(spark, twice, 3 - F.floor(F.unix_timestamp(TIME) / 86400) % 4)
    stream = lambda: jobs.stream_files(spark, folder, READINGS_SCHEMA, "parquet", files)
    path = new_dir(spark, "job")
    first = keyed.dedup_by_state(stream(), f"{path}/dedup", "1 hour")
    finish(first)
    same_rows(keyed.deduplicated(spark, f"{path}/dedup"), readings)
    second = keyed.hourly_by_state(stream(), f"{path}/means", TARGET, "1 hour")
    finish(second)
    means = {(r[KEY], r[TIME]): (r["mean"], r["count"]) for r in keyed.closed_hourly_means(spark, f"{path}/means").collect()}
    assert means == {(r[KEY], r[TIME]): (r[TARGET], 2 if r[TARGET] is not None else 0) for r in readings.collect()}
    for query in (first, second):
        # All hours are closed at the end, so nothing is left in the store.
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    late = spark.read.parquet(f"{path}/means/rows").where("late = 'true'").agg(F.sum("count")).first()[0]
    assert files != 1 or late > 40


def test_hourly_sums_of_many_micro_batches(spark, make_readings, monkeypatch):
    """Sums are merged by tiers: few runs are read, and a repeated micro-batch changes nothing."""
    monkeypatch.setattr(tiers, "FAN", 3)
    readings = typed(make_readings([(1, h % 5, h % 4) for h in range(44)]))
    folder, path = new_dir(spark, "source"), new_dir(spark, "job")
    readings.repartition(11).write.parquet(folder)
    finish(jobs.stream_hourly_avg(jobs.stream_files(spark, folder, READINGS_SCHEMA, "parquet", 1), path, TARGET))
    want = {(r[KEY], r[TIME]): (r["m"], r["n"]) for r in readings.groupBy(KEY, TIME).agg(F.avg(TARGET).alias("m"), F.count("*").alias("n")).collect()}
    means = lambda: {(r[KEY], r[TIME]): (r["mean"], r["count"]) for r in jobs.hourly_means(spark, path).collect()}
    assert means() == want
    found = tiers.runs(spark, f"{path}/sums")
    assert sum(3**tier for tier, _ in found) >= 10 and len(found) <= 6 and max(tier for tier, _ in found) == 2


def test_ticks_go_no_further_than_the_watermark(spark, make_readings):
    """Only data rows reach the state, each once."""
    readings = make_readings(ragged())
    assert keyed.with_clock(readings, "1 hour").count() == readings.count()


def test_sources_of_larger_tables_have_larger_files(spark, monkeypatch):
    """The number of micro-batches follows neither from the number of tasks nor from that of rows."""
    from brisa.catalog import QUERIES, streams

    class Seen(Exception):
        pass

    def seen(spark, folder, schema, kind, **_):
        raise Seen(len(spark.read.format(kind).schema(schema).load(folder).inputFiles()))

    monkeypatch.setattr(jobs, "stream_files", seen)
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for name in ("stream_ingest", "stream_rolling_features"):
            with pytest.raises(Seen) as found:
                QUERIES[name](spark, "/root/testdata/sf0.001")
            assert found.value.args[0] <= streams.FILES
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
