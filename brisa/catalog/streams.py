"""Streaming jobs over the event table and over payload files, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from brisa.catalog import sql as S
from brisa.catalog.advisories import alert_message_sql
from brisa.catalog.registry import query
from brisa.catalog.sources import payload_texts
from brisa.plans.ingest import current_features, ingest_batch
from brisa.plans.readings import events, readings, table
from brisa.schemas import KEY, READINGS_SCHEMA, TIME
from brisa.session import new_dir
from brisa.sources.payload import parse_payloads
from brisa.sources.store import newest_rows
from brisa.streaming import jobs, keyed


#: Events behind a file of a source that a stream reads in several micro-batches, and the most files of such a source: larger tables
#: have larger files, so the number of micro-batches, each of which looks at what is stored, does not grow.
FILE_ROWS, FILES = 10_000, 12
#: Events behind each of the files that make up one micro-batch.
TASK_ROWS = 500_000


def _files(spark: SparkSession, folder: str, rows: int, most: int | None = None) -> int:
    files = max(1, -(-table(spark, folder, "events").count() // rows))
    return files if most is None else min(files, most)


def _finish(running: StreamingQuery) -> None:
    running.awaitTermination()


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream of readings with their exact time."""
    schema = table(spark, folder, "events").schema
    return jobs.stream_files(spark, folder, schema, "parquet", glob="events.parquet").select(
        F.col("user_id").alias(KEY), F.col("ts").cast("timestamp").alias(TIME), "event_id", "value"
    )


def _ingested(spark: SparkSession, path: str) -> DataFrame:
    return current_features(spark.read.parquet(f"{path}/features").drop("date"))


@query("stream_ingest", f"{S.FT} SELECT {S.FEATURE_COLUMNS.replace(' no2,', ' coalesce(no2, 0) AS no2,')} FROM f")
def stream_ingest(spark, folder):
    """Payload files, two per micro-batch, in any order of time."""
    path = new_dir(spark, "ingest")
    texts = payload_texts(spark, folder).repartition(_files(spark, folder, FILE_ROWS, FILES))
    texts.write.option("compression", "none").text(f"{path}/payloads")
    stream = jobs.stream_files(
        spark, f"{path}/payloads", spark.read.text(f"{path}/payloads").schema, "text", files_per_batch=2
    )
    _finish(jobs.stream_ingest_payloads(parse_payloads(stream), path))
    return _ingested(spark, path)


@query("stream_rolling_features", f"{S.FT} SELECT {S.FEATURE_COLUMNS} FROM f")
def _(spark, folder):
    """Reading files, one per micro-batch, the later hours of the month before the earlier ones."""
    path = new_dir(spark, "rolling")
    typed = readings(spark, folder).select([F.col(f.name).cast(f.dataType) for f in READINGS_SCHEMA.fields])
    late = F.col(TIME) < F.lit("2024-01-16").cast("timestamp")
    files = _files(spark, folder, 10 * FILE_ROWS, FILES // 3)
    for part in (~late, late):
        typed.where(part).repartition(files).write.mode("append").parquet(f"{path}/source")
    stream = jobs.stream_files(spark, f"{path}/source", READINGS_SCHEMA, "parquet", files_per_batch=1)
    _finish(jobs.stream_ingest(stream, path))
    return _ingested(spark, path)


@query(
    "newest_rows",
    f"""{S.FT} SELECT {S.FEATURE_COLUMNS} FROM f QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) = 1""",
)
def _(spark, folder):
    """The table of newest rows after batches whose hours do not follow each other, one of them repeated."""
    path = new_dir(spark, "newest")
    every = readings(spark, folder)
    third = F.dayofmonth(TIME) % 3
    for number, part in enumerate((2, 0, 1, 1)):
        ingest_batch(every.where(third == part), path, number)
    return newest_rows(spark, f"{path}/features")


def _out_of_order(spark: SparkSession, source: DataFrame, path: str, files: int) -> StructType:
    """Files of a source, most days of the month before earlier ones, and then the row that ends it; so many files to a part."""
    schema = StructType([StructField(f.name, f.dataType) for f in source.schema.fields])
    for low, high in ((20, 31), (8, 14), (15, 19), (1, 7)):
        source.where(F.dayofmonth(TIME).between(low, high)).repartition(files).write.mode("append").parquet(path)
    keyed.end_marker(spark, path, schema)
    return schema


@query("stream_rolling_state", f"{S.FT} SELECT {S.FEATURE_COLUMNS} FROM f")
def _(spark, folder):
    """Parts of the readings, one per micro-batch, many of them later than the watermark, against state that holds few rows."""
    path = new_dir(spark, "rolling_state")
    typed = readings(spark, folder).select([F.col(f.name).cast(f.dataType) for f in READINGS_SCHEMA.fields])
    files = _files(spark, folder, TASK_ROWS)
    schema = _out_of_order(spark, typed, f"{path}/source", files)
    stream = jobs.stream_files(spark, f"{path}/source", schema, "parquet", files_per_batch=files)
    _finish(keyed.rolling_by_state(stream, path, "2 days"))
    return keyed.rolling_features(spark, path)


def _late_events(spark: SparkSession, folder: str, path: str) -> DataFrame:
    source = events(spark, folder).select(F.col("user_id").alias(KEY), F.col("ts").alias(TIME), "event_id", "value")
    files = _files(spark, folder, TASK_ROWS)
    schema = _out_of_order(spark, source, f"{path}/source", files)
    return jobs.stream_files(spark, f"{path}/source", schema, "parquet", files_per_batch=files)


@query("stream_dedup_state", "SELECT DISTINCT user_id AS series_id, date_trunc('hour', ts) AS datetime FROM events")
def _(spark, folder):
    """Keys of open hours in the state store; what the watermark has passed is told apart when the result is read."""
    path = new_dir(spark, "dedup_state")
    hourly = _late_events(spark, folder, path).select(KEY, F.date_trunc("hour", TIME).alias(TIME))
    _finish(keyed.dedup_by_state(hourly, path, "2 days"))
    return keyed.deduplicated(spark, path)


@query(
    "stream_hourly_state",
    f"""SELECT user_id AS series_id, date_trunc('hour', ts) AS datetime, {S.r6("avg(value)")} AS mean,
          count(value) AS count FROM events GROUP BY 1, 2""",
)
def _(spark, folder):
    """Sums of open hours in the state store, put out when the watermark has passed them; late rows are added when read."""
    path = new_dir(spark, "hourly_state")
    _finish(keyed.hourly_by_state(_late_events(spark, folder, path), path, "value", "2 days"))
    return keyed.closed_hourly_means(spark, path)


@query("stream_dedup", "SELECT DISTINCT user_id AS series_id, date_trunc('hour', ts) AS datetime FROM events")
def _(spark, folder):
    path = new_dir(spark, "dedup")
    hourly = event_stream(spark, folder).withColumn(TIME, F.date_trunc("hour", TIME))
    _finish(jobs.stream_dedup(hourly, path))
    return spark.read.parquet(f"{path}/rows").select(KEY, TIME)


@query(
    "stream_alerts",
    f"""WITH l AS (SELECT user_id AS series_id, event_id, ts AS datetime,
            least(5.0::DOUBLE, round(value / 60 + 1, 1)) AS value, 'series ' || user_id AS location FROM events),
          a AS (SELECT *, {S.alert_level("value")} AS level FROM l)
        SELECT series_id, event_id, datetime, value, level,
          'AQI Alert: ' || upper(level) || ' - ' || location AS subject, {alert_message_sql()} AS message
        FROM a WHERE value >= 2.0""",
)
def _(spark, folder):
    path = new_dir(spark, "alerts")
    value = F.least(F.lit(5.0), F.round(F.col("value") / 60 + 1, 1))
    scored = event_stream(spark, folder).withColumn("value", value)
    location = F.concat(F.lit("series "), F.col(KEY).cast("string"))
    _finish(jobs.stream_alerts(scored, path, location, aqi=F.col("value")))
    return spark.read.parquet(f"{path}/rows").drop("should_alert")


@query(
    "stream_hourly_avg",
    f"""SELECT user_id AS series_id, date_trunc('hour', ts) AS datetime, {S.r6("avg(value)")} AS mean,
          count(value) AS count FROM events GROUP BY 1, 2""",
)
def _(spark, folder):
    path = new_dir(spark, "hourly")
    _finish(jobs.stream_hourly_avg(event_stream(spark, folder), path, "value"))
    return jobs.hourly_means(spark, path)
