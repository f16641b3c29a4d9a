"""Streaming ingestion, deduplication, features, alerts and hourly means.

Every job takes a streaming DataFrame and a folder, and returns the running
query. No job drops a late row: what has to see earlier rows looks them up in a table, and sums of
micro-batches are added when they are read. ``every=None`` processes what is there and stops; otherwise it is the
trigger interval, such as "1 hour".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from brisa.operators.advisory import alert_events
from brisa.plans.ingest import ingest_batch, keep_errors
from brisa.schemas import KEY, PAYLOAD_SCHEMA, TARGET, TIME
from brisa.sources.payload import payload_explode
from brisa.sources.store import insert_new
from brisa.sources.tiers import add_run, read_runs


def stream_files(
    spark: SparkSession, folder: str, schema: T.StructType, kind: str, files_per_batch: int | None = None, glob: str = "*"
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(kind).load(folder)


def stream_payloads(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Arriving payload files."""
    return stream_files(spark, folder, PAYLOAD_SCHEMA, "json", files_per_batch, "*.json*")


def _start(writer: DataStreamWriter, path: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", f"{path}/_progress")
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def to_parquet(df: DataFrame, path: str, every: str | None, *by: str) -> StreamingQuery:
    writer = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows")
    return _start(writer.partitionBy(*by) if by else writer, path, every)


def stream_ingest(readings: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Readings into the feature table, with lag and rolling features.

    Row windows do not exist on streams, so each micro-batch is joined with the
    stored rows around its own. A repeated micro-batch adds nothing.
    """
    return _start(readings.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, path, number=number)), path, every)


def stream_ingest_payloads(payloads: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Payloads into the feature table; those that report an error go to ``payload_errors``."""

    def ingest(batch: DataFrame, number: int) -> None:
        batch.persist()
        keep_errors(batch, path, number)
        ingest_batch(payload_explode(batch), path, number=number)
        batch.unpersist()

    return _start(payloads.writeStream.foreachBatch(ingest), path, every)


def stream_dedup(readings: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Each (series, hour) once, in ``rows`` by day, however late its copies come.

    A micro-batch reads the keys of its own days only, and adds those that are not there.
    """
    return _start(readings.writeStream.foreachBatch(lambda batch, _: insert_new(batch, f"{path}/rows")), path, every)


def stream_alerts(
    readings: DataFrame, path: str, location: Column, every: str | None = None, aqi: Column | None = None
) -> StreamingQuery:
    aqi = F.col(TARGET) + 1 if aqi is None else aqi
    return to_parquet(alert_events(readings, aqi, location), path, every)


SUMS = T.StructType(
    [T.StructField(KEY, T.LongType()), T.StructField(TIME, T.TimestampType()), T.StructField("sum", T.DoubleType()), T.StructField("count", T.LongType())]
)


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy(KEY, TIME).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))


def stream_hourly_avg(readings: DataFrame, path: str, value: str, every: str | None = None) -> StreamingQuery:
    """Sums and counts per series and hour of every micro-batch; ``hourly_means`` reads them.

    They are merged by tiers (see sources/tiers.py), so reading opens few folders however long the stream runs. A repeated
    micro-batch writes its own run again.
    """

    def add(batch: DataFrame, number: int) -> None:
        hour = F.date_trunc("hour", F.col(TIME).cast("timestamp")).alias(TIME)
        sums = batch.groupBy(F.col(KEY).cast("bigint").alias(KEY), hour).agg(
            F.sum(F.col(value).cast("double")).alias("sum"), F.count(value).alias("count")
        )
        add_run(sums, f"{path}/sums", number, _added)

    return _start(readings.writeStream.foreachBatch(add), path, every)


def hourly_means(spark: SparkSession, path: str) -> DataFrame:
    """Mean per series and hour of all rows that have come so far."""
    sums = read_runs(spark, f"{path}/sums", SUMS, _added)
    return sums.select(KEY, TIME, F.try_divide("sum", "count").alias("mean"), "count")
