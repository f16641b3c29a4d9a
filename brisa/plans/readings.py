"""Hourly readings derived from the event and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.schemas import KEY, TARGET, TIME


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def hourly_readings(source: DataFrame, series: Column) -> DataFrame:
    """One reading per series and hour. The grouping combines map-side, so a hot series is no hot task."""
    mean = F.avg("value")
    return (
        source.groupBy(series.alias(KEY), F.date_trunc("hour", "ts").alias(TIME))
        .agg(
            F.least(F.lit(4.0), F.floor(F.round(mean, 6) / 30).cast("double")).alias(TARGET),
            F.round(mean * 8 + 150, 6).alias("co"),
            (F.min("k") % 10).cast("bigint").alias("no"),
            F.round(F.avg(F.when(F.col("event_type") != "signup", F.col("value"))), 6).alias("no2"),
            F.round(F.avg("k"), 6).alias("o3"),
            F.round(F.min("value") / 4, 6).alias("so2"),
            F.round(mean, 6).alias("pm2_5"),
            F.round(mean * 1.5 + F.avg("k"), 6).alias("pm10"),
            F.round(F.max("k") / 4.0, 6).alias("nh3"),
        )
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """One series per user; hours are sparse, so there are gaps."""
    return hourly_readings(events(spark, folder), F.col("user_id"))


def dense_readings(spark: SparkSession, folder: str) -> DataFrame:
    """One series per event type, close to complete hours."""
    return hourly_readings(events(spark, folder), F.col("event_type"))


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a reading of one single series, for windows over one long series."""
    return events(spark, folder).select(
        F.lit(0).cast("bigint").alias(KEY),
        F.col("ts").alias(TIME),
        "event_id",
        F.col("value").alias(TARGET),
    )


def order_series(spark: SparkSession, folder: str) -> DataFrame:
    """Order values by date, a series that spans all months."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias(KEY),
        F.col("o_orderdate").cast("timestamp").alias(TIME),
        F.col("o_totalprice").alias(TARGET),
    )
