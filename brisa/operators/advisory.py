"""Categories, advisories and alerts attached to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brisa.functions import categories as C
from brisa.schemas import KEY, TIME

STALE_SECONDS = 10_800


def add_health_category(df: DataFrame, aqi: Column) -> DataFrame:
    return df.withColumn("aqi_category", C.health_category(aqi))


def add_status(df: DataFrame, aqi: Column) -> DataFrame:
    return df.withColumns(C.status_fields(aqi))


def add_gauge(df: DataFrame, aqi: Column) -> DataFrame:
    return df.withColumns({**C.gauge_fields(aqi), "level": C.gauge_level(aqi)})


def add_severity(df: DataFrame, aqi: Column) -> DataFrame:
    return df.withColumns({"band": C.severity_band(aqi), "style": C.severity_style(aqi)})


def add_advisory(df: DataFrame, aqi: Column) -> DataFrame:
    return df.withColumns(C.advisory_fields(aqi))


def planning_advice(forecast: DataFrame, value: str) -> DataFrame:
    """Advice per series from the highest forecast value."""
    highest = forecast.groupBy(KEY).agg(F.max(value).alias("max_forecast"))
    return highest.withColumns(C.planning_fields(F.col("max_forecast")))


def alert_level(df: DataFrame, aqi: Column) -> DataFrame:
    return df.withColumns({"level": C.alert_level(aqi), "should_alert": C.should_alert(aqi)})


def alert_events(df: DataFrame, aqi: Column, location: Column) -> DataFrame:
    """One alert with subject and body per row that reaches a threshold. Works on streams too."""
    return (
        alert_level(df, aqi)
        .where(F.col("should_alert"))
        .withColumns(
            {
                "subject": C.alert_subject(F.col("level"), location),
                "message": C.alert_message(F.col("level"), location, aqi, F.col(TIME)),
            }
        )
    )


def staleness_check(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Newest row per series and whether it is more than 3 hours older than ``as_of``."""
    as_of = df.agg(F.max(TIME)).scalar() if as_of is None else as_of
    newest = df.groupBy(KEY).agg(F.max(TIME).alias("newest"))
    age = F.unix_timestamp(as_of) - F.unix_timestamp("newest")
    return newest.withColumn("age_seconds", age).withColumn("stale", F.col("age_seconds") > STALE_SECONDS)
