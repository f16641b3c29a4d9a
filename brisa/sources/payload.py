"""Nested weather payloads to readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.functions.numeric import to_stored, without_nan
from brisa.schemas import KEY, PAYLOAD_SCHEMA, POLLUTANTS, TARGET, TIME


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """JSON payloads, one per line, with a fixed schema."""
    return spark.read.schema(PAYLOAD_SCHEMA).json(path)


def parse_payloads(texts: DataFrame, text: str = "value") -> DataFrame:
    """The same from a column of JSON text."""
    return texts.select(F.from_json(F.col(text), PAYLOAD_SCHEMA).alias("payload")).select("payload.*")


def _failed() -> Column:
    reported = F.col("cod").isNotNull() & (F.col("cod") != "") & (F.col("cod") != "200")
    return reported | F.col("list").isNull()


def payload_errors(payloads: DataFrame) -> DataFrame:
    """Payloads that report an error or hold no list, set aside instead of replaced."""
    return payloads.where(_failed()).select(
        KEY, "cod", F.coalesce("message", F.lit("Unknown error")).alias("message")
    )


def _reading(entry: Column) -> list[Column]:
    component = lambda name: F.coalesce(without_nan(entry["components"][name]), F.lit(0.0))
    return [
        F.timestamp_seconds(entry["dt"]).alias(TIME),
        to_stored(entry["main"]["aqi"]).cast("double").alias(TARGET),
        *[component(name).alias(name) for name in POLLUTANTS],
    ]


def payload_explode(payloads: DataFrame) -> DataFrame:
    """All readings of good payloads. A missing component is 0; aqi moves to the 0-4 scale."""
    entries = payloads.where(~_failed()).select(KEY, F.explode("list").alias("entry"))
    return entries.select(KEY, *_reading(F.col("entry")))


def payload_current(payloads: DataFrame) -> DataFrame:
    """Only the first reading of each good payload."""
    first = payloads.where(~_failed() & (F.size("list") > 0)).select(KEY, F.element_at("list", 1).alias("entry"))
    return first.select(KEY, *_reading(F.col("entry")))


def to_payloads(readings: DataFrame, entries_per_payload_hours: int = 24) -> DataFrame:
    """Readings as payload rows, one per series and day: what a collector would have stored."""
    entry = F.struct(
        F.unix_timestamp(TIME).alias("dt"),
        F.struct((F.col(TARGET) + 1).cast("int").alias("aqi")).alias("main"),
        F.struct(*[F.col(c).cast("double").alias(c) for c in POLLUTANTS]).alias("components"),
    )
    block = F.floor(F.unix_timestamp(TIME) / (3600 * entries_per_payload_hours))
    return (
        readings.groupBy(KEY, block.alias("block"))
        .agg(F.sort_array(F.collect_list(entry)).alias("list"))
        .select(KEY, F.lit("200").alias("cod"), F.lit(None).cast("string").alias("message"), "list")
    )
