"""CSV copies of readings and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("timestampFormat", TIMESTAMP_FORMAT).csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("timestampFormat", TIMESTAMP_FORMAT).csv(path)
