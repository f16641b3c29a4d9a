"""The feature table, training snapshots and metrics as Parquet folders."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from brisa.operators.upsert import dedup_upsert
from brisa.schemas import FEATURES_SCHEMA, KEY, TARGET, TIME

DATE = "date"


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return [status.getPath().getName() for status in files.listStatus(folder)]


# --- Feature table --------------------------------------------------------


def read_table(spark: SparkSession, path: str, schema: StructType = FEATURES_SCHEMA) -> DataFrame:
    """The stored rows with their ``date`` partition; an empty table where nothing is stored yet."""
    full = StructType([*schema.fields, StructField(DATE, DateType())])
    if not any(name.startswith(f"{DATE}=") for name in children(spark, path)):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """The days that a stored table has, in order."""
    names = (re.fullmatch(rf"{DATE}=(\d{{4}}-\d{{2}}-\d{{2}})", name) for name in children(spark, path))
    return sorted(date.fromisoformat(match.group(1)) for match in names if match)


def append_rows(df: DataFrame, path: str) -> None:
    """Append, partitioned by day. Rebalancing splits a day that is too large for one file."""
    (
        df.withColumn(DATE, F.to_date(TIME))
        .hint("rebalance", DATE)
        .write.partitionBy(DATE)
        .mode("append")
        .parquet(path)
    )


def insert_new(features: DataFrame, path: str) -> None:
    """Append the rows whose key is not stored. Only days of the batch are read from the table."""
    spark = features.sparkSession
    day = F.to_date(TIME)
    days = features.agg(F.struct(F.min(day).alias("first"), F.max(day).alias("last"))).scalar()
    stored = read_table(spark, path, features.schema)
    nearby = stored.where(F.col(DATE).between(days["first"], days["last"]))
    append_rows(dedup_upsert(features, nearby), path)


def between(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows with start <= datetime <= end; also on the day partition where there is one."""
    rows = df.where((F.col(TIME) >= start) & (F.col(TIME) <= end))
    if DATE in df.columns:
        rows = rows.where((F.col(DATE) >= F.to_date(start)) & (F.col(DATE) <= F.to_date(end)))
    return rows


def _end(df: DataFrame, end: Column | None) -> Column:
    """``end``, or the newest time; in a stored table only its newest day is read for that."""
    if end is not None:
        return end
    if DATE in df.columns:
        df = df.where(F.col(DATE) == df.agg(F.max(DATE)).scalar())
    return df.agg(F.max(TIME)).scalar()


def batch_window(df: DataFrame, end: Column | None = None, hours: int = 24) -> DataFrame:
    """The last hours before ``end``, by default before the newest row."""
    end = _end(df, end)
    return between(df, end - F.make_dt_interval(F.lit(0), F.lit(hours)), end)


def history_window(df: DataFrame, days_back: int, end: Column | None = None) -> DataFrame:
    """The last days before ``end``."""
    end = _end(df, end)
    return between(df, end - F.make_dt_interval(F.lit(days_back)), end)


# --- Newest rows ----------------------------------------------------------

REVISION = "revision"


def newest_path(path: str) -> str:
    """Where a feature table's newest rows stand: beside it, so its days are all that lies in it."""
    return f"{path}_newest"


def _newest(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != KEY]
    newest = F.max_by(F.struct(*rest), F.struct(TIME, REVISION))
    return df.groupBy(KEY).agg(newest.alias("row")).select(KEY, "row.*").select(df.columns)


def keep_newest(features: DataFrame, path: str, number: int = 0) -> None:
    """Keep the newest row of each series among rows that a job adds to the feature table at ``path``; ``number`` counts its batches."""
    from brisa.sources import tiers

    if REVISION not in features.columns:
        features = features.withColumn(REVISION, F.lit(0).cast("bigint"))
    tiers.add_run(features, newest_path(path), number, _newest)


def newest_rows(spark: SparkSession, path: str, schema: StructType = FEATURES_SCHEMA) -> DataFrame:
    """The newest row of every series of the feature table at ``path``, also of one that has long been silent.

    Reads a table of one row per series and tier, not the history.
    """
    from brisa.sources import tiers

    full = StructType([*schema.fields, StructField(REVISION, LongType())])
    return tiers.read_runs(spark, newest_path(path), full, _newest).drop(REVISION)


# --- Training snapshots ---------------------------------------------------


def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    names = [re.fullmatch(r"td_version=(\d+)", name) for name in children(spark, path)]
    return sorted(int(match.group(1)) for match in names if match)


def write_snapshot(df: DataFrame, path: str) -> int:
    """Write the next numbered snapshot. A snapshot is never changed afterwards."""
    versions = snapshot_versions(df.sparkSession, path)
    version = (versions[-1] if versions else 0) + 1
    df.write.mode("errorifexists").parquet(f"{path}/td_version={version}")
    return version


def read_snapshot(spark: SparkSession, path: str, version: int | None = None, label: str = TARGET):
    """Features and label of a snapshot, the newest by default."""
    version = version or snapshot_versions(spark, path)[-1]
    data = spark.read.parquet(f"{path}/td_version={version}")
    return data.drop(label), data.select(KEY, TIME, label)


# --- Metrics --------------------------------------------------------------


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The model comparison as JSON and, from that, CSV; it has one row per model."""
    metrics.coalesce(1).write.json(f"{path}/json")
    written = metrics.sparkSession.read.schema(metrics.schema).json(f"{path}/json")
    written.coalesce(1).write.option("header", True).csv(f"{path}/csv")
