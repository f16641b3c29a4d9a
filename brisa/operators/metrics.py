"""Regression error figures and splits, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brisa.functions.calendar import epoch_hour
from brisa.functions.numeric import varies
from brisa.schemas import KEY, TIME


def regression_metrics(
    df: DataFrame, label: str, prediction: str, by: list[Column] | None = None
) -> DataFrame:
    """n, MAE, RMSE and R² in one pass; R² is null where the label is constant."""
    y, error = F.col(label).cast("double"), F.col(label) - F.col(prediction)
    return (
        df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(*(by or []))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(error)).alias("mae"),
            F.avg(error * error).alias("_mse"),
            F.when(varies(y), F.var_pop(y)).alias("_var"),
        )
        .withColumn("rmse", F.sqrt("_mse"))
        .withColumn("r2", 1 - F.try_divide(F.col("_mse"), F.col("_var")))
        .drop("_mse", "_var")
    )


def series_number() -> Column:
    """The series id as a number; an id that is none counts by its hash."""
    return F.coalesce(F.expr(f"try_cast(`{KEY}` AS bigint)"), F.xxhash64(KEY))


def split_bucket(seed: int = 42) -> Column:
    """0 to 99, from the key alone, so the split does not depend on partitioning."""
    # Each term is reduced first, so no id is too large.
    hundred = F.lit(100)
    hour = F.pmod(epoch_hour(F.col(TIME)), hundred) * (104729 % 100)
    return F.pmod(F.pmod(series_number(), hundred) * (7919 % 100) + hour + seed, hundred)


def train_val_split(df: DataFrame, train_percent: int = 80, seed: int = 42) -> DataFrame:
    """Add ``is_train``."""
    return df.withColumn("is_train", split_bucket(seed) < train_percent)


def temporal_split(df: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Add ``is_train``: hours up to the exact percentile of all hours train.

    The percentile runs over counts per hour, and there are only so many hours
    in the recorded span, so it stays small however many rows there are.
    """
    hour = epoch_hour(F.col(TIME))
    counts = df.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    cut = counts.agg(F.percentile("hour", F.lit(train_share), F.col("n")).alias("cut")).scalar()
    return df.withColumn("is_train", hour <= cut)


def spread(value: Column) -> Column:
    """Aggregate: population deviation to divide by; 1 for a constant column."""
    return F.when(varies(value), F.stddev_pop(value)).otherwise(1.0)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Z-scores with the population deviation; a constant column becomes 0."""
    moments = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[spread(F.col(c)).alias(f"{c}_std") for c in columns],
        ).alias("m")
    ).scalar()
    scaled = {c: (F.col(c) - F.col(f"_m.{c}_mean")) / F.col(f"_m.{c}_std") for c in columns}
    return df.withColumn("_m", moments).withColumns(scaled).drop("_m")
