"""Reshaping, ordering, newest rows and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brisa.functions.numeric import hash_order
from brisa.functions.calendar import epoch_hour
from brisa.schemas import KEY, PROFILE_POLLUTANTS, TIME


def melt(
    df: DataFrame, columns: list[str] = PROFILE_POLLUTANTS, name: str = "pollutant", value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Wide to long; nulls stay as rows."""
    numbers = df.selectExpr(*keep, *[f"double(`{c}`) AS `{c}`" for c in columns])
    return numbers.unpivot(list(keep), columns, name, value)


def order_by_time(df: DataFrame) -> DataFrame:
    """Sorted for output. Windows sort for themselves and need no sorted input."""
    return df.orderBy(TIME, KEY)


def latest_row(df: DataFrame) -> DataFrame:
    """The newest row of each series, by partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c != KEY]
    return (
        df.groupBy(KEY).agg(F.max_by(F.struct(*rest), F.col(TIME)).alias("row")).select(KEY, "row.*").select(df.columns)
    )


def last_n_rows(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of each series; Spark limits each group before the shuffle."""
    newest_first = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
    return (
        df.withColumn("_from_end", F.row_number().over(newest_first))
        .where(F.col("_from_end") <= n)
        .drop("_from_end")
    )


def top_k(df: DataFrame, k: int, by: str, ties: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), ties).limit(k)


def preview_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_order(seed: int = 42) -> Column:
    return hash_order(F.col(KEY), epoch_hour(F.col(TIME)), seed=seed)


def sample_n(df: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``n`` rows in a random order that depends only on keys and seed."""
    return df.orderBy(sample_order(seed), KEY, TIME).limit(n)


def pairwise_points(df: DataFrame, columns: list[str] = PROFILE_POLLUTANTS) -> DataFrame:
    """One row per input row and pair of columns, for scatter plots of a sample."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    points = ", ".join(
        f"named_struct('column_x', '{a}', 'column_y', '{b}', 'x', `{a}`, 'y', `{b}`)" for a, b in pairs
    )
    return df.selectExpr(KEY, TIME, f"inline(array({points}))")
