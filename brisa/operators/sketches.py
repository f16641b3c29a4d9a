"""Approximate quantiles from mergeable sketches, for tables that are too large to be read for every report.

A KLL sketch of a group takes some ten kilobytes whatever the number of rows, is made map-side, and merges without loss of its bound.
Sketches can be made where they are needed (``approximate_quantiles``) or kept per day by the job that adds rows
(``keep_sketches``), so that quantiles over any span of days read days, not rows (``stored_quantiles``). A quantile's rank is
off by at most ``rank_bound`` with 99 % confidence; exact quantiles are in quantiles.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.functions.numeric import without_nan
from brisa.operators.shape import melt
from brisa.schemas import TIME

#: Size parameter of the sketches.
SIZE = 2048
DAY = "date"


def rank_bound(size: int = SIZE) -> float:
    """How far the rank of a quantile can be off, as a share of all rows: the published bound of KLL sketches for the two-sided error."""
    return 2.446 / size**0.9433


def _known(value: Column) -> Column:
    return without_nan(value.cast("double"))


def _quantiles(sketched: DataFrame, groups: list[str], probabilities: list[float]) -> DataFrame:
    ranks = F.array(*[F.lit(float(p)) for p in probabilities])
    pairs = F.arrays_zip(ranks.alias("probability"), F.kll_sketch_get_quantile_double("_sketch", ranks).alias("quantile"))
    return sketched.where("_n > 0").select(*groups, F.inline(pairs).alias("probability", "quantile"))


def approximate_quantiles(
    df: DataFrame, groups: list[str], value: str, probabilities: list[float], size: int = SIZE
) -> DataFrame:
    """(groups, probability, quantile) in one pass; each quantile is a value of the data. Nulls, NaN and rows with a null group are left out."""
    data = df.select(*groups, _known(F.col(value)).alias("_v")).dropna()
    sketched = data.groupBy(*groups).agg(F.kll_sketch_agg_double("_v", size).alias("_sketch"), F.count("_v").alias("_n"))
    return _quantiles(sketched, groups, probabilities)


def approximate_quartiles(df: DataFrame, groups: list[str], value: str, size: int = SIZE) -> DataFrame:
    """(groups, q25, q50, q75)."""
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    found = approximate_quantiles(df, groups, value, list(names), size)
    return found.groupBy(*groups).agg(
        *[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n) for p, n in names.items()]
    )


def day_sketches(df: DataFrame, columns: list[str], size: int = SIZE) -> DataFrame:
    """(date, column, rows, sketch) of every day and column."""
    long = melt(df.withColumn(DAY, F.to_date(TIME)), columns, "column", "value", keep=(DAY,))
    data = long.select(DAY, "column", _known(F.col("value")).alias("_v")).dropna()
    return data.groupBy(DAY, "column").agg(F.count("_v").alias("rows"), F.kll_sketch_agg_double("_v", size).alias("sketch"))


def keep_sketches(df: DataFrame, columns: list[str], path: str, number: int, size: int = SIZE) -> None:
    """Store the sketches of the rows that batch ``number`` adds. A repeat of the batch writes them again."""
    day_sketches(df, columns, size).write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/batch={number}")


def stored_quantiles(
    spark: SparkSession, path: str, probabilities: list[float], days: Column | None = None, size: int = SIZE
) -> DataFrame:
    """(column, probability, quantile) over the stored days, or those for which ``days``, a condition on ``date``, holds."""
    kept = spark.read.parquet(path)
    kept = kept if days is None else kept.where(days)
    merged = kept.groupBy("column").agg(F.kll_merge_agg_double("sketch", size).alias("_sketch"), F.sum("rows").alias("_n"))
    return _quantiles(merged, ["column"], probabilities)


def rank_errors(df: DataFrame, quantiles: DataFrame, columns: list[str]) -> DataFrame:
    """(column, probability, error): how far each quantile's rank in the data is from its probability.

    A value's rank is any share between those of the rows below it and of the rows up to it.
    """
    data = melt(df, columns, "column", "value").select("column", _known(F.col("value")).alias("_v")).dropna()
    asked = quantiles.groupBy("column").agg(F.collect_list(F.struct("probability", "quantile")).alias("_asked"))
    # One row per column is broadcast.
    met = data.groupBy("column", "_v").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(asked), "column")
    shares = met.select("column", "_v", "_n", F.inline("_asked")).groupBy("column", "probability", "quantile").agg(
        F.sum("_n").alias("_all"),
        F.sum(F.when(F.col("_v") < F.col("quantile"), F.col("_n")).otherwise(0)).alias("_below"),
        F.sum(F.when(F.col("_v") <= F.col("quantile"), F.col("_n")).otherwise(0)).alias("_until"),
    )
    p = F.col("probability")
    error = F.greatest(F.lit(0.0), F.col("_below") / F.col("_all") - p, p - F.col("_until") / F.col("_all"))
    return shares.select("column", "probability", error.alias("error"))
