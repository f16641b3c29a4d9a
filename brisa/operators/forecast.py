"""Rule-based forecast and figures about a forecast. The model forecast is a plan of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brisa.functions.calendar import day_name, weekend_flag
from brisa.functions.categories import gauge_fields
from brisa.operators.metrics import regression_metrics
from brisa.schemas import KEY, TIME

DAYS_AHEAD = 3


def forecast_heuristic(latest: DataFrame, base: Column) -> DataFrame:
    """Three days from the latest row of each series.

    A weekend adds 0.2 and a weekday takes 0.1, each day ahead adds 0.1, and the
    result stays between 0.5 and 5. Status and colour follow from the result.
    """
    step = F.col("step")
    value = base + F.when(F.col("is_weekend") == 1, 0.2).otherwise(-0.1) + step * 0.1
    return (
        latest.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(DAYS_AHEAD))))
        .withColumn("date", F.date_add(F.to_date(TIME), step))
        .withColumn("is_weekend", weekend_flag(F.col("date")))
        .withColumn("predicted_aqi", F.least(F.greatest(value, F.lit(0.5)), F.lit(5.0)))
        .withColumn("day", day_name(F.col("date")))
        .withColumns({k: v for k, v in gauge_fields(F.col("predicted_aqi")).items() if k != "score"})
        .select(KEY, "step", "date", "day", "predicted_aqi", "label", "color")
    )


def forecast_kpis(forecast: DataFrame, value: str = "predicted_aqi") -> DataFrame:
    """Mean, direction and peak day of each series' forecast; the earliest of equal peaks."""
    peak = F.struct(F.col(value), -F.col("step"))
    return (
        forecast.groupBy(KEY)
        .agg(
            F.avg(value).alias("mean"),
            F.min_by(value, "step").alias("first"),
            F.max_by(value, "step").alias("last"),
            F.max_by("date", peak).alias("peak_date"),
        )
        .select(
            KEY,
            "mean",
            F.when(F.col("last") < F.col("first"), "Improving").otherwise("Worsening").alias("trend"),
            "peak_date",
            F.substring(day_name(F.col("peak_date")), 1, 3).alias("peak_day"),
        )
    )


def prediction_monitor(predictions: DataFrame, actuals: DataFrame, label: str) -> DataFrame:
    """Error of predictions per day, once the actual values are known."""
    joined = predictions.join(actuals.select(KEY, TIME, F.col(label).alias("label")), [KEY, TIME])
    return regression_metrics(joined, "label", "prediction", [F.to_date(TIME).alias("date")])
