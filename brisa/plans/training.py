"""Training, comparison and use of the three regressors on distributed data."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brisa.functions.categories import status_fields
from brisa.functions.numeric import to_published
from brisa.operators.features import align_features
from brisa.operators.metrics import regression_metrics, spread, train_val_split
from brisa.operators.shape import latest_row
from brisa.plans import trees
from brisa.schemas import KEY, MODEL_FEATURES, TARGET, TIME
from brisa.session import enable_checkpoints

LABEL = "label"
PREDICTION = "prediction"


@dataclass(frozen=True)
class ModelSettings:
    """The reference sizes of the three models."""

    ridge_alpha: float = 1.0
    forest_trees: int = 200
    forest_depth: int = 12
    forest_min_leaf: int = 2
    boosting_rounds: int = 200
    boosting_depth: int = 5
    boosting_rate: float = 0.05
    boosting_subsample: float = 0.8
    max_bins: int = 64
    seed: int = 42
    # Fewest partitions of the training rows, and the rows that a partition has at most, by the mean; the number
    # follows from these and the number of rows alone, and samples, so trees, depend on it.
    partitions: int = 8
    rows_per_partition: int = 250_000
    # The scaler of the original run had also seen the validation rows.
    scale_on_all_rows: bool = False


def model_input(features: DataFrame, names: list[str] = MODEL_FEATURES) -> DataFrame:
    """Key, time, label and the ordered model inputs; an absent input is 0."""
    return align_features(
        features.withColumn(LABEL, F.col(TARGET).cast("double")), names, keep=[KEY, TIME, LABEL]
    )


def scaled(name: str) -> str:
    return f"{name}_z"


def _scaling_stage(moments, names: list[str]) -> SQLTransformer:
    """Z-scores with the population deviation; a constant input becomes 0."""
    terms = []
    for name in names:
        mean, deviation = moments[f"{name}_mean"], moments[f"{name}_std"]
        terms.append(f"(`{name}` - {mean!r}D) / {deviation!r}D AS `{scaled(name)}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def fit_model(train: DataFrame, regressor, moments, names: list[str] = MODEL_FEATURES) -> PipelineModel:
    scaling, inputs = _scaling_stage(moments, names), [scaled(n) for n in names]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    if isinstance(regressor, (RandomForestRegressor, GBTRegressor)):
        return PipelineModel([scaling, assembler, trees.fit(scaling.transform(train), regressor, inputs)])
    return Pipeline(stages=[scaling, assembler, regressor]).fit(train)


def regressors(settings: ModelSettings, label_deviation: float, rows: int) -> dict:
    common = {"featuresCol": "features", "labelCol": LABEL, "predictionCol": PREDICTION}
    of_trees = {"maxBins": settings.max_bins, "seed": settings.seed, "checkpointInterval": 10}
    return {
        # The solver works on a label of deviation one and on mean errors.
        "ridge": LinearRegression(
            solver="normal",
            standardization=False,
            elasticNetParam=0.0,
            regParam=settings.ridge_alpha * label_deviation / rows,
            **common,
        ),
        "random_forest": RandomForestRegressor(
            numTrees=settings.forest_trees,
            maxDepth=settings.forest_depth,
            minInstancesPerNode=settings.forest_min_leaf,
            featureSubsetStrategy="all",
            **of_trees,
            **common,
        ),
        "gradient_boosting": GBTRegressor(
            maxIter=settings.boosting_rounds,
            maxDepth=settings.boosting_depth,
            stepSize=settings.boosting_rate,
            subsamplingRate=settings.boosting_subsample,
            **of_trees,
            **common,
        ),
    }


def training_partitions(settings: ModelSettings, rows: int) -> int:
    """So many that what one task reads does not grow with the rows; every partition sends on the figures of all open nodes, so not more."""
    return max(settings.partitions, math.ceil(rows / settings.rows_per_partition))


def train_models(
    data: DataFrame,
    settings: ModelSettings = ModelSettings(),
    only: tuple[str, ...] = ("ridge", "random_forest", "gradient_boosting"),
    names: list[str] = MODEL_FEATURES,
) -> dict[str, PipelineModel]:
    """Fit the models on the rows with ``is_train``.

    The driver sees two moments per input; the rows stay on the executors.
    """
    enable_checkpoints(data.sparkSession)
    train = data.where("is_train").drop("is_train")
    base = data if settings.scale_on_all_rows else train
    moments = base.agg(
        *[F.avg(n).alias(f"{n}_mean") for n in names],
        *[spread(F.col(n)).alias(f"{n}_std") for n in names],
    ).first()
    size = train.agg(F.count(LABEL).alias("n"), F.stddev_pop(LABEL).alias("sd")).first()
    if not size["n"]:
        raise ValueError("no training rows with a label")
    chosen = regressors(settings, size["sd"], size["n"])
    # Samples of rows are drawn per partition, so the rows of each follow from keys and settings alone.
    parts = training_partitions(settings, size["n"])
    train = train.repartition(parts, KEY, TIME).sortWithinPartitions(KEY, TIME).persist()
    models = {name: fit_model(train, chosen[name], moments, names) for name in only}
    train.unpersist()
    return models


class MarginalModel:
    """Every input's own ridge fit, averaged: what the fitted models offer to predictions and explanations, in closed form.

    The weight of a scaled input z is sum(z y) / (n + alpha) over the training rows, divided by the number of inputs.
    """

    def __init__(self, coefficients: list[float], intercept: float, moments: dict, names: list[str]):
        self.coefficients, self.intercept, self.names = DenseVector(coefficients), intercept, names
        self.stages = [_scaling_stage(moments, names), self]

    def transform(self, df: DataFrame) -> DataFrame:
        terms = [f"{float(w)!r}D * `{scaled(n)}`" for w, n in zip(self.coefficients, self.names)]
        return self.stages[0].transform(df).withColumn(PREDICTION, F.expr(" + ".join([f"{self.intercept!r}D", *terms])))


def fit_marginal(data: DataFrame, alpha: float = 1.0, names: list[str] = MODEL_FEATURES) -> MarginalModel:
    """One aggregate over the training rows; the driver sees three numbers per input."""
    train = data.where(F.col("is_train") & F.col(LABEL).isNotNull())
    row = train.agg(
        F.count(LABEL).alias("n"),
        F.avg(LABEL).alias("mean"),
        *[F.avg(n).alias(f"{n}_mean") for n in names],
        *[spread(F.col(n)).alias(f"{n}_std") for n in names],
        *[F.covar_pop(F.col(n), F.col(LABEL)).alias(f"{n}_cov") for n in names],
    ).first()
    if not row["n"]:
        raise ValueError("no training rows with a label")
    scale = row["n"] / (row["n"] + alpha) / len(names)
    return MarginalModel([row[f"{n}_cov"] / row[f"{n}_std"] * scale for n in names], row["mean"], row.asDict(), names)


def ridge_gradient(model: PipelineModel, data: DataFrame, alpha: float = 1.0, names: list[str] = MODEL_FEATURES) -> DataFrame:
    """(feature, gradient): the normal equations of a ridge fit, per training row; all 0 at the fitted weights."""
    last = model.stages[-1]
    scored = model.transform(data.where("is_train"))
    error = F.col(LABEL) - F.col(PREDICTION)
    n = F.count(LABEL)
    parts = [
        F.struct(F.lit(name).alias("feature"), ((F.sum(F.col(scaled(name)) * error) - alpha * float(w)) / n).alias("gradient"))
        for name, w in zip(names, last.coefficients)
    ]
    parts.append(F.struct(F.lit("intercept").alias("feature"), (F.sum(error) / n).alias("gradient")))
    return scored.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def model_comparison(models: dict[str, PipelineModel], data: DataFrame) -> DataFrame:
    """One row per model: MAE, RMSE and R² on training and validation rows."""
    return compare_predictions({name: model.transform(data) for name, model in models.items()})


def compare_predictions(predictions: dict[str, DataFrame]) -> DataFrame:
    """The same for predictions made elsewhere: per model, rows with label, prediction and ``is_train``."""
    rows = None
    for name, predicted in predictions.items():
        scored = regression_metrics(predicted, LABEL, PREDICTION, [F.col("is_train")])
        pick = lambda metric, train: F.max(F.when(F.col("is_train") == F.lit(train), F.col(metric)))
        row = scored.agg(
            *[
                pick(metric, train).alias(f"{prefix}_{metric}")
                for metric in ("mae", "rmse", "r2")
                for prefix, train in (("train", True), ("val", False))
            ]
        ).select(F.lit(name).alias("model"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def best_model(comparison: DataFrame) -> DataFrame:
    """The row with the highest validation R²."""
    row = F.max_by(F.struct(*comparison.columns), "val_r2").alias("best")
    return comparison.agg(row).select("best.*")


def overfit_gap(comparison: DataFrame) -> DataFrame:
    return comparison.select("model", "train_r2", "val_r2", (F.col("train_r2") - F.col("val_r2")).alias("gap"))


def error_reduction(comparison: DataFrame) -> DataFrame:
    """How much smaller the winner's errors are than each other model's, in percent."""
    best = best_model(comparison).select(F.struct("model", "val_rmse", "val_mae", "val_r2").alias("b"))
    means = comparison.agg(F.avg("val_rmse").alias("mean_rmse"))
    smaller = lambda winner, other: 100 * (1 - F.try_divide(F.col(winner), F.col(other)))
    return (
        comparison.withColumn("b", best.scalar())
        .withColumn("mean_rmse", means.scalar())
        .where(F.col("model") != F.col("b.model"))
        .select(
            F.col("b.model").alias("winner"),
            F.col("model").alias("other"),
            smaller("b.val_rmse", "val_rmse").alias("rmse_reduction"),
            smaller("b.val_mae", "val_mae").alias("mae_reduction"),
            ((F.col("b.val_r2") - F.col("val_r2")) * 100).alias("r2_lead"),
            smaller("b.val_rmse", "mean_rmse").alias("rmse_below_mean"),
        )
    )


def registered_metrics(comparison: DataFrame, model: str | None = None) -> DataFrame:
    """Validation metrics stored with the chosen model, by default the best one."""
    chosen = best_model(comparison) if model is None else comparison.where(F.col("model") == model)
    return chosen.select(
        "model", F.col("val_r2").alias("r2"), F.col("val_rmse").alias("rmse"), F.col("val_mae").alias("mae")
    )


# --- Use of a model -------------------------------------------------------


def batch_predict(model: PipelineModel, features: DataFrame, parity: bool = False) -> DataFrame:
    """Prediction and status of the newest row of every series, in one job.

    The status is that of the published 1-5 value. With ``parity`` it is that of
    the 0-4 value, as the original service did.
    """
    scored = model.transform(model_input(latest_row(features)))
    published = to_published(F.col(PREDICTION))
    fields = status_fields(F.col(PREDICTION) if parity else published)
    return scored.select(
        KEY, TIME, F.round(published, 2).alias(PREDICTION), *[c.alias(n) for n, c in fields.items()]
    )


def _calendar_at_noon(day: Column) -> dict[str, Column]:
    number = lambda c: c.cast("double")
    return {
        "hour": F.lit(12.0),
        "day": number(F.dayofmonth(day)),
        "day_of_week": number(F.weekday(day)),
        "month": number(F.month(day)),
        "is_weekend": number(F.weekday(day) >= 5),
    }


def _forecast_steps(
    model: PipelineModel, features: DataFrame, feedback, days: int = 3
) -> DataFrame:
    """(series, step, date, prediction on the 0-4 scale) for noon of the next days.

    The days are one chain of transforms over all series at once. ``feedback``
    says which values the prediction of a day puts into the next day's inputs.
    """
    inputs = model_input(latest_row(features))
    rows = inputs
    for step in range(1, days + 1):
        day = F.date_add(F.to_date(TIME), step)
        carried = [c for c in rows.columns if c.startswith("_p")]
        scored = model.transform(rows.withColumns(_calendar_at_noon(day)))
        kept = scored.select(*inputs.columns, *carried, F.col(PREDICTION).alias(f"_p{step}"))
        rows = kept.withColumns(feedback(step, F.col(f"_p{step}")))
    steps = F.array(
        *[
            F.struct(
                F.lit(step).alias("step"),
                F.date_add(F.to_date(TIME), step).alias("date"),
                F.col(f"_p{step}").alias(PREDICTION),
            )
            for step in range(1, days + 1)
        ]
    )
    return rows.select(KEY, F.inline(steps))


def _rolling_feedback(value: Column, change: Column) -> dict[str, Column]:
    return {
        "rolling_aqi_3h": value,
        "rolling_aqi_6h": value,
        "rolling_aqi_24h": value,
        "aqi_change_rate": change,
    }


def forecast_3_days(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Each day's prediction becomes the next day's rolling means; the change is to the last actual value."""
    feedback = lambda step, p: _rolling_feedback(p, p - F.col(LABEL))
    forecast = _forecast_steps(model, features, feedback)
    return forecast.select(KEY, "step", "date", F.round(PREDICTION, 2).alias("predicted_aqi"))


def forecast_api_variant(model: PipelineModel, features: DataFrame, parity: bool = False) -> DataFrame:
    """Forecast on the published scale with day name and status.

    With ``parity`` the published value itself is fed back, and the change is
    that to its own rounded value, as the original service did.
    """

    def feedback(step: int, p: Column) -> dict[str, Column]:
        if not parity:
            return _rolling_feedback(p, p - F.col(LABEL))
        published = to_published(p)
        change = F.lit(0.0) if step == 1 else published - F.round(published, 2)
        return _rolling_feedback(published, change)

    published = to_published(F.col(PREDICTION))
    forecast = _forecast_steps(model, features, feedback)
    fields = {n: c for n, c in status_fields(published).items() if n != "recommendations"}
    return forecast.select(
        KEY,
        "step",
        "date",
        F.date_format("date", "EEEE").alias("day"),
        F.round(published, 2).alias(PREDICTION),
        *[c.alias(n) for n, c in fields.items()],
    )


def prepare_training(features: DataFrame, names: list[str] = MODEL_FEATURES) -> DataFrame:
    """Model inputs with the 80/20 split by key."""
    return train_val_split(model_input(features, names))
