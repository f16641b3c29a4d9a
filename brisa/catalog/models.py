"""Splits, scaling, the three regressors, their comparison, forecasts and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brisa.catalog import sql as S
from brisa.catalog.advisories import HEURISTIC_SQL, heuristic
from brisa.catalog.registry import once, query
from brisa.catalog.sources import feature_table, newest_features
from brisa.functions import categories as C
from brisa.functions.calendar import weekend_flag
from brisa.operators import metrics
from brisa.operators.forecast import prediction_monitor
from brisa.operators.windows import rolling_means
from brisa.plans import attribution, explain, training
from brisa.plans.readings import readings
from brisa.schemas import KEY, MODEL_FEATURES, TARGET, TIME
from brisa.session import new_dir
from brisa.sources import store

SIZES = training.ModelSettings()


# --- Scaling and splits ---------------------------------------------------


def _z(c: str) -> str:
    deviation = f"stddev_pop({c}) OVER ()"
    return S.r6(f"({c} - avg({c}) OVER ()) / CASE WHEN {deviation} = 0 THEN 1.0 ELSE {deviation} END") + f" AS {c}"


@query(
    "standard_scale",
    f"""{S.FT}, x AS (SELECT series_id, datetime, {", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in MODEL_FEATURES)}
          FROM f)
        SELECT series_id, datetime, {", ".join(_z(c) for c in MODEL_FEATURES)} FROM x""",
)
def _(spark, folder):
    inputs = training.model_input(feature_table(spark, folder)).drop(training.LABEL)
    return metrics.standard_scale(inputs, MODEL_FEATURES)


@query(
    "train_val_split",
    f"""{S.R} SELECT series_id, datetime,
        (series_id * 7919 + (epoch(datetime) // 3600)::BIGINT * 104729 + 42) % 100 < 80 AS is_train FROM r""",
)
def _(spark, folder):
    return metrics.train_val_split(readings(spark, folder).select(KEY, TIME))


@query(
    "temporal_split",
    f"""{S.R} SELECT series_id, datetime,
        epoch(datetime) <= (SELECT quantile_cont(epoch(datetime), 0.8) FROM r) AS is_train FROM r""",
)
def _(spark, folder):
    return metrics.temporal_split(readings(spark, folder).select(KEY, TIME))


_ERRORS = f"""count(*) AS n, {S.r6("avg(abs(y - p))")} AS mae, {S.r6("sqrt(avg((y - p) * (y - p)))")} AS rmse,
  {S.r6("1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0)")} AS r2"""


@query(
    "regression_metrics",
    f"""{S.R}, x AS (SELECT aqi AS y, avg(aqi) OVER {S.rows(3)} AS p,
          (series_id * 7919 + (epoch(datetime) // 3600)::BIGINT * 104729 + 42) % 100 < 80 AS is_train FROM r)
        SELECT is_train, {_ERRORS} FROM x GROUP BY is_train""",
)
def _(spark, folder):
    smoothed = rolling_means(readings(spark, folder).select(KEY, TIME, TARGET), {"prediction": 3})
    split = metrics.train_val_split(smoothed)
    return metrics.regression_metrics(split, TARGET, "prediction", [F.col("is_train")])


# --- Training -------------------------------------------------------------


def training_data(spark: SparkSession, folder: str) -> DataFrame:
    """Model inputs of a stored snapshot, with the split."""

    def write() -> str:
        path = new_dir(spark, "training")
        store.write_snapshot(training.prepare_training(feature_table(spark, folder)), path)
        return path

    return spark.read.parquet(f"{once(spark, folder, 'snapshot', write)}/td_version=1")


def model(spark: SparkSession, folder: str, name: str):
    fit = lambda: training.train_models(training_data(spark, folder), SIZES, only=(name,))[name]
    return once(spark, folder, name, fit)


def comparison(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    names = names or ("ridge", "random_forest", "gradient_boosting")
    models = {name: model(spark, folder, name) for name in names}
    rows = training.model_comparison(models, training_data(spark, folder))
    # A row per model, stored: what reads it several times would score all rows with all models each time.
    path = new_dir(spark, "comparison")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def best(spark: SparkSession, folder: str):
    name = lambda: training.best_model(comparison(spark, folder)).first()["model"]
    return model(spark, folder, once(spark, folder, "best", name))


@query("train_ridge")
def _(spark, folder):
    return comparison(spark, folder, "ridge")


@query("train_random_forest")
def _(spark, folder):
    return comparison(spark, folder, "random_forest")


@query("train_gbt")
def _(spark, folder):
    return comparison(spark, folder, "gradient_boosting")


@query("model_comparison")
def _(spark, folder):
    return comparison(spark, folder)


@query("metrics_sink")
def _(spark, folder):
    path = new_dir(spark, "metrics")
    rows = comparison(spark, folder)
    store.write_metrics(rows, path)
    return spark.read.schema(rows.schema).json(f"{path}/json")


@query("best_model")
def _(spark, folder):
    return training.best_model(comparison(spark, folder))


@query("overfit_gap")
def _(spark, folder):
    return training.overfit_gap(comparison(spark, folder))


@query("error_reduction")
def _(spark, folder):
    return training.error_reduction(comparison(spark, folder))


@query("registered_metrics")
def _(spark, folder):
    return training.registered_metrics(comparison(spark, folder))


# --- The same figures for three fixed rules in the models' place ----------

RULES = {"shrunk": "0.9 * aqi + 0.2", "mixed": "0.5 * aqi + 0.01 * o3", "scaled": "pm2_5 / 30.0"}


def _rule_sql() -> str:
    def row(name: str, rule: str) -> str:
        part = f"SELECT aqi AS y, {rule}::DOUBLE AS p FROM s WHERE is_train"
        figures = {
            "mae": "avg(abs(y - p))", "rmse": "sqrt(avg((y - p) * (y - p)))",
            "r2": "1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0)",
        }
        columns = ", ".join(
            f"(SELECT {figure} FROM ({part} = {train})) AS {prefix}_{metric}"
            for metric, figure in figures.items()
            for prefix, train in (("train", "true"), ("val", "false"))
        )
        return f"SELECT '{name}' AS model, {columns}"

    split = "(series_id * 7919 + (epoch(datetime) // 3600)::BIGINT * 104729 + 42) % 100 < 80 AS is_train"
    rows = " UNION ALL ".join(row(name, rule) for name, rule in RULES.items())
    return f"{S.R}, s AS (SELECT *, {split} FROM r), c AS ({rows}), b AS (SELECT * FROM c ORDER BY val_r2 DESC LIMIT 1)"


_RULES = _rule_sql()
_FIGURES = ["train_mae", "val_mae", "train_rmse", "val_rmse", "train_r2", "val_r2"]
_ROUNDED = "model, " + ", ".join(f"{S.r6(c)} AS {c}" for c in _FIGURES)


def rule_comparison(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.train_val_split(readings(spark, folder)).withColumn(training.LABEL, F.col(TARGET))
    return training.compare_predictions(
        {name: rows.withColumn(training.PREDICTION, F.expr(rule).cast("double")) for name, rule in RULES.items()}
    )


@query("rule_comparison", f"{_RULES} SELECT {_ROUNDED} FROM c")
def _(spark, folder):
    return rule_comparison(spark, folder)


@query("rule_metrics_sink", f"{_RULES} SELECT {_ROUNDED} FROM c")
def _(spark, folder):
    path = new_dir(spark, "metrics")
    rows = rule_comparison(spark, folder)
    store.write_metrics(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(f"{path}/csv")


@query("best_rule", f"{_RULES} SELECT {_ROUNDED} FROM b")
def _(spark, folder):
    return training.best_model(rule_comparison(spark, folder))


@query(
    "rule_overfit_gap",
    f"""{_RULES} SELECT model, {S.r6("train_r2")} AS train_r2, {S.r6("val_r2")} AS val_r2,
        {S.r6("train_r2 - val_r2")} AS gap FROM c""",
)
def _(spark, folder):
    return training.overfit_gap(rule_comparison(spark, folder))


@query(
    "rule_error_reduction",
    f"""{_RULES} SELECT b.model AS winner, c.model AS other,
          {S.r6("100 * (1 - b.val_rmse / c.val_rmse)")} AS rmse_reduction,
          {S.r6("100 * (1 - b.val_mae / c.val_mae)")} AS mae_reduction,
          {S.r6("(b.val_r2 - c.val_r2) * 100")} AS r2_lead,
          {S.r6("100 * (1 - b.val_rmse / (SELECT avg(val_rmse) FROM c))")} AS rmse_below_mean
        FROM c, b WHERE c.model <> b.model""",
)
def _(spark, folder):
    return training.error_reduction(rule_comparison(spark, folder))


@query(
    "rule_registered_metrics",
    f"{_RULES} SELECT model, {S.r6('val_r2')} AS r2, {S.r6('val_rmse')} AS rmse, {S.r6('val_mae')} AS mae FROM b",
)
def _(spark, folder):
    return training.registered_metrics(rule_comparison(spark, folder))


# --- Explanations ---------------------------------------------------------


@query("feature_importance")
def _(spark, folder):
    return explain.feature_importance(best(spark, folder), training_data(spark, folder))


@query("top_k_features")
def _(spark, folder):
    return explain.top_features(explain.feature_importance(best(spark, folder), training_data(spark, folder)))


@query("feature_impact")
def _(spark, folder):
    importances = explain.feature_importance(best(spark, folder), training_data(spark, folder))
    return explain.feature_impact(newest_features(spark, folder), importances)


@query("linear_contributions")
def _(spark, folder):
    rows = explain.linear_contributions(model(spark, folder, "ridge"), training_data(spark, folder))
    return explain.mean_contributions(rows)


@query("permutation_importance")
def _(spark, folder):
    return explain.permutation_importance(best(spark, folder), training_data(spark, folder))


@query("tree_contributions")
def _(spark, folder):
    """Mean absolute Shapley value of every input in the boosted model."""
    boosted = model(spark, folder, "gradient_boosting")
    rows, _ = attribution.tree_contributions(boosted, training_data(spark, folder))
    return explain.mean_contributions(rows)


@query("ridge_normal_equations", S.union_all(f"SELECT '{c}' AS feature, 0.0::DOUBLE AS gradient" for c in [*MODEL_FEATURES, "intercept"]))
def _(spark, folder):
    """The fitted ridge solves its normal equations over all training rows, to four digits: some inputs nearly repeat others."""
    gradient = training.ridge_gradient(model(spark, folder, "ridge"), training_data(spark, folder), SIZES.ridge_alpha)
    return gradient.withColumn("gradient", F.round("gradient", 4))


# --- Predictions ----------------------------------------------------------


@query("batch_predict")
def _(spark, folder):
    return training.batch_predict(best(spark, folder), newest_features(spark, folder))


@query("forecast_3_days")
def forecast_3_days(spark, folder):
    return training.forecast_3_days(best(spark, folder), newest_features(spark, folder))


@query("forecast_api_variant")
def _(spark, folder):
    return training.forecast_api_variant(best(spark, folder), newest_features(spark, folder))


# --- The same with a model in closed form, which SQL can express ------------


def marginal(spark: SparkSession, folder: str) -> training.MarginalModel:
    return once(spark, folder, "marginal", lambda: training.fit_marginal(training_data(spark, folder)))


_SPLIT = "(series_id * 7919 + (epoch(datetime) // 3600)::BIGINT * 104729 + 42) % 100 < 80"
_LIMITS = {c: f"CASE WHEN min({c}) < max({c}) THEN stddev_pop({c}) ELSE 1.0 END" for c in MODEL_FEATURES}
_MARGINAL = f"""{S.FT}, x AS (SELECT series_id, datetime, aqi::DOUBLE AS label, {_SPLIT} AS is_train,
    {", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in MODEL_FEATURES)} FROM f),
  m AS (SELECT avg(label) AS b, {", ".join(f"avg({c}) AS m_{c}, {_LIMITS[c]} AS d_{c}" for c in MODEL_FEATURES)},
    {", ".join(f"covar_pop({c}, label) / ({_LIMITS[c]}) * count(*) / (count(*) + 1) / {len(MODEL_FEATURES)} AS w_{c}" for c in MODEL_FEATURES)}
    FROM x WHERE is_train),
  i AS ({S.union_all(f"SELECT '{c}' AS feature, abs(w_{c}) AS importance FROM m" for c in MODEL_FEATURES)}),
  k AS (SELECT *, importance / sum(importance) OVER () * 100 AS importance_percent,
    CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM i),
  l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) = 1)"""
_IMPORTANCE = f"SELECT feature, {S.r6('importance')} AS importance, {S.r6('importance_percent')} AS importance_percent, rank FROM k"


def _scored(inputs: dict[str, str] | None = None) -> str:
    """SQL of the model's prediction, with some inputs replaced."""
    inputs = inputs or {}
    return "(b + " + " + ".join(f"w_{c} * ({inputs.get(c, c)} - m_{c}) / d_{c}" for c in MODEL_FEATURES) + ")"


@query("marginal_importance", f"{_MARGINAL} {_IMPORTANCE}")
def _(spark, folder):
    return explain.feature_importance(marginal(spark, folder), training_data(spark, folder))


@query("marginal_top_features", f"{_MARGINAL} {_IMPORTANCE} WHERE rank <= 10")
def _(spark, folder):
    return explain.top_features(explain.feature_importance(marginal(spark, folder), training_data(spark, folder)))


@query(
    "marginal_impact",
    f"""{_MARGINAL}, v AS ({S.union_all(f"SELECT series_id, '{c}' AS feature, {c} AS current_value FROM l" for c in MODEL_FEATURES)})
        SELECT series_id, feature, {S.r6("current_value")} AS current_value, CASE WHEN rank <= 5 THEN 'High' ELSE 'Medium' END AS impact
        FROM v JOIN k USING (feature)""",
)
def _(spark, folder):
    importances = explain.feature_importance(marginal(spark, folder), training_data(spark, folder))
    return explain.feature_impact(newest_features(spark, folder), importances)


@query(
    "marginal_contributions",
    f"""{_MARGINAL}, a AS (SELECT {", ".join(f"avg({c}) AS a_{c}" for c in MODEL_FEATURES)} FROM x)
        {S.union_all(f"SELECT '{c}' AS feature, {S.r6(f'avg(abs(w_{c} * ({c} - a_{c}) / d_{c}))')} AS mean_abs_contribution FROM x, m, a" for c in MODEL_FEATURES)}""",
)
def _(spark, folder):
    return explain.mean_contributions(explain.linear_contributions(marginal(spark, folder), training_data(spark, folder)))


_PRIME = 2147483647
_ORDER = f"""((((7 + (series_id % {_PRIME}) * 7919 + ((epoch(datetime) // 3600)::BIGINT % {_PRIME}) * 104729) % {_PRIME})::HUGEINT
    * 1103515245 + 12345) % {_PRIME})::BIGINT"""
_R2 = "1 - avg((label - p) * (label - p)) / nullif(var_pop(label), 0)"


@query(
    "marginal_permutation",
    f"""{_MARGINAL}, o AS (SELECT *, {_ORDER} AS o FROM x),
        u AS (SELECT *, o % greatest(ceil((SELECT count(*) FROM x) / {explain.ROWS_PER_BUCKET}), 1)::BIGINT AS u FROM o),
        s AS (SELECT *, {", ".join(
            f"coalesce(lag({c}) OVER z, last({c}) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS o_{c}" for c in MODEL_FEATURES
        )} FROM u WINDOW z AS (PARTITION BY u ORDER BY o, series_id, datetime)),
        n AS (SELECT {_R2} AS r2 FROM (SELECT label, {_scored()} AS p FROM x, m))
        {S.union_all(f"""SELECT '{c}' AS feature, {S.r6("any_value(n.r2)")} AS baseline_r2, {S.r6(f"any_value(n.r2) - ({_R2})")} AS r2_loss
          FROM (SELECT label, {_scored({c: f"o_{c}"})} AS p FROM s, m), n""" for c in MODEL_FEATURES)}""",
)
def _(spark, folder):
    return explain.permutation_importance(marginal(spark, folder), training_data(spark, folder))


@query(
    "marginal_predict",
    f"""{_MARGINAL}, p AS (SELECT series_id, datetime, {_scored()} + 1 AS value FROM l, m)
        SELECT series_id, datetime, {S.r6("round(value, 2)")} AS prediction, {S.fields("value", C.STATUS)} FROM p""",
)
def _(spark, folder):
    return training.batch_predict(marginal(spark, folder), newest_features(spark, folder))


def _forecast_sql(columns: str) -> str:
    """Three days in turn: calendar of the day at noon, and the last prediction in place of the means."""
    steps, before = [], None
    for step in (1, 2, 3):
        day = f"(CAST(datetime AS DATE) + {step})"
        inputs = {
            "hour": "12", "day": f"day({day})", "day_of_week": f"(isodow({day}) - 1)", "month": f"month({day})",
            "is_weekend": f"(isodow({day}) >= 6)::INTEGER",
        }
        if before:
            inputs |= dict.fromkeys(("rolling_aqi_3h", "rolling_aqi_6h", "rolling_aqi_24h"), before)
            inputs["aqi_change_rate"] = f"({before} - label)"
        source = f"p{step - 1}" if before else "l, m"
        steps.append(f"p{step} AS (SELECT *, {_scored(inputs)} AS v{step} FROM {source})")
        before = f"v{step}"
    rows = S.union_all(f"SELECT series_id, {i} AS step, CAST(datetime AS DATE) + {i} AS d, v{i} AS v, v{i} + 1 AS value FROM p3" for i in (1, 2, 3))
    return f"{_MARGINAL}, {', '.join(steps)}, r3 AS ({rows}) SELECT series_id, step, strftime(d, '%Y-%m-%d') AS date, {columns} FROM r3"


@query("marginal_forecast", _forecast_sql(f"{S.r6('round(v, 2)')} AS predicted_aqi"))
def _(spark, folder):
    return training.forecast_3_days(marginal(spark, folder), newest_features(spark, folder))


@query(
    "marginal_forecast_api",
    _forecast_sql(
        f"dayname(d) AS day, {S.r6('round(value, 2)')} AS prediction, {S.fields('value', C.STATUS, [n for n in C.STATUS[0] if n != 'recommendations'])}"
    ),
)
def _(spark, folder):
    return training.forecast_api_variant(marginal(spark, folder), newest_features(spark, folder))


@query(
    "forecast_heuristic",
    f"""{HEURISTIC_SQL} SELECT series_id, step, strftime(d, '%Y-%m-%d') AS date, dayname(d) AS day,
        predicted_aqi + 0.0 AS predicted_aqi, {S.fields("predicted_aqi", C.GAUGE, ["label", "color"])} FROM p""",
)
def _(spark, folder):
    forecast = heuristic(spark, folder).drop("label", "color")
    fields = C.gauge_fields(F.col("predicted_aqi"))
    return forecast.withColumns({name: fields[name] for name in ("label", "color")})


@query(
    "prediction_monitor",
    f"""{S.R}, p AS (SELECT series_id, datetime + INTERVAL 1 DAY AS datetime, least(greatest(aqi + 1
            + CASE WHEN isodow(datetime + INTERVAL 1 DAY) >= 6 THEN 0.2::DOUBLE ELSE -0.1::DOUBLE END + 0.1::DOUBLE,
            0.5::DOUBLE), 5.0::DOUBLE) AS p FROM r),
          j AS (SELECT p.datetime, p.p, r.aqi + 1 AS y FROM p JOIN r USING (series_id, datetime))
        SELECT strftime(datetime, '%Y-%m-%d') AS date, {_ERRORS} FROM j GROUP BY 1""",
)
def _(spark, folder):
    """Each hour's rule-based prediction for the same hour of the next day, against what came."""
    actuals = readings(spark, folder).select(KEY, TIME, (F.col(TARGET) + 1).alias("value"))
    value = F.col("value") + F.when(weekend_flag(F.col(TIME)) == 1, 0.2).otherwise(-0.1) + 0.1
    predictions = actuals.withColumn(TIME, F.col(TIME) + F.expr("INTERVAL 1 DAY")).select(
        KEY, TIME, F.least(F.greatest(value, F.lit(0.5)), F.lit(5.0)).alias("prediction")
    )
    return prediction_monitor(predictions, actuals, "value")
