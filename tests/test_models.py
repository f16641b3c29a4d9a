"""Models against closed forms and against themselves."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brisa.operators import metrics
from brisa.operators.features import compute_features
from brisa.operators.forecast import forecast_heuristic, forecast_kpis
from brisa.operators.shape import latest_row
from brisa.plans import attribution, explain, swaps, training
from brisa.schemas import KEY, MODEL_FEATURES, TARGET, TIME

SMALL = training.ModelSettings(forest_trees=5, forest_depth=6, boosting_rounds=5, boosting_rate=0.3)


@pytest.fixture(scope="module")
def features(spark):
    """Three series of 200 hours whose target follows their inputs; "month" is constant."""
    from brisa.schemas import POLLUTANTS
    from tests.conftest import READING, hours

    rows = []
    for series in range(3):
        for h in range(200):
            level = (h % 24) / 6 * (0.6 + 0.2 * series)
            noise = ((h * 37 + series * 11) % 17) / 17
            pollutants = [level * (i + 1) + noise * ((i * 5) % 7) for i in range(len(POLLUTANTS))]
            rows.append((series, hours(h), min(4.0, level + 0.2 * noise), *pollutants))
    df = compute_features(spark.createDataFrame(rows, READING), label_type="double").persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def data(features):
    frame = training.prepare_training(features).persist()
    frame.count()
    return frame


@pytest.fixture(scope="module")
def models(data):
    return training.train_models(data, SMALL)


def arrays(data):
    rows = data.select(*MODEL_FEATURES, training.LABEL, "is_train").collect()
    x = np.array([[r[n] for n in MODEL_FEATURES] for r in rows])
    return x, np.array([r[training.LABEL] for r in rows]), np.array([r["is_train"] for r in rows])


def test_ridge_is_the_closed_form(data, models):
    x, y, train = arrays(data)
    mean, std = x[train].mean(0), x[train].std(0)
    z = (x - mean) / np.where(std < 1e-9, 1.0, std)
    zt, yt = z[train], y[train]
    coefficients = np.linalg.solve(zt.T @ zt + np.eye(zt.shape[1]), zt.T @ (yt - yt.mean()))
    got = models["ridge"].stages[-1]
    assert np.allclose(got.coefficients.toArray(), coefficients, atol=1e-8)
    assert got.intercept == pytest.approx(yt.mean(), abs=1e-9)


def test_all_rows_scaling_is_an_option(data):
    settings = training.ModelSettings(scale_on_all_rows=True)
    model = training.train_models(data, settings, only=("ridge",))["ridge"]
    z = model.transform(data).agg(F.avg(training.scaled("co")), F.stddev_pop(training.scaled("co"))).first()
    assert z[0] == pytest.approx(0.0, abs=1e-9) and z[1] == pytest.approx(1.0, abs=1e-9)


def test_comparison(data, models):
    comparison = training.model_comparison(models, data).persist()
    rows = {r["model"]: r for r in comparison.collect()}
    x, y, train = arrays(data)
    scored = models["ridge"].transform(data).select(training.LABEL, "prediction", "is_train").collect()
    val = np.array([(r[0], r[1]) for r in scored if not r[2]])
    error = val[:, 0] - val[:, 1]
    assert rows["ridge"]["val_mae"] == pytest.approx(np.abs(error).mean())
    assert rows["ridge"]["val_rmse"] == pytest.approx(np.sqrt((error**2).mean()))
    assert rows["ridge"]["val_r2"] == pytest.approx(1 - (error**2).mean() / val[:, 0].var())
    assert all(r["val_r2"] > 0.8 for r in rows.values())
    best = training.best_model(comparison).first()
    assert best["val_r2"] == max(r["val_r2"] for r in rows.values())
    assert training.registered_metrics(comparison).first()["model"] == best["model"]
    assert training.registered_metrics(comparison, "ridge").first()["mae"] == rows["ridge"]["val_mae"]
    others = training.error_reduction(comparison).collect()
    assert len(others) == 2
    one = others[0]
    other = rows[one["other"]]
    assert one["rmse_reduction"] == pytest.approx(100 * (1 - best["val_rmse"] / other["val_rmse"]))
    gaps = {r["model"]: r["gap"] for r in training.overfit_gap(comparison).collect()}
    assert gaps["ridge"] == pytest.approx(rows["ridge"]["train_r2"] - rows["ridge"]["val_r2"])


def test_training_again_gives_the_same(data, models):
    again = training.train_models(data, SMALL, only=("gradient_boosting",))["gradient_boosting"]
    first = [r[0] for r in models["gradient_boosting"].transform(data).orderBy(KEY, TIME).select("prediction").collect()]
    second = [r[0] for r in again.transform(data).orderBy(KEY, TIME).select("prediction").collect()]
    assert first == second


def test_partitions_follow_the_training_rows(data, monkeypatch):
    """A task reads about as many rows however many there are; a small table keeps the fixed number."""
    found = []
    monkeypatch.setattr(training, "fit_model", lambda train, *_: found.append([len(p) for p in train.select(KEY).rdd.glom().collect()]))
    rows = data.where("is_train").count()
    training.train_models(data, training.ModelSettings(rows_per_partition=20), only=("random_forest",))
    training.train_models(data, training.ModelSettings(), only=("random_forest",))
    assert len(found[0]) == -(-rows // 20) > 8 and len(found[1]) == 8
    assert sum(found[0]) == sum(found[1]) == rows and max(found[0]) < 60


def test_saved_model_predicts_the_same(data, models, tmp_path):
    from pyspark.ml import PipelineModel

    path = str(tmp_path / "ridge")
    models["ridge"].save(path)
    loaded = PipelineModel.load(path)
    a = models["ridge"].transform(data).agg(F.sum("prediction")).first()[0]
    assert loaded.transform(data).agg(F.sum("prediction")).first()[0] == pytest.approx(a)


def one_by_one(model, features, feedback):
    """The forecast of each series, a day at a time, as a plain loop."""
    found = {}
    latest = training.model_input(latest_row(features))
    for row in latest.collect():
        current, spark = row.asDict(), latest.sparkSession
        for step in (1, 2, 3):
            day = row[TIME].date() + datetime.timedelta(days=step)
            current.update(hour=12.0, day=float(day.day), month=float(day.month))
            current.update(day_of_week=float(day.weekday()), is_weekend=float(day.weekday() >= 5))
            p = model.transform(spark.createDataFrame([current], latest.schema)).first()["prediction"]
            found[row[KEY], step] = p
            current.update(feedback(step, p, row[training.LABEL]))
    return found


def fed(value, change):
    return {f"rolling_aqi_{n}h": value for n in (3, 6, 24)} | {"aqi_change_rate": change}


@pytest.mark.parametrize("name", ["ridge", "random_forest"])
def test_forecast_equals_a_plain_loop(features, models, name):
    want = one_by_one(models[name], features, lambda step, p, actual: fed(p, p - actual))
    got = training.forecast_3_days(models[name], features).collect()
    assert len(got) == 9
    for r in got:
        assert r["predicted_aqi"] == pytest.approx(want[r[KEY], r["step"]], abs=0.0051)
        assert r["date"] == datetime.date(2024, 1, 9) + datetime.timedelta(days=r["step"])


def test_api_forecast_and_its_parity_switch(features, models):
    model = models["ridge"]
    plain = {(r[KEY], r["step"]): r for r in training.forecast_api_variant(model, features).collect()}
    script = {(r[KEY], r["step"]): r for r in training.forecast_3_days(model, features).collect()}
    for key, r in plain.items():
        assert r["prediction"] == pytest.approx(script[key]["predicted_aqi"] + 1, abs=0.011)
        assert r["day"] == r["date"].strftime("%A")

    def original(step, p, actual):
        published = p + 1
        return fed(published, 0.0 if step == 1 else published - round(published, 2))

    want = one_by_one(model, features, original)
    parity = training.forecast_api_variant(model, features, parity=True).collect()
    for r in parity:
        assert r["prediction"] == pytest.approx(want[r[KEY], r["step"]] + 1, abs=0.0051)
    assert [r["prediction"] for r in parity] != [r["prediction"] for r in plain.values()]


def test_batch_predict(features, models):
    rows = training.batch_predict(models["ridge"], features).collect()
    parity = {r[KEY]: r for r in training.batch_predict(models["ridge"], features, parity=True).collect()}
    names = ["Good", "Fair", "Moderate", "Poor", "Very Poor"]
    assert len(rows) == 3
    for r in rows:
        level = int(np.clip(np.ceil(r["prediction"]), 1, 5))
        assert r["status"] == names[level - 1]
        assert names.index(parity[r[KEY]]["status"]) <= level - 1


def test_importances(data, features, models):
    for name in models:
        table = explain.feature_importance(models[name], data)
        rows = table.orderBy("rank").collect()
        assert len(rows) == len(MODEL_FEATURES)
        assert sum(r["importance_percent"] for r in rows) == pytest.approx(100)
        assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert [r["rank"] for r in explain.top_features(table, 10).collect()] == list(range(1, 11))
    impact = explain.feature_impact(features, table).collect()
    assert len(impact) == 3 * len(MODEL_FEATURES)
    assert sum(r["impact"] == "High" for r in impact) == 15


def test_inputs_of_equal_weight_rank_by_name(spark, data):
    """Two multiples of one input: which of them is larger by the last digits depends on the order of sums."""

    names = ["co", "pm2_5", "a"]
    moments = {f"{n}_{k}": 1.0 for n in names for k in ("mean", "std")}
    for weights in ([0.1, np.nextafter(0.1, 1), 0.2], [np.nextafter(0.1, 1), 0.1, 0.2]):
        rows = explain.feature_importance(training.MarginalModel(weights, 0.0, moments, names), data, names).orderBy("rank").collect()
        assert [r["feature"] for r in rows] == ["a", "co", "pm2_5"]


def test_linear_contributions_sum_to_the_prediction(data, models):
    rows = explain.linear_contributions(models["ridge"], data)
    sums = rows.groupBy(KEY, TIME).agg(F.sum("contribution").alias("total"))
    scored = models["ridge"].transform(data)
    mean = scored.agg(F.avg("prediction")).first()[0]
    worst = (
        sums.join(scored, [KEY, TIME]).agg(F.max(F.abs(F.col("total") - (F.col("prediction") - mean)))).first()[0]
    )
    assert worst < 1e-8
    assert explain.mean_contributions(rows).count() == len(MODEL_FEATURES)


def test_permutation_importance(data, models):
    rows = {r["feature"]: r for r in explain.permutation_importance(models["random_forest"], data).collect()}
    assert set(rows) == set(MODEL_FEATURES)
    scored = metrics.regression_metrics(models["random_forest"].transform(data), training.LABEL, "prediction").first()
    assert rows["co"]["baseline_r2"] == pytest.approx(scored["r2"])
    assert rows["month"]["r2_loss"] == pytest.approx(0.0, abs=1e-12)  # constant input
    assert max(r["r2_loss"] for r in rows.values()) > 0.01


@pytest.mark.parametrize("kind", ["gradient_boosting", "random_forest"])
def test_swapped_inputs_are_scored_as_by_the_model(spark, data, models, kind, monkeypatch):
    """Each input in turn from another row, also on a threshold: what the model itself predicts for such a row."""
    monkeypatch.setattr(swaps, "ROWS", 64)
    rows = data.orderBy(KEY, TIME).limit(40).toPandas()
    others = rows.iloc[::-1].reset_index(drop=True)
    pairs = rows.join(others[MODEL_FEATURES].add_prefix("o_"))
    pairs[training.LABEL] = np.arange(40.0)
    found = swaps.swapped_predictions(models[kind], spark.createDataFrame(pairs), {n: f"o_{n}" for n in MODEL_FEATURES}, MODEL_FEATURES)
    got = {(r[swaps.VARIANT], r[training.LABEL]): r["prediction"] for r in found.collect()}
    assert len(got) == 40 * (len(MODEL_FEATURES) + 1)
    parts = []
    for i in range(-1, len(MODEL_FEATURES)):
        part = pairs[[KEY, TIME, training.LABEL, *MODEL_FEATURES]].copy()
        if i >= 0:
            part[MODEL_FEATURES[i]] = pairs[f"o_{MODEL_FEATURES[i]}"]
        parts.append(part.assign(variant=i))
    import pandas as pd

    for r in models[kind].transform(spark.createDataFrame(pd.concat(parts))).collect():
        assert got[r["variant"], r[training.LABEL]] == pytest.approx(r["prediction"], abs=1e-9)
    trees = swaps.Trees.of(models[kind], spark)
    cuts = [np.unique(trees.threshold[(trees.feature == f) & ~trees.leaf]) for f in range(len(MODEL_FEATURES))]
    edges = [[v for t in c for v in (t, np.nextafter(t, 9e9))] or [0.0] for c in cuts]
    x, other = (np.array([[e[(i * k + f) % len(e)] for f, e in enumerate(edges)] for i in range(50)]) for k in (1, 3))
    whole = trees.swapped(x, other)
    for f in range(len(MODEL_FEATURES)):
        changed = x.copy()
        changed[:, f] = other[:, f]
        assert whole[f + 1] == pytest.approx(trees.swapped(changed, changed)[0], abs=1e-9)


def test_permutation_scores_a_row_once(data, models):
    """Rows are not multiplied by the inputs before the trees see them."""
    plan = explain.permutation_importance(models["random_forest"], data)._jdf.queryExecution().optimizedPlan().toString()
    before = plan[plan.index("MapInArrow"):]
    assert "_variant" not in before and "UDF(features" not in plan


def test_split(data):
    share = data.agg(F.avg(F.col("is_train").cast("int"))).first()[0]
    assert 0.7 < share < 0.9
    again = metrics.train_val_split(data.drop("is_train").repartition(5)).where("is_train").select(KEY, TIME)
    assert again.exceptAll(data.where("is_train").select(KEY, TIME)).count() == 0


def test_temporal_split(features):
    split = metrics.temporal_split(features)
    last_train = split.where("is_train").agg(F.max(TIME)).first()[0]
    first_val = split.where("NOT is_train").agg(F.min(TIME)).first()[0]
    assert last_train < first_val
    assert split.where("is_train").count() == 480


def test_metrics_of_constant_label(spark):
    rows = [(0.1, 0.1 + (i % 2)) for i in range(501)]
    df = spark.createDataFrame(rows, "label double, prediction double").repartition(7)
    assert metrics.regression_metrics(df, "label", "prediction").first()["r2"] is None


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(0.1, float(i)) for i in range(501)], "a double, b double").repartition(7)
    row = metrics.standard_scale(df, ["a", "b"]).agg(F.max(F.abs("a")), F.stddev_pop("b")).first()
    assert row[0] < 1e-12 and row[1] == pytest.approx(1.0)


def test_heuristic_forecast(make_readings):
    latest = latest_row(make_readings([(1, 0, 1), (1, 24 * 4, 2), (2, 24 * 4, 4)]))  # a Friday
    rows = forecast_heuristic(latest, F.col(TARGET) + 1)
    got = {(r[KEY], r["step"]): r["predicted_aqi"] for r in rows.collect()}
    assert [got[1, s] for s in (1, 2, 3)] == pytest.approx([3.3, 3.4, 3.2])  # Saturday, Sunday, Monday
    assert got[2, 1] == 5.0
    kpis = {r[KEY]: r for r in forecast_kpis(rows).collect()}
    assert (kpis[1]["trend"], kpis[1]["peak_day"]) == ("Improving", "Sun")
    assert (kpis[2]["trend"], kpis[2]["peak_day"]) == ("Worsening", "Sat")


def shapley(nodes, x, features):
    """By definition: over all sets of inputs, mean predictions with only those known."""
    import itertools
    import math

    table = {(n["tree"], n["node"]): n for n in nodes}

    def mean(tree, node, known):
        n = table[tree, node]
        if n["left"] < 0:
            return n["value"]
        if n["feature"] in known:
            return mean(tree, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"], known)
        parts = [(table[tree, c]["rows"], mean(tree, c, known)) for c in (n["left"], n["right"])]
        return sum(w * v for w, v in parts) / n["rows"]

    worth = {
        s: sum(mean(t, 0, s) for t in sorted({t for t, _ in table}))
        for k in range(features + 1)
        for s in itertools.combinations(range(features), k)
    }
    out = []
    for i in range(features):
        total = 0.0
        for s in worth:
            if i not in s:
                share = math.factorial(len(s)) * math.factorial(features - len(s) - 1) / math.factorial(features)
                total += share * (worth[tuple(sorted((*s, i)))] - worth[s])
        out.append(total)
    return out, worth[()]


@pytest.mark.parametrize("tabulated", [8, 1])
@pytest.mark.parametrize("kind", ["gradient_boosting", "random_forest"])
def test_tree_contributions_are_shapley_values(spark, data, kind, tabulated, monkeypatch):
    monkeypatch.setattr(attribution, "TABULATED", tabulated)
    names = ["co", "hour", "rolling_aqi_3h", "pm10"]
    fitted = training.train_models(data, SMALL, only=(kind,), names=names)[kind]
    nodes = attribution.node_table(fitted, spark).collect()
    groups, mean = attribution.leaves_of(nodes)
    rows = fitted.transform(data).select(*[training.scaled(n) for n in names], "prediction").limit(40).collect()
    x = np.array([row[:-1] for row in rows])
    found = attribution.Scorer(groups, len(names)).of(x)
    for row, one in zip(rows, found):
        want, base = shapley(nodes, row[:-1], len(names))
        assert base == pytest.approx(mean, abs=1e-9)
        assert one == pytest.approx(want, abs=1e-9)
        assert mean + one.sum() == pytest.approx(row["prediction"], abs=1e-9)


@pytest.mark.parametrize("kind", ["gradient_boosting", "random_forest"])
def test_tree_contributions_add_up_to_the_prediction(data, models, kind):
    rows, mean = attribution.tree_contributions(models[kind], data)
    sums = rows.groupBy(KEY, TIME).agg((F.sum("contribution") + mean).alias("whole"), F.count("*").alias("n"))
    both = sums.join(models[kind].transform(data).select(KEY, TIME, "prediction"), [KEY, TIME]).collect()
    assert len(both) == data.count()
    assert all(r["n"] == len(MODEL_FEATURES) and r["whole"] == pytest.approx(r["prediction"], abs=1e-9) for r in both)


def test_leaves_are_gone_through_once_per_cell(spark, data, monkeypatch):
    """Rows between the same thresholds share their values, whatever way cells are numbered; values on a threshold, NaN and infinities too."""
    names = ["co", "hour", "rolling_aqi_3h", "pm10"]
    fitted = training.train_models(data, SMALL, only=("gradient_boosting",), names=names)["gradient_boosting"]
    nodes = attribution.node_table(fitted, spark).collect()
    trees, _ = attribution.leaves_of(nodes)
    cuts = [sorted({n["threshold"] for n in nodes if n["left"] >= 0 and n["feature"] == f}) for f in range(4)]
    assert min(len(c) for c in cuts) >= 1
    edges = [[v for t in c for v in (t, np.nextafter(t, 9e9))] + [-np.inf, np.inf] for c in cuts]
    x = np.array([[e[(i * k) % len(e)] for e, k in zip(edges, (1, 3, 5, 7))] for i in range(60)])
    for row, one in zip(x[:12], attribution.Scorer(trees, 4).of(x[:12])):
        assert one == pytest.approx(shapley(nodes, row, 4)[0], abs=1e-9)
    x = np.vstack([x, np.where(np.arange(4) == np.arange(4)[:, None], np.nan, x[:4])])
    plain = sum(attribution.Tree(groups, 4).of(x) for groups in trees)
    seen = []
    whole = attribution.Tree.of
    monkeypatch.setattr(attribution.Tree, "of", lambda self, rows: seen.append(len(rows)) or whole(self, rows))
    for cells in (attribution.CELLS, 1):
        monkeypatch.setattr(attribution, "CELLS", cells)
        assert attribution.Scorer(trees, 4).of(np.tile(x, (50, 1))) == pytest.approx(np.tile(plain, (50, 1)), abs=1e-12)
    assert len(seen) == 2 * len(trees) and max(seen) <= len(x)


def test_marginal_model_and_normal_equations(data, models):
    x, y, train = arrays(data)
    z = (x - x[train].mean(0)) / np.where(np.ptp(x[train], 0) > 0, x[train].std(0), 1.0)
    n = train.sum()
    w = z[train].T @ (y[train] - y[train].mean()) / (n + 1) / x.shape[1]
    fitted = training.fit_marginal(data)
    assert fitted.coefficients.toArray() == pytest.approx(w, abs=1e-9)
    gradient = {r["feature"]: r["gradient"] for r in training.ridge_gradient(models["ridge"], data).collect()}
    assert set(gradient) == {*MODEL_FEATURES, "intercept"} and all(abs(v) < 1e-5 for v in gradient.values())
    off = training.MarginalModel(list(w * 2), 1.0, {f"{c}_{k}": 1.0 for c in MODEL_FEATURES for k in ("mean", "std")}, MODEL_FEATURES)
    assert max(abs(r["gradient"]) for r in training.ridge_gradient(off, data).collect()) > 1e-3


def test_models_are_compared_once(spark, monkeypatch):
    """What is derived from a comparison reads its rows and scores nothing again."""
    from brisa.catalog import models

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(models, "model", lambda spark, folder, name: models.marginal(spark, folder))
    rows = models.comparison(spark, folder)
    reduced = training.error_reduction(rows)
    assert "sum" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert reduced.inputFiles() and all("/comparison-" in name for name in reduced.inputFiles())
