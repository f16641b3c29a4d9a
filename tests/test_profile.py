"""Statistics against plain Python on skewed and degenerate data."""

import random

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brisa.operators import profile, quantiles, shape, sketches
from brisa.schemas import PROFILE_POLLUTANTS


def shapes():
    r = random.Random(5)
    return {
        "ties": [1.0] * 4000 + [float(r.randint(0, 3)) for _ in range(500)],
        "uniform": [r.random() for _ in range(5000)],
        "heavy": [r.paretovariate(0.5) for _ in range(5000)],
        "outliers": [r.random() for _ in range(3000)] + [1e300, -1e300, 1e17],
        "constant": [7.0] * 100,
        "one": [3.5],
        "two": [1.0, 2.0],
        "tiny": [r.random() * 1e-300 for _ in range(1000)],
    }


@pytest.mark.parametrize("parts", ["1", "4", "37"])
def test_exact_quantiles(spark, parts):
    data = shapes()
    rows = [(name, v) for name, vs in data.items() for v in vs] + [("ties", None), (None, 1.0), ("ties", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    found = quantiles.exact_quantiles(df, ["g"], "v", probabilities).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {(r["g"], r["probability"]): r["quantile"] for r in found}
    assert len(got) == len(data) * len(probabilities)
    for name, values in data.items():
        for p in probabilities:
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12), (name, p)


def test_quantiles_of_missing_and_infinite_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, math.nan, None)], "v double")
    row = profile.describe(df).first()
    assert [row[c] for c in ("count", "mean", "max", "q25", "q50", "q75")] == [3, 2.0, 3.0, 1.5, 2.0, 2.5]
    wide = spark.createDataFrame([("a", v) for v in (-math.inf, 1.0, 2.0, 3.0, 4.0, math.inf)], "g string, v double")
    got = {r["probability"]: r["quantile"] for r in quantiles.exact_quantiles(wide, ["g"], "v", [0.0, 0.25, 0.75, 0.9]).collect()}
    assert got == {0.0: -math.inf, 0.25: 1.25, 0.75: 3.75, 0.9: math.inf}


def test_constant_column_has_no_correlation_or_trend(spark):
    # Many uneven partitions, so that partial moments really are merged.
    rows = [(float(i % 13), 0.1, None) for i in range(997)]
    df = spark.createDataFrame(rows, "aqi double, co double, no2 double").repartition(9)
    found = profile.correlation_matrix(df, ["aqi", "co", "no2"]).collect()
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in found}
    assert got["aqi", "aqi"] == pytest.approx(1.0)
    assert got["aqi", "co"] is None and got["co", "co"] is None
    trend = {r["pollutant"]: r["slope"] for r in profile.linear_trend(df, ["co", "no2"]).collect()}
    assert trend == {"co": None, "no2": None}
    assert profile.kde_curve(df, "co").count() == 0


def test_histogram_of_constant_column(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "v double")
    rows = profile.histogram(df, ["v"], bins=4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [0, 0, 5, 0]
    assert rows[0]["bin_start"] == 1.5


def test_histogram_equals_numpy(spark):
    values = shapes()["uniform"]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts = [r["count"] for r in profile.histogram(df, ["v"]).orderBy("bin").collect()]
    assert counts == np.histogram(values, 20)[0].tolist()


def test_boxplot(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 5.0), ("b", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in profile.boxplot_stats(df, "g", "v").collect()}
    a = got["a"]
    assert (a["q25"], a["q50"], a["q75"], a["whisker_low"], a["whisker_high"], a["outliers"]) == (2, 3, 4, 1, 4, 1)
    assert (got["b"]["q50"], got["b"]["count"], got["b"]["outliers"]) == (5.0, 1, 0)
    assert set(got) == {"a", "b"}


def test_transitions(make_readings):
    df = make_readings([(1, 0, 0), (1, 1, 0), (1, 2, 4), (2, 0, 4), (2, 9, 0)])
    counts = {r["category"]: r for r in profile.transition_matrix(df).collect()}
    assert (counts["Good"]["good"], counts["Good"]["hazardous"], counts["Hazardous"]["good"]) == (1, 1, 1)
    percent = {r["category"]: r for r in profile.transition_percent(df).collect()}
    assert percent["Good"]["good"] == 50.0
    assert percent["Moderate"]["good"] is None
    assert len(percent) == 5


def test_profiles_keep_empty_groups(make_readings):
    df = make_readings([(1, 0, 2)])  # a Monday
    days = profile.weekday_profile(df).orderBy("position").collect()
    assert [d["mean"] for d in days] == [2.0] + [None] * 6
    assert [r["count"] for r in profile.category_distribution(df).orderBy("position").collect()] == [0, 0, 1, 0, 0]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a int, b string")
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 2
    assert profile.duplicate_rows(df.limit(0)).first()["duplicate_rows"] == 0


def test_whole_table_profiles_of_empty_input(make_readings):
    empty = make_readings([])
    assert profile.dataset_size(empty).first()["cells"] == 0
    assert {r["nulls"] for r in profile.null_counts(empty).collect()} == {0}
    assert {r["count"] for r in profile.describe(empty, ["aqi"]).collect()} <= {0}


def test_describe(spark):
    values = shapes()["heavy"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)] + [(None, None)], "v double, i int")
    got = {r["column"]: r for r in profile.describe(df).collect()}
    assert got["i"]["q50"] == 2499.5 and got["i"]["count"] == 5000
    want = [np.mean(values), np.std(values, ddof=1), *np.quantile(values, [0.25, 0.5, 0.75])]
    assert [got["v"][c] for c in ("mean", "std", "q25", "q50", "q75")] == pytest.approx(want)


def test_sample_does_not_depend_on_partitions(make_readings):
    df = make_readings([(s, h, 1) for s in range(5) for h in range(60)])
    first = shape.sample_n(df.repartition(7), 50).collect()
    second = shape.sample_n(df.coalesce(1), 50).collect()
    assert len(first) == 50 and first == second
    assert shape.sample_n(df, 1000).count() == 300


def test_melt_keeps_nulls(make_readings):
    df = make_readings([(1, 0, 1)]).withColumn("no2", F.lit(None).cast("double"))
    long = shape.melt(df)
    assert long.count() == len(PROFILE_POLLUTANTS)
    assert long.where("value IS NULL").count() == 1


def test_density_equals_the_sum_over_all_values(spark):
    assert profile.kde_curve(spark.createDataFrame([(v,) for v in shapes()["tiny"]], "v double"), "v").count() == 0
    for name in ("uniform", "ties", "heavy", "outliers"):
        values = np.array([v for v in shapes()[name] if abs(v) < 1e6])
        df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
        h = values.std(ddof=1) * len(values) ** -0.2
        grid = np.linspace(values.min(), values.max(), 200)
        want = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(1) / (len(values) * h * math.sqrt(2 * math.pi))
        rows = sorted(profile.kde_curve(df, "v").collect())
        assert [r["point"] for r in rows] == list(range(200))
        assert np.abs(np.array([r["density"] for r in rows]) - want).max() < 1e-9 * want.max(), name


def test_density_rows_do_not_grow_with_distinct_values(spark):
    df = spark.range(200_000).select((F.col("id") * 0.37 % 1000).alias("v"))
    plan = profile.kde_curve(df, "v")
    assert plan.count() == 200
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spread, cells = (next(i for i, line in enumerate(lines) if word in line) for word in ("Generate explode(sequence", "Aggregate [cell"))
    assert spread < cells


def test_correlations_equal_numpy(spark):
    """Missing values in any combination, large means, many columns."""
    r = np.random.default_rng(3)
    data = r.normal(size=(400, 14)) @ r.normal(size=(14, 14)) + 1e7 * r.normal(size=14)
    rows = [tuple(None if r.random() < 0.15 else float(v) for v in row) for row in data]
    names = [f"c{i}" for i in range(14)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    found = {(x["column_a"], x["column_b"]): x["correlation"] for x in profile.correlation_matrix(df, names).collect()}
    assert len(found) == 14 * 14
    table = np.array([[np.nan if v is None else v for v in row] for row in rows])
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(table[:, i]) & ~np.isnan(table[:, j])
            assert found[a, b] == pytest.approx(np.corrcoef(table[both, i], table[both, j])[0, 1], abs=1e-7)


def test_correlation_of_columns_that_are_never_there_together(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0), (None, 5.0)], "a double, b double")
    found = {(x["column_a"], x["column_b"]): x["correlation"] for x in profile.correlation_matrix(df, ["a", "b"]).collect()}
    assert found == {("a", "a"): pytest.approx(1), ("b", "b"): pytest.approx(1), ("a", "b"): None, ("b", "a"): None}


@pytest.mark.parametrize("size", [64, 2048])
def test_ranks_of_sketched_quantiles(spark, size):
    data = shapes()
    rows = [(name, v) for name, vs in data.items() for v in vs] + [("ties", None), ("ties", math.nan), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(9)
    probabilities = [0.01, 0.25, 0.5, 0.9]
    got = {(r["g"], r["probability"]): r["quantile"] for r in sketches.approximate_quantiles(df, ["g"], "v", probabilities, size).collect()}
    assert len(got) == len(data) * len(probabilities)
    for (name, p), quantile in got.items():
        values = np.array(data[name])
        below, until = (values < quantile).mean(), (values <= quantile).mean()
        assert max(0, below - p, p - until) <= 2 * sketches.rank_bound(size) + 1 / len(values), (name, p)


def test_stored_sketches_merge_by_day(spark, make_readings):
    from brisa.session import new_dir

    path = new_dir(spark, "sketches")
    df = make_readings([(s, h, (h * s) % 5) for s in range(1, 4) for h in range(200)])
    late = F.hour("datetime") < 6
    for number, part in enumerate((~late, late, late)):
        # The third is the second one again, under its number.
        sketches.keep_sketches(df.where(part), ["pm10", "co"], path, min(number, 1))
    found = sketches.stored_quantiles(spark, path, [0.1, 0.5, 0.9])
    assert found.count() == 6
    assert all(r["error"] <= 2 * sketches.rank_bound() for r in sketches.rank_errors(df, found, ["pm10", "co"]).collect())
    first = sketches.stored_quantiles(spark, path, [0.0, 1.0], F.col("date") == "2024-01-01").where("column = 'co'")
    day = [r["co"] for r in df.where("datetime < '2024-01-02'").collect()]
    assert sorted(r["quantile"] for r in first.collect()) == [min(day), max(day)]


def test_approximate_profiles(spark):
    values = shapes()["uniform"]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    row = profile.describe(df, ["v"], approximate=True).first()
    assert row["count"] == len(values) and row["q50"] == pytest.approx(np.median(values), abs=0.01)
    box = profile.boxplot_stats(df, "g", "v", approximate=True).first()
    assert box["count"] == len(values) and box["q25"] == pytest.approx(np.quantile(values, 0.25), abs=0.01)
