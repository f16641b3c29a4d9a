"""Trees grown from histograms, against those of pyspark.ml."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from brisa.plans import trees

COLUMNS = ["a", "b", "c", "d"]


def rows(n):
    """Inputs of many and of few values, one constant; labels are sixteenths, so that sums of the first tree are exact."""
    i = np.arange(n)
    a, b, c = (i * 7919 % 10_007) / 10_007 - 0.5, (i * 104_729 % 5_003) / 5_003 * 3, (i * 31 % 5).astype(float)
    y = np.round(16 * (np.sin(6 * a) + b * (c > 2) + (i * 13 % 7) / 20)) / 16
    return [(int(k), *map(float, v)) for k, v in zip(i, np.column_stack([a, b, c, np.zeros(n), y]))]


@pytest.fixture(scope="module")
def table(spark):
    data = spark.createDataFrame(rows(3000), "id int, a double, b double, c double, d double, label double")
    data = data.repartition(4, "id").sortWithinPartitions("id").persist()
    data.count()
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return data


def vectors(data):
    return VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(data)


def shape(model):
    """Split input and cut of every inner node, and prediction of every node, tree by tree."""
    return [t.toDebugString.split("\n")[1:] for t in model.trees]


def predictions(model, data):
    return np.array([r[0] for r in model.transform(vectors(data)).orderBy("id").select("prediction").collect()])


@pytest.mark.parametrize("share", [0.8, 1.0])
def test_boosted_trees_are_those_of_pyspark_ml(table, share):
    estimator = GBTRegressor(maxIter=4, maxDepth=4, stepSize=0.3, subsamplingRate=share, maxBins=24, seed=42)
    ours, theirs = trees.fit(table, estimator, COLUMNS), estimator.fit(vectors(table))
    assert shape(ours)[0] == shape(theirs)[0]
    assert [t.numNodes for t in ours.trees] == [t.numNodes for t in theirs.trees]
    assert ours.treeWeights == theirs.treeWeights and ours.numFeatures == 4
    assert predictions(ours, table) == pytest.approx(predictions(theirs, table), abs=1e-9)
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-9)


def test_thresholds_of_many_rows_are_those_of_pyspark_ml(spark):
    data = spark.createDataFrame(rows(15_000), "id int, a double, b double, c double, d double, label double").repartition(3, "id").sortWithinPartitions("id").persist()
    estimator = GBTRegressor(maxIter=1, maxDepth=6, maxBins=64, seed=42)
    assert shape(trees.fit(data, estimator, COLUMNS)) == shape(estimator.fit(vectors(data)))
    data.unpersist()


def test_a_tree_of_the_forest_without_draws_is_a_decision_tree(table, monkeypatch):
    monkeypatch.setattr(trees.Poisson, "of", lambda self, key, block, n: np.ones(n, dtype=np.uint8))
    ours = trees.fit(table, RandomForestRegressor(numTrees=3, maxDepth=9, minInstancesPerNode=2, maxBins=24, featureSubsetStrategy="all", seed=5), COLUMNS)
    theirs = DecisionTreeRegressor(maxDepth=9, minInstancesPerNode=2, maxBins=24, seed=5).fit(vectors(table))
    for tree in ours.trees:
        assert tree.toDebugString.split("\n")[1:] == theirs.toDebugString.split("\n")[1:]


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_limits_do_not_change_the_trees(table, kind, monkeypatch):
    estimator = {
        "forest": RandomForestRegressor(numTrees=5, maxDepth=7, minInstancesPerNode=2, featureSubsetStrategy="all", seed=42),
        "boosted": GBTRegressor(maxIter=5, maxDepth=3, subsamplingRate=0.8, seed=42),
    }[kind]
    plain = trees.fit(table, estimator, COLUMNS)
    limits = {"NODES": 3, "TO_DRIVER": 0, "GROUP": 2, "TASK": 100, "CHECKPOINT": 2} | ({"ROWS": 100} if kind == "boosted" else {})
    for name, value in limits.items():
        monkeypatch.setattr(trees, name, value)
    limited = trees.fit(table, estimator, COLUMNS)
    if kind == "forest":
        assert shape(limited) == shape(plain)
    assert predictions(limited, table) == pytest.approx(predictions(plain, table), abs=1e-9)


def test_draws_are_poisson():
    draws = trees.Poisson(1.0)
    found = draws.of([42, 7], 0, 400_000)
    assert (found == draws.of([42, 7], 0, 400_000)).all() and (found != draws.of([42, 8], 0, 400_000)).any()
    for k, share in enumerate([0.36788, 0.36788, 0.18394, 0.06131, 0.01533, 0.00307]):
        assert np.mean(found == k) == pytest.approx(share, abs=0.004)
    edges = np.array([0, draws.steps[0] - np.uint64(1), draws.steps[0], draws.steps[3]], dtype=np.uint64)
    assert draws.count(edges).tolist() == [0, 0, 1, 4]


def test_forest_bags_every_row_and_keeps_its_settings(table):
    model = trees.fit(table, RandomForestRegressor(numTrees=6, maxDepth=5, minInstancesPerNode=40, featureSubsetStrategy="all", seed=42), COLUMNS)
    sizes = [t._call_java("rootNode").impurityStats().count() for t in model.trees]
    assert len(set(sizes)) > 1 and all(2700 < n < 3300 for n in sizes)
    assert max(t.depth for t in model.trees) == 5 and model.getNumTrees == 6 and len(set(map(str, shape(model)))) == 6


def test_rows_without_label_or_number_are_errors(table):
    estimator = GBTRegressor(maxIter=1, seed=1)
    for column, value in (("label", None), ("label", float("nan")), ("b", None)):
        broken = table.withColumn(column, F.when(F.col("id") == 7, F.lit(value).cast("double")).otherwise(F.col(column)))
        with pytest.raises(Exception, match="no number in an input|without a label"):
            trees.fit(broken, estimator, COLUMNS)


def test_one_value_only_gives_a_leaf(spark):
    data = spark.createDataFrame([(1.0, float(i)) for i in range(6)], "a double, label double").withColumns({c: F.lit(0.0) for c in "bcd"}).persist()
    for estimator in (RandomForestRegressor(numTrees=2, seed=1), GBTRegressor(maxIter=2, seed=1)):
        model = trees.fit(data.drop("a").withColumn("a", F.lit(0.0)), estimator, COLUMNS)
        assert {t.numNodes for t in model.trees} == {1}
    assert model.trees[0]._call_java("rootNode").prediction() == 2.5
