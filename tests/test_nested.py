"""Prefixes of a fitted ensemble, and the search that scores them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import models as md
from riskloom.operators.nested import NestedSearch, first_trees, prefix_scores


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(int)
    pdf = pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "weight": np.where(y, 1.0, 1.2)})
    return md.assembled(spark.createDataFrame(pdf).repartition(4, "id"), ["a", "b", "c"]).cache()


def probabilities(model, rows):
    return [r["p"] for r in model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").collect()]


def test_boosting_prefix_equals_smaller_fit(rows):
    gbt = GBTClassifier(labelCol="y", weightCol="weight", maxDepth=3, seed=42)
    large, small = gbt.setMaxIter(8).fit(rows), gbt.copy().setMaxIter(5).fit(rows)
    part = first_trees(large, 5)
    assert part.getNumTrees == 5 and part.treeWeights == small.treeWeights
    assert probabilities(part, rows) == pytest.approx(probabilities(small, rows), abs=1e-12)
    assert probabilities(first_trees(large, 99), rows) == probabilities(large, rows)


def test_forest_prefix_is_the_mean_of_its_trees(rows):
    forest = RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=7, maxDepth=6, seed=42).fit(rows)
    trees = [probabilities(t, rows) for t in forest.trees[:4]]
    assert probabilities(first_trees(forest, 4), rows) == pytest.approx(np.mean(trees, axis=0), abs=1e-12)
    got = prefix_scores(forest, rows, [4, 7], ["id"]).orderBy("id").collect()
    assert [r["p4"] for r in got] == pytest.approx(np.mean(trees, axis=0), abs=1e-12)
    assert [r["p7"] for r in got] == probabilities(forest, rows)


def auc(p, y):
    rank, y = pd.Series(p).rank().to_numpy(), np.asarray(y)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_search_equals_separate_fits(rows):
    from riskloom.operators.evaluation import hash_fold

    search = md.boosted_trees("y", rounds=(2, 6), depths=(2, 3), rates=(0.1,), folds=2, key=["id"])
    found = search.fit(rows)
    placed = rows.withColumn("f", hash_fold(["id"], 2)).cache()
    want = {}
    for depth in (2, 3):
        for n in (2, 6):
            values = []
            for f in (0, 1):
                model = GBTClassifier(labelCol="y", weightCol="weight", seed=42, maxDepth=depth, stepSize=0.1, maxIter=n).fit(placed.where(F.col("f") != f))
                held = placed.where(F.col("f") == f)
                values.append(auc(probabilities(model, held), [r["y"] for r in held.orderBy("id").collect()]))
            want[depth, n] = np.mean(values)
    got = {(m["maxDepth"], m["maxIter"]): m["auc"] for m in found.metrics}
    assert got == pytest.approx(want, abs=0.02)  # splits are cut from a sample of each partition
    best = max(got.values())
    assert found.best["auc"] == best and found.bestModel.getNumTrees == found.best["maxIter"] and found.bestModel.getMaxDepth() == found.best["maxDepth"]


def test_folds_of_one_class_do_not_count(spark, rows):
    one = rows.withColumn("y", F.lit(0))
    found = NestedSearch(RandomForestClassifier(labelCol="y", maxDepth=2, seed=1), "y", "numTrees", (2, 3), folds=2, key=["id"])
    got = found.fit(one.where("id < 40").unionByName(rows.where("id = 50").withColumn("y", F.lit(1))))
    assert [m["numTrees"] for m in got.metrics] == [2, 3] and got.bestModel.getNumTrees in (2, 3)
