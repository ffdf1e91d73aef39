"""Attributions of tree ensembles against all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from tallowmere import catalog
from tallowmere.operators import models, trees

NAMES = ["a", "b", "c", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    d = spark.range(900).select("id", (i % 17).cast("double").alias("a"), (i % 13).cast("double").alias("b"), (i * 7 % 11).cast("double").alias("c"), (i * 3 % 5).cast("double").alias("e"))
    return d.withColumn("label", (F.col("a") + F.col("b") * F.col("c") - F.col("e") > 30).cast("double")).withColumn("w", F.when(i % 3 == 0, 2.0).otherwise(1.0))


def output(nodes, x, known, n=0):
    """What a tree says if only some features are known."""
    r = nodes[n]
    if r.left < 0:
        return r.value
    if r.feature in known:
        return output(nodes, x, known, r.left if x[r.feature] <= r.threshold else r.right)
    return sum(nodes[c].cover * output(nodes, x, known, c) for c in (r.left, r.right)) / r.cover


def by_subsets(table, x):
    built = {}
    for r in table:
        built.setdefault(r.tree, {})[r.node] = r
    f = lambda known: sum(output(t, x, known) * t[0].weight for t in built.values())
    n = len(x)
    phi = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        phi.append(sum(factorial(q) * factorial(n - q - 1) / factorial(n) * (f({*s, i}) - f({*s})) for q in range(n) for s in combinations(others, q)))
    return phi, f(set()), f(set(range(n)))


@pytest.mark.parametrize(
    ("kind", "more"),
    [(DecisionTreeClassifier, {"maxDepth": 5, "weightCol": "w"}), (RandomForestClassifier, {"numTrees": 4, "maxDepth": 4, "seed": 1}), (GBTClassifier, {"maxIter": 5, "maxDepth": 4, "seed": 1, "weightCol": "w"})],
)
def test_attributions_equal_all_subsets(spark, rows, kind, more):
    x = models.assembled(rows, NAMES)
    model = kind(**more).fit(x)
    nodes = trees.node_table(model)
    table = nodes.collect()
    got = {}
    for r in trees.tree_attributions(rows.where("id % 60 = 7"), "id", NAMES, nodes).collect():
        got.setdefault(r.id, {})[r.feature_id] = r
    for r in model.transform(x).where("id % 60 = 7").collect():
        own = got[r.id]
        phi, base, out = by_subsets(table, [r[n] for n in NAMES])
        assert [own[n].shap_value for n in NAMES] == pytest.approx(phi, abs=1e-12)
        assert (own["a"].base_value, own["a"].model_output) == pytest.approx((base, out), abs=1e-12)
        right = r.rawPrediction[1] if kind is GBTClassifier else r.probability[1]
        assert own["a"].model_output == pytest.approx(right, abs=1e-9) and all(v.additive for v in own.values())


def test_refitted_splits_give_the_tree_back(spark, rows):
    nodes = trees.node_table(DecisionTreeClassifier(maxDepth=3).fit(models.assembled(rows, NAMES)))
    table = {r.node: r for r in nodes.collect()}
    splits = [(0, n, r.feature, r.threshold, r.left, r.right) for n, r in table.items() if r.left >= 0]
    again = {r.node: r for r in trees.refitted(rows, NAMES, "label", splits, [1.0]).collect()}
    assert again.keys() == table.keys()
    for n, r in table.items():
        assert again[n].cover == r.cover and again[n].value == pytest.approx(r.value)


def test_missing_features_go_right(spark):
    leaf = [trees.Leaf((0,), np.array([-np.inf]), np.array([1.0]), np.array([0.25]), 8.0), trees.Leaf((0,), np.array([1.0]), np.array([np.inf]), np.array([0.75]), 4.0)]
    phi, out = trees.shapley(np.array([[0.5], [2.0], [np.nan], [1.0]]), leaf)
    assert out.tolist() == [8.0, 4.0, 4.0, 8.0] and trees.base_value(leaf) == 5.0
    assert (trees.base_value(leaf) + phi[:, 0]).tolist() == out.tolist()


def test_boosted_attributions_add_up(spark, small):
    got = catalog.QUERIES["boosted_attribution"](spark, small)
    assert got.where("not additive").isEmpty() and got.count() == 3 * spark.read.parquet(f"{small}/lineitem.parquet").count()


def test_alike_rows_are_worked_on_once(monkeypatch):
    """Rows between the same limits, on them and missing ones get what they get by themselves, from few rows."""
    ensemble = [trees.Leaf((0, 1), np.array([-np.inf, 2.0]), np.array([1.0, np.inf]), np.array([0.4, 0.5]), 3.0), trees.Leaf((1,), np.array([-np.inf]), np.array([2.0]), np.array([0.5]), -1.0), trees.Leaf((0,), np.array([1.0]), np.array([np.inf]), np.array([0.6]), 0.5)]
    x = np.array([[a, b, c] for a in (0.0, 1.0, 1.5, np.nan, np.inf, -np.inf) for b in (1.9, 2.0, 2.1, np.nan) for c in range(50)], float)
    whole = trees.shapley(x, ensemble)
    seen, one = [], trees.shapley
    monkeypatch.setattr(trees, "shapley", lambda rows, e: seen.append(len(rows)) or one(rows, e))
    phi, out = trees.attributed(x, ensemble)
    assert np.allclose(phi, whole[0], atol=1e-12) and np.allclose(out, whole[1], atol=1e-12) and sum(seen) == 4
    assert trees.attributed(x[:0], ensemble)[0].shape == (0, 3)
