"""Exact attributions of tree ensembles, from tables of their nodes.

A leaf gives its value to the rows whose features lie in its box.  Where a feature is unknown, the leaf counts with the share of
the training rows that its splits on that feature let through.  The Shapley value of a feature for that leaf is then

    value * (inside - share) * integral over t from 0 to 1 of the product, over the path's other features, of (share (1 - t) + inside t)

as t ** s (1 - t) ** (m - 1 - s) integrates to the weight of a subset of s of m - 1 features.  The product is a polynomial, so a
Gauss-Legendre rule of half its degree is exact; products that leave one feature out are those before it times those behind.
So a leaf with m features costs a row some m * m / 2 multiplications, and no subset is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged_path

#: tree and node number them, left and right are nodes (-1 in a leaf), cover is a node's training weight, value a leaf's
#: output, weight the tree's.  A row goes left if its feature is at most the threshold; a missing feature goes right.
NODES = "tree int, node int, feature int, threshold double, left int, right int, cover double, value double, weight double"


@dataclass(frozen=True)
class Leaf:
    """A leaf's box: for each feature on its path the limits (above ``low``, up to ``high``) and the share of rows let through."""

    features: tuple[int, ...]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def node_table(model) -> DataFrame:
    """:data:`NODES` of a fitted forest, or of boosted trees or a single tree, as Spark stores them.

    A classification tree's value is its share of label 1, so that a forest's output is its probability; boosted trees give the margin
    (half the log-odds).  Trees with categorical splits are refused.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    at = staged_path(spark)
    model.write().overwrite().save(at)
    d = spark.read.parquet(f"{at}/data")
    d = d.select("treeID", "nodeData.*") if "nodeData" in d.columns else d.withColumn("treeID", F.lit(0))
    weights = getattr(model, "treeWeights", [1.0])
    boosted = type(model).__name__.startswith("GBT")
    total = 1.0 if boosted else float(sum(weights))
    if not d.where("split.numCategories > -1").isEmpty():
        raise ValueError("only splits at thresholds are supported, not those by category")
    classes = type(model).__name__.endswith("ClassificationModel") and not boosted
    stats = F.col("impurityStats")
    cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x) if classes else stats[0]
    value = stats[1] / cover if classes else F.col("prediction")
    w = F.get(F.array(*[F.lit(float(x) / total) for x in weights]), F.col("treeID"))
    return d.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), cover.alias("cover"), value.alias("value"), w.alias("weight"),
    )


def leaves(nodes: DataFrame) -> list[Leaf]:
    """The leaves of an ensemble, whose nodes come to the driver: a model, not data."""
    found, trees = [], {}
    for r in nodes.collect():
        trees.setdefault(r.tree, {})[r.node] = r
    for tree in trees.values():
        children = {c for r in tree.values() for c in (r.left, r.right)}
        (root,) = [n for n in tree if n not in children]
        work = [(root, {})]
        while work:
            at, path = work.pop()
            r = tree[at]
            if r.left < 0:
                box = list(path.values())
                low, high, share = (np.array([b[i] for b in box], float) for i in range(3))
                found.append(Leaf(tuple(path), low, high, share, r.value * r.weight))
                continue
            for child, left in ((r.left, True), (r.right, False)):
                low, high, share = path.get(r.feature, (-np.inf, np.inf, 1.0))
                own = (low, min(high, r.threshold)) if left else (max(low, r.threshold), high)
                work.append((child, path | {r.feature: (*own, share * tree[child].cover / r.cover)}))
    return found


def base_value(ensemble: Sequence[Leaf]) -> float:
    """The output where nothing is known: each leaf by its share of the training rows."""
    return float(sum(x.value * x.share.prod() for x in ensemble))


def shapley(x: np.ndarray, ensemble: Sequence[Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """Attributions (rows by features) and outputs of the rows ``x``."""
    phi, out = np.zeros(x.shape), np.zeros(len(x))
    for leaf in ensemble:
        m = len(leaf.features)
        if not m:
            out += leaf.value
            continue
        v = x[:, leaf.features]
        inside = ((~(v <= leaf.low) | np.isneginf(leaf.low)) & ((v <= leaf.high) | np.isinf(leaf.high))).astype(float)
        out += leaf.value * inside.prod(1)
        at, weight = np.polynomial.legendre.leggauss((m + 1) // 2)
        at, weight = (at + 1) / 2, weight / 2
        factor = leaf.share[None, :, None] * (1 - at) + inside[:, :, None] * at
        before, behind = np.ones_like(factor), np.ones_like(factor)
        np.cumprod(factor[:, :-1], axis=1, out=before[:, 1:])
        behind[:, :-1] = np.cumprod(factor[:, :0:-1], axis=1)[:, ::-1]
        phi[:, leaf.features] += leaf.value * (inside - leaf.share) * ((before * behind) @ weight)
    return phi, out


def attributed(x: np.ndarray, ensemble: Sequence[Leaf], most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shapley` of all rows: those between the same limits of the ensemble in every feature are alike, and are worked on once, ``most`` at a time."""
    cell = np.zeros(len(x), np.int64)
    for k in range(x.shape[1]):
        limits = np.unique([v for leaf in ensemble for f, low, high in zip(leaf.features, leaf.low, leaf.high, strict=True) if f == k for v in (low, high) if np.isfinite(v)])
        if len(limits):
            # a missing value is sorted behind all limits, as it goes right
            cell = np.unique(cell * (len(limits) + 1) + np.searchsorted(limits, x[:, k]), return_inverse=True)[1]
    _, first, cell = np.unique(cell, return_index=True, return_inverse=True)
    parts = [shapley(x[first[at : at + most]], ensemble) for at in range(0, len(first), most)]
    phi, out = (np.concatenate([p[k] for p in parts]) if parts else np.zeros((0, x.shape[1])[: 2 - k]) for k in (0, 1))
    return phi[cell], out[cell]


def tree_attributions(df: DataFrame, key: str, features: Sequence[str], nodes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``(key, feature_id, shap_value, base_value, model_output, additivity_error, additive)`` of each row and feature.

    ``features`` are the ensemble's, in its order.  ``additive``: the values add up to the output less the base within ``tolerance``.
    Boosted trees give margins.  A row is worked on in its batch; only the ensemble is in every task, and only numbers go to Python and back.
    """
    ensemble, names = leaves(nodes), list(features)
    base = base_value(ensemble)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        phi, out = attributed(rows.to_numpy(float), ensemble)
        return pd.DataFrame({f"v{k}": phi[:, k] for k in range(phi.shape[1])} | {"out": out, "error": np.abs(base + phi.sum(1) - out)})

    kind = ", ".join([*[f"v{k} double" for k in range(len(names))], "out double", "error double"])
    x = F.pandas_udf(run, kind)(F.struct(*[F.col(n).cast("double").alias(f"x{k}") for k, n in enumerate(names)]))
    each = F.array(*[F.struct(F.lit(n).alias("feature_id"), F.col(f"__x.v{k}").alias("shap_value")) for k, n in enumerate(names)])
    d = df.select(key, x.alias("__x")).select(key, F.explode(each).alias("v"), F.col("__x.out").alias("model_output"), F.col("__x.error").alias("additivity_error"))
    return d.select(key, "v.feature_id", "v.shap_value", F.lit(base).alias("base_value"), "model_output", "additivity_error", (F.col("additivity_error") <= tolerance).alias("additive"))


def refitted(df: DataFrame, features: Sequence[str], label: str, splits: Sequence[tuple[int, int, int, float, int, int]], weights: Sequence[float]) -> DataFrame:
    """:data:`NODES` of trees whose splits are given, with cover and values from ``df``: a stored model brought up to date.

    ``splits``: (tree, node, feature, threshold, left, right) of inner nodes.  All trees are refitted in one pass: each row names the
    nodes that it comes through, which are counted with their mean label.  A node that no row reaches has cover 0 and value 0.
    """
    spark, inner = df.sparkSession, {(t, n): (f, th, lo, hi) for t, n, f, th, lo, hi in splits}
    roots = {t: min(n for u, n in inner if u == t) for t, _ in inner}
    reach, work = {}, [(t, n, F.lit(True)) for t, n in roots.items()]
    while work:
        t, n, so_far = work.pop()
        reach[t, n] = so_far
        if (t, n) in inner:
            f, th, lo, hi = inner[t, n]
            left = F.coalesce(F.col(features[f]) <= th, F.lit(False))
            work += [(t, lo, so_far & left), (t, hi, so_far & ~left)]
    through = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(t).alias("tree"), F.lit(n).alias("node"))) for (t, n), c in reach.items()]))
    counted = df.select(F.col(label).cast("double").alias("y"), F.explode(through).alias("n")).groupBy("n.tree", "n.node").agg(F.count("y").cast("double").alias("cover"), F.avg("y").alias("value"))
    rows = [(t, n, *(inner[t, n] if (t, n) in inner else (-1, None, -1, -1)), float(weights[t])) for t, n in reach]
    known = spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, weight double")
    return known.join(counted, ["tree", "node"], "left").fillna(0.0, ["cover", "value"]).select(*[f.split()[0] for f in NODES.split(", ")])
