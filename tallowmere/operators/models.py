"""Training: the three classifiers, and attributions of their scores to features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def classifiers(label: str = "label", weight: str = "weight", seed: int = 42) -> dict[str, object]:
    """Logistic regression, a forest and boosted trees, on ``features`` with balanced weights."""
    common = {"labelCol": label, "weightCol": weight}
    return {
        "logistic_regression": LogisticRegression(maxIter=2000, **common),
        "random_forest": RandomForestClassifier(numTrees=300, minInstancesPerNode=20, seed=seed, **common),
        "gradient_boosting": GBTClassifier(maxIter=100, stepSize=0.1, seed=seed, **common),
    }


def scored(model, df: DataFrame) -> DataFrame:
    """``score``, the probability of label 1."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def importance(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Coefficients or importances by feature, the largest in size first."""
    values = model.coefficients.toArray() if hasattr(model, "coefficients") else model.featureImportances.toArray()
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: (-abs(x[1]), x[0]))


def linear_attributions(df: DataFrame, key: str, weights: dict[str, float], means: dict[str, float]) -> DataFrame:
    """``(key, feature_id, shap_value)`` of a linear score: weight times the distance from the background's mean, which is exact."""
    parts = F.array(*[F.struct(F.lit(f).alias("feature_id"), (F.lit(w) * (F.col(f).cast("double") - F.lit(means[f]))).alias("shap_value")) for f, w in weights.items()])
    return df.select(key, F.explode(parts).alias("p")).select(key, "p.*")


def permutation_attributions(df: DataFrame, key: str, features: Sequence[str], predict, background: Sequence[Sequence[float]], permutations: int = 16, seed: int = 0) -> DataFrame:
    """``(key, feature_id, shap_value, base_value, model_output)`` by sampled permutations, forwards and backwards.

    ``predict`` maps a matrix to scores and is shipped to the tasks with the background rows (a bounded sample).  For
    each case the parts add up to its output less the base.
    """
    names, back = list(features), np.array(background, float)
    schema = df.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for k, x in zip(pdf[key], pdf[names].to_numpy(float), strict=True):
                rng, phi = np.random.default_rng(seed), np.zeros(len(names))
                base = float(predict(back).mean())
                for _ in range(permutations):
                    order = rng.permutation(len(names))
                    for o in (order, order[::-1]):
                        stack = np.repeat(back[None], len(o) + 1, 0)
                        for i, f in enumerate(o):
                            stack[i + 1 :, :, f] = x[f]
                        y = predict(stack.reshape(-1, len(names))).reshape(len(o) + 1, -1).mean(1)
                        phi[o] += np.diff(y)
                phi /= 2 * permutations
                out = float(predict(x[None])[0])
                rows += [(k, f, float(p), base, out) for f, p in zip(names, phi, strict=True)]
            yield pd.DataFrame(rows, columns=[key, "feature_id", "shap_value", "base_value", "model_output"])

    return df.select(key, *names).mapInPandas(run, f"`{key}` {schema}, feature_id string, shap_value double, base_value double, model_output double")


def perturbed(df: DataFrame, local: DataFrame, key: str, features: Sequence[str], medians: dict[str, float], k: int, keep: bool) -> DataFrame:
    """Each case with its ``k`` strongest features replaced by the medians, or (``keep``) all others: to score comprehensiveness or sufficiency."""
    top = local.where(F.col("rank") <= k).groupBy(key).agg(F.collect_set("feature_id").alias("__top"))
    j = df.join(top, key, "left").withColumn("__top", F.coalesce("__top", F.array().cast("array<string>")))
    hit = lambda f: ~F.array_contains("__top", f) if keep else F.array_contains("__top", f)
    return j.withColumns({f: F.when(hit(f), F.lit(medians[f])).otherwise(F.col(f)) for f in features}).drop("__top")
