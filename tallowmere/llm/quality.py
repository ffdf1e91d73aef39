"""Quality: ridge regression on random Fourier features of document statistics, isotonically calibrated.

The statistics of a text are standardised; random cosines of them approximate a Gaussian kernel.  Each
partition of the labelled sample sums its part of the normal equations, the sums are added up and
solved, and on a fold of its own the ridge scores are calibrated to shares of label 1.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .shared import UPPER, held_out, removed, small_batches, written

ACCEPT = 0.7
#: Labelled rows to fit on, at most; random features; kernel width in standard deviations; ridge.
ROWS, FEATURES, WIDTH, RIDGE, SEED = 40_000, 384, 3.0, 1e-3, 7
#: The crc32 remainder of the rows that only calibrate.
CALIBRATES = 3
_PUNCTUATION = re.compile(r"[^\w\s]")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


def statistics(text: str) -> list[float]:
    """What a text is like, in numbers; an empty text has zeros."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * N_STATISTICS
    w = len(words)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, w)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    line_counts = Counter(lines)
    marks = Counter(_PUNCTUATION.findall(text))
    pairs = Counter(zip(words, words[1:], strict=False))
    letters = sum(map(str.isalpha, words))
    symbols = sum(v for k, v in marks.items() if k not in ".,;:!?'\"()-")
    raw = text.encode("utf-8", "replace")
    upper = len(raw) - len(raw.translate(None, UPPER.encode()))
    last = sum(1 for x in lines if x[-1] in ".!?\"'")
    return [
        np.log1p(n),
        np.log1p(w),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        len(counts) / w,
        np.log1p(w) * len(counts) / w,
        counts.most_common(1)[0][1] / w,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        sum(v for v in pairs.values() if v > 1) / w,
        letters / w,
        sum(marks.values()) / w,
        symbols / w,
        (marks["."] + marks[","]) / w,
        marks["|"] / w,
        len(_SENTENCE.findall(text)) / w,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / n,
        upper / n,
        upper / w,
        np.log1p(len(lines)),
        np.log1p(w / len(lines)),
        1 - len(line_counts) / len(lines),
        last / len(lines),
        sum(1 for x in words if not x[-1].isalnum() and x[-1] not in ".,;:!?'\")") / w,
    ]


N_STATISTICS = 24


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        phi = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([phi, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; where calibration is flat, the ridge score still orders, by a thousandth at most."""
        raw = self.features(x) @ self.weights
        level = np.interp(raw, self.steps, self.values)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The sums of phi phi' and of phi y over the rows: each partition's own, then added up by row of the matrix."""
    size = len(model.phases) + 1

    def run(batches):
        a = np.zeros((size, size + 1))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, N_STATISTICS)
            phi = model.features(x)
            a[:, :size] += phi.T @ phi
            a[:, size] += phi.T @ b.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["a"])

    parts = rows.select("x", "label").mapInArrow(run, "a binary")
    total = np.zeros((size, size + 1))
    for r in parts.toLocalIterator():  # as many as the bounded sample has partitions
        total += np.frombuffer(r["a"]).reshape(size, size + 1)
    return total[:, :size], total[:, size]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, features: int = FEATURES) -> Model:
    """A model from the labelled rows that are not held out, ``rows`` of them at most.

    Folds 0 and 1 fit the ridge, fold 3 calibrates; where a fold has no row, all rows serve for both.  With
    no labelled row every text scores one half.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample, path = labelled_sample(docs, labels, label, rows)

    def run(batches):
        for b in batches:
            x = [statistics(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.compute.cast(b.column(1), pa.float64()), b.column(2)], ["x", "label", "fold"])

    # the sample is bounded by ``rows``, and so are its partitions
    x, at = written(sample.select("text", (F.col("label") > 0).cast("int").alias("label"), "fold").repartition(8).mapInArrow(run, "x array<double>, label double, fold int"))
    removed(spark, path)
    each = [F.col("x")[i] for i in range(N_STATISTICS)]
    means = x.agg(F.count("*").alias("n"), F.array(*map(F.avg, each)).alias("mean"), F.array(*map(F.stddev_pop, each)).alias("sd")).first()
    rng = np.random.default_rng(SEED)
    directions, phases = rng.normal(0, 1 / WIDTH, (N_STATISTICS, features)), rng.uniform(0, 2 * np.pi, features)
    if not means["n"]:
        removed(spark, at)
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), directions, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    sd = np.array(means["sd"])
    model = Model(np.array(means["mean"]), np.where(sd > 1e-9, sd, 1.0), directions, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    folds = {r["c"]: r["n"] for r in x.groupBy((F.col("fold") == CALIBRATES).alias("c")).agg(F.count("*").alias("n")).collect()}
    fits, calibrates = (x.where(F.col("fold") != CALIBRATES), x.where(F.col("fold") == CALIBRATES)) if len(folds) == 2 else (x, x)
    a, b = _normal_equations(fits, model)
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.eye(len(a)) / len(a) ** 0.5, b)

    def raw(batches):
        for r in batches:
            m = np.array(r.column(0).to_pylist(), float).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([pa.array(model.features(m) @ model.weights), r.column(1)], ["raw", "label"])

    iso = IsotonicRegression(featuresCol="raw", labelCol="label").fit(calibrates.select("x", "label").mapInArrow(raw, "raw double, label double"))
    model.steps, model.values = iso.boundaries.toArray(), iso.predictions.toArray()
    removed(spark, at)
    return model


def score(model: Model, column: Column) -> Column:
    """The score, 0 to 1, of each whole text of ``column``; null counts as empty, which has a score as any other."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts], float).reshape(-1, N_STATISTICS)
            yield pd.Series(model.score(x))

    return run(F.coalesce(column.cast("string"), F.lit("")))


def quality_report(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score at or above 0.7) for every row of ``docs``.

    Each row is scored by its own text alone, so repeated rows and ids have a row each.  A null text is empty and
    has the score of one; a null id is held out.  No rows give no rows.
    """
    s = docs.select("doc_id", held_out().alias("held_out"), score(fit(docs, labels, rows=rows), F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
