"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The n-grams of a text are hashed to ``BUCKETS``.  On the labelled sample the log of the share of toxic
texts with an n-gram over that of others is its ratio; all n-grams whose presence differs significantly
between the classes are kept, and a logistic regression is fitted on them, as sparse vectors.  The value
of an n-gram is its ratio times the root of its rate in the text: a long text has many n-grams once by chance.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .sampling import labelled_sample
from .shared import held_out, removed, small_batches, text_of

SIZES = (4, 5)
BUCKETS = 1 << 20
#: Labelled rows to fit on, at most; added to each count; penalty of the regression.
ROWS, SMOOTHING, RIDGE = 16_000, 1.0, 2e-3
#: The log-likelihood ratio of an n-gram worth keeping: twice this is the chi-square of one degree with p = 0.01.
SIGNIFICANT = 3.317
#: One place in so many characters, beside half as many for any text, is a full rate.
DENSE = 500
REJECT = 0.3
#: Characters hashed at once.
BLOCK = 1 << 20
_FOLD = np.array([c if chr(c).isalnum() else 32 for c in range(128)], np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed_ngrams(text: str):
    """Arrays of the buckets of the text's n-grams: lower-cased, ASCII other than letters and digits as a blank, a blank at both ends."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 128, _FOLD[np.minimum(c, 127)], c).astype(np.uint64)
    top = max(SIZES)
    for start in range(0, len(c), BLOCK):
        part = c[start : start + BLOCK + top - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, top + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * _MIX
            h ^= h >> np.uint64(29)
            if n in SIZES:
                # an n-gram belongs to the block in which it starts
                yield (h[:BLOCK] >> np.uint64(20)) % np.uint64(BUCKETS)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def places(self) -> np.ndarray:
        at = np.full(BUCKETS, -1, np.int32)
        at[self.buckets] = np.arange(len(self.buckets))
        return at


def rates(text: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept n-grams of the text, ascending, and how dense each is in it, 0 to 1: the root of its places in ``DENSE`` characters."""
    found = [f[f >= 0] for f in (at[h] for h in hashed_ngrams(text))]
    kept, places = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
    return kept, np.sqrt(np.minimum(1.0, places * DENSE / (len(text) + DENSE / 2)))


def _counts(sample: DataFrame) -> DataFrame:
    """``(bucket, toxic, clean)``: texts with the n-gram, by label; counted in each partition, then summed."""

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = [np.unique(h) for h in hashed_ngrams(text)]
                counts[int(label > 0), np.unique(np.concatenate(seen)) if seen else []] += 1
        some = np.flatnonzero(counts.any(0))
        for i in range(0, len(some), 100_000):
            s = some[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), pa.array(counts[1, s].astype(np.int64)), pa.array(counts[0, s].astype(np.int64))], ["bucket", "toxic", "clean"])

    part = sample.select("text", "label").mapInArrow(run, "bucket long, toxic long, clean long")
    return part.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS, significant: float = SIGNIFICANT) -> Model:
    """A model from the labelled rows that are not held out, ``rows`` of them at most.

    With no labelled row, or none of one class, the model has no n-gram and its bias is the smoothed
    rate of the label.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample, path = labelled_sample(docs, labels, label, rows)
    n = {bool(r["toxic"]): r["n"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    bias = float(np.log((toxic + SMOOTHING) / (clean + SMOOTHING)))
    if not toxic or not clean:
        removed(spark, path)
        return Model(np.zeros(0, np.int64), np.zeros(0), bias)
    # the sample is bounded, so are its partitions; each counts into arrays of the buckets' number
    c = _counts(sample.repartition(8))
    # log-likelihood of presence by class; both logs of a share are 0 where the count is
    part = lambda k, of: F.when(F.col(k) > 0, F.col(k) * F.ln(F.col(k) * (toxic + clean) / (F.col("toxic") + F.col("clean")) / of)).otherwise(0.0)
    gone = lambda k, of: F.when(of - F.col(k) > 0, (of - F.col(k)) * F.ln((of - F.col(k)) * (toxic + clean) / ((toxic + clean) - F.col("toxic") - F.col("clean")) / of)).otherwise(0.0)
    strength = part("toxic", toxic) + part("clean", clean) + gone("toxic", toxic) + gone("clean", clean)
    # one row a bucket at most, whatever the size of the corpus
    best = sorted(c.where(strength >= significant).collect(), key=lambda r: r["bucket"])
    if not best:
        removed(spark, path)
        return Model(np.zeros(0, np.int64), np.zeros(0), bias)
    buckets = np.array([r["bucket"] for r in best], np.int64)
    rate = lambda k, of: np.array([(r[k] + SMOOTHING) / (of + 2 * SMOOTHING) for r in best])
    ratio = np.log(rate("toxic", toxic) / rate("clean", clean))
    at = Model(buckets, ratio, 0.0).places()

    def run(batches):
        for b in batches:
            x = [rates(t, at) for t in b.column(0).to_pylist()]
            n = b.num_rows
            features = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(ratio), np.int32)), pa.array([k for k, _ in x], pa.list_(pa.int32())), pa.array([v * ratio[k] for k, v in x], pa.list_(pa.float64()))],
                ["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays([features, b.column(1)], ["features", "label"])

    schema = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())])
    rows_ = sample.select("text", (F.col("label") > 0).cast("double").alias("label")).repartition(8).mapInArrow(run, schema)
    lr = LogisticRegression(maxIter=60, regParam=RIDGE, standardization=False).fit(rows_)
    removed(spark, path)
    return Model(buckets, lr.coefficients.toArray() * ratio, float(lr.intercept))


def score(model: Model, column: Column) -> Column:
    """The score, 0 to 1, of each whole text of ``column``; null counts as empty, which scores as the bias."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = model.places()
        for texts in batches:
            z = np.array([model.weights[k] @ v for k, v in (rates(t, at) for t in texts)], float) + model.bias
            yield pd.Series(1 / (1 + np.exp(-z)))

    return run(F.coalesce(column.cast("string"), F.lit("")))


def toxicity_report(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score at or above 0.3) for every row of ``docs``.

    Each row is scored by its own text alone, so repeated rows and ids have a row each.  A null text is empty and
    scores as one without any kept n-gram; a null id is held out.  No rows give no rows.
    """
    s = docs.select("doc_id", held_out().alias("held_out"), score(fit(docs, labels, rows=rows), F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """``docs`` without the rows that score at or above 0.3, all columns as they were; odd rows are as in :func:`toxicity_report`."""
    return docs.where(score(fit(docs, labels, rows=rows), F.col("text")) < REJECT)
