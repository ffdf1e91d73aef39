"""Evaluating classifiers exactly: ranking metrics with ties, thresholds, calibration errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import count_where, ratio

THRESHOLDS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)


def by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """``(score, p, n)``: positives and negatives of each distinct score: all that ranking metrics need."""
    return df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(count_where(F.col(truth) == 1).alias("p"), count_where(F.col(truth) == 0).alias("n"))


def ranking_metrics(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: roc_auc (ties count one half) and average_precision (ties form one step), from sums over the distinct scores.

    The scores are totalled from the highest down; blocks of the scores' hundredths keep a task from holding
    all of them.
    """
    s = by_score(df, truth, score).withColumn("block", F.floor(F.col("score") * 100))
    b = s.groupBy("block").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    b = b.select("block", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"))
    inside = W.partitionBy("block").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    c = s.withColumn("tp", F.sum("p").over(inside)).withColumn("fp", F.sum("n").over(inside)).join(b, "block")
    tp, fp = F.col("tp") + F.col("ap"), F.col("fp") + F.col("an")
    total = c.agg(
        F.sum("p").cast("double").alias("pos"), F.sum("n").cast("double").alias("neg"),
        F.sum(F.col("n") * (tp - F.col("p") + F.col("p") / 2.0)).alias("wins"),
        F.sum(F.col("p") * tp / (tp + fp)).alias("area"),
    )
    return total.select(ratio(F.col("wins"), F.col("pos") * F.col("neg")).alias("roc_auc"), ratio(F.col("area"), F.col("pos")).alias("average_precision"))


def at_thresholds(df: DataFrame, truth: str, score: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and positive_rate at each threshold (at or above is positive), in one pass."""
    y, s = F.col(truth), F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [count_where((y == 1) & (s >= t)).alias(f"tp{i}"), count_where((y == 0) & (s >= t)).alias(f"fp{i}"), count_where((y == 1) & (s < t)).alias(f"fn{i}"), count_where((y == 0) & (s < t)).alias(f"tn{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)])
    r = one.select(F.explode(rows).alias("r")).select("r.*")
    c = F.col
    r = r.withColumns({"precision": ratio(c("tp"), c("tp") + c("fp"), 0.0), "recall": ratio(c("tp"), c("tp") + c("fn"), 0.0), "positive_rate": ratio(c("tp") + c("fp"), c("tp") + c("fp") + c("fn") + c("tn"), 0.0)})
    return r.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall"), 0.0))


def brier(df: DataFrame, truth: str, score: str) -> DataFrame:
    return df.agg(F.avg((F.col(score) - F.col(truth)) * (F.col(score) - F.col(truth))).alias("brier"), F.count("*").alias("rows"))


def best_model(metrics: DataFrame) -> DataFrame:
    """The model of the highest average precision, then area under the curve, then the lowest Brier score, then name."""
    return metrics.orderBy(F.desc_nulls_last("average_precision"), F.desc_nulls_last("roc_auc"), F.asc_nulls_last("brier"), "model").limit(1)
