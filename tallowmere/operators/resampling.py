"""Resampling without a row a draw: how often a case is drawn is a number of its own.

In a resample of many cases each case is drawn a Poisson number of times, mean 1.  That number is a hash of seed, iteration and case,
so no case is numbered, nothing is joined, and a resample is two sums by stratum, which Spark adds up where the rows lie.
Strata keep their sizes: a stratum's mean under its weights counts with the number of its cases.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import hash_order
from .decisions import replication_class

#: Of 2 ** 28 hashes, those below the k-th number give at most k draws.
_STEPS = [round((1 << 28) * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(10)]


def draws(seed: str, *keys: Column) -> Column:
    """A Poisson number of mean 1, the same for the same seed and keys; 10 at most, which one case in 100 million exceeds."""
    return _drawn(_hashed(seed, *keys))


def _hashed(seed: str, *keys: Column) -> Column:
    return F.substring(hash_order(seed, *keys), 1, 7)


def _drawn(h: Column) -> Column:
    out = F.lit(len(_STEPS))
    for k, step in reversed(list(enumerate(_STEPS))):
        out = F.when(h < f"{step:07x}", k).otherwise(out)  # seven digits compare as their numbers do
    return out


def resampled_means(values: DataFrame, by: Sequence[str], stratum: str, case: str, value: str, iterations: int, seed: str) -> DataFrame:
    """``(by, iteration, mean)``: the mean of ``value`` by group in each resample of the cases within their strata.

    A case has one weight in a resample, whatever group it is in, so groups stay comparable.  A stratum of which nothing is drawn
    counts with its plain mean.  Missing values and cases don't count.  A case's values are added up by group before it is drawn, and it is drawn
    once for all of its groups.
    """
    by = list(by)
    d = values.where(F.col(value).isNotNull() & F.col(case).isNotNull()).select(*by, F.col(stratum).alias("__s"), F.col(case).alias("__c"), F.col(value).cast("double").alias("__v"))
    d = d.groupBy("__c", *by, "__s").agg(F.sum("__v").alias("__t"), F.count("*").alias("__k")).groupBy("__c").agg(F.collect_list(F.struct(*by, "__s", "__t", "__k")).alias("__g"))
    d = d.withColumn("iteration", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))))
    d = d.select("iteration", "__g", _hashed(seed, F.col("iteration"), F.col("__c")).alias("__h"))  # a column of its own: made once, not for each step
    d = d.select("iteration", _drawn(F.col("__h")).alias("__d"), F.explode("__g").alias("__g")).select("iteration", "__d", "__g.*")
    w = F.col("__d")
    s = d.groupBy(*by, "__s", "iteration").agg(F.sum(w * F.col("__k")).alias("__w"), F.sum(w * F.col("__t")).alias("__wv"), F.sum("__k").alias("__n"), (F.sum("__t") / F.sum("__k")).alias("__m"))
    m = F.when(F.col("__w") > 0, F.col("__wv") / F.col("__w")).otherwise(F.col("__m"))
    return s.groupBy(*by, "iteration").agg((F.sum(m * F.col("__n")) / F.sum("__n")).alias("mean"))


def intervals(means: DataFrame, by: Sequence[str], low: float, high: float, value: str = "mean") -> DataFrame:
    """``(by, low, high)``: quantiles over the iterations, which are as many as asked for, however many cases there are."""
    return means.groupBy(*by).agg(F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"))


def noninferiority(pairs: DataFrame, candidate: str, stratum: str, case: str, difference: str, margin: float, iterations: int, seed: str, confidence: float = 0.95) -> DataFrame:
    """By candidate: cases, mean of best minus candidate, its one-sided bounds, and whether the upper one is within the margin."""
    means = resampled_means(pairs, [candidate], stratum, case, difference, iterations, seed)
    own = pairs.where(F.col(difference).isNotNull() & F.col(case).isNotNull()).groupBy(candidate).agg(F.count("*").alias("cases"), F.avg(difference).alias("mean_difference"))
    b = intervals(means, [candidate], 1 - confidence, confidence)
    return own.join(b, candidate).withColumn("non_inferior", F.col("high") <= margin)


def across_studies(first: DataFrame, second: DataFrame, by: str, observed: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Two studies' differences side by side, and the interval of the difference of the differences.

    ``first`` and ``second`` are :func:`resampled_means`, joined iteration by iteration; ``observed(by, first, second)`` are the plain differences.
    Gives each study's interval, ``delta`` (second less first) with its own, whether that excludes 0 (``heterogeneous``), and the class of the replication.
    """
    a, z = (1 - confidence) / 2, (1 + confidence) / 2
    j = first.select(by, "iteration", F.col("mean").alias("m1")).join(second.select(by, "iteration", F.col("mean").alias("m2")), [by, "iteration"]).withColumn("d", F.col("m2") - F.col("m1"))
    ends = [F.percentile(c, q).alias(f"{n}_{e}") for c, n in (("m1", "first"), ("m2", "second"), ("d", "delta")) for e, q in (("low", a), ("high", z))]
    s = j.groupBy(by).agg(*ends).join(observed, by).withColumn("delta", F.col("second") - F.col("first"))
    c = F.col
    s = s.withColumn("heterogeneous", (c("delta_low") > 0) | (c("delta_high") < 0))
    return s.withColumn("replication", replication_class(c("first_low"), c("first_high"), c("second_low"), c("second_high"), c("first"), c("second")))
