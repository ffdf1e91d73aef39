"""Statistics: repeated-measures decomposition, paired tests, resampled intervals, agreement."""

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.identity import draw
from ..session import staged
from ..functions.numeric import count_where, ratio
from .ranking import average_rank

ZERO = 1e-15
#: Up to this many untied differences the signed-rank p-value is exact.
EXACT = 50


# ---- special functions, which Spark lacks -----------------------------------------------------


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_survival(f: float, df1: float, df2: float) -> float:
    """P(F > f); 1 for f <= 0, NaN without degrees of freedom."""
    if not (df1 > 0 and df2 > 0) or f != f:
        return float("nan")
    return 1.0 if f <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


@F.pandas_udf(DoubleType())
def f_pvalue(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The survival function of F; NULL where it is not defined."""
    for f, a, b in batches:
        yield pd.Series([None if (x := f_survival(*v)) != x else x for v in zip(f.fillna(np.nan), a.fillna(0), b.fillna(0), strict=True)], dtype="float64")


def signed_rank_p(differences: Sequence[float]) -> tuple[float, float]:
    """The smaller rank sum and the two-sided p-value of the differences; zeros are dropped.

    Exact (by counting sums of ranks) without ties up to :data:`EXACT` differences, else the normal
    approximation with the correction for ties.  Only zeros: 0 and 1.
    """
    d = np.array([x for x in differences if x is not None and abs(x) > ZERO])
    n = len(d)
    if n == 0:
        return 0.0, 1.0
    size = np.abs(d)
    _, inverse, count = np.unique(size, return_inverse=True, return_counts=True)
    ends = np.cumsum(count)
    ranks = (ends - (count - 1) / 2)[inverse]
    plus = float(ranks[d > 0].sum())
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= EXACT and len(count) == n and len(d) == len(differences):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return w, min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - float((count**3 - count).sum()) / 48
    return w, math.erfc(abs((w - n * (n + 1) / 4) / math.sqrt(var)) / math.sqrt(2)) if var > 0 else 1.0


@F.pandas_udf(StructType([StructField("statistic", DoubleType()), StructField("p", DoubleType())]))
def signed_rank(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The signed-rank test of an array of paired differences: one test's pairs are its cases, tens to thousands."""
    for s in batches:
        yield pd.DataFrame([signed_rank_p(list(x) if x is not None else []) for x in s], columns=["statistic", "p"])


# ---- decomposition ---------------------------------------------------------------------------


#: F where the error's mean square is 0.
LARGEST = sys.float_info.max


def rm_anova(cells: DataFrame, subject: str, a: str, b: str, y: str) -> DataFrame:
    """Sums of squares, degrees of freedom, mean squares, F and partial eta squared of a balanced two-way design.

    ``cells`` has one row for each subject and pair of levels.  One row out for each source: ``a``, ``b`` and
    ``a:b``, each against its interaction with the subject.  Means of each margin are joined to the cells.
    """
    d = cells.select(F.col(subject).alias("s"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(y).cast("double").alias("y"))
    x = d
    for keys in (("s",), ("a",), ("b",), ("s", "a"), ("s", "b"), ("a", "b")):
        m = d.groupBy(*keys).agg(F.avg("y").alias("m_" + "".join(keys)))
        x = x.join(m, list(keys))
    x = x.join(F.broadcast(d.agg(F.avg("y").alias("m"), F.count_distinct("s").alias("ns"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))), F.lit(True))  # one row
    sq = lambda e: F.sum((e) * (e))
    c = F.col
    g = x.agg(
        F.max("ns").alias("ns"), F.max("na").alias("na"), F.max("nb").alias("nb"),
        sq(c("m_a") - c("m")).alias("ss_a"), sq(c("m_b") - c("m")).alias("ss_b"),
        sq(c("m_ab") - c("m_a") - c("m_b") + c("m")).alias("ss_ab"),
        sq(c("m_sa") - c("m_s") - c("m_a") + c("m")).alias("e_a"), sq(c("m_sb") - c("m_s") - c("m_b") + c("m")).alias("e_b"),
        sq(c("y") - c("m_sa") - c("m_sb") - c("m_ab") + c("m_s") + c("m_a") + c("m_b") - c("m")).alias("e_ab"),
    )
    na, nb, ns = c("na") - 1, c("nb") - 1, c("ns") - 1
    rows = F.array(*[F.struct(F.lit(n).alias("source"), c(ss).alias("ss"), df.alias("df"), c(e).alias("ss_error"), (df * ns).alias("df_error")) for n, ss, df, e in (("a", "ss_a", na, "e_a"), ("b", "ss_b", nb, "e_b"), ("a:b", "ss_ab", na * nb, "e_ab"))])
    r = g.select(F.explode(rows).alias("r")).select("r.*")
    effect, error = ratio(c("ss"), c("df")), ratio(c("ss_error"), c("df_error"))
    # without error the effect is as large as a number can be, or there is none
    r = r.withColumn("f", F.when(error > 0, effect / error).when(effect > 0, LARGEST).when(effect.isNotNull() & error.isNotNull(), 0.0))
    return r.withColumn("partial_eta_squared", ratio(c("ss"), c("ss") + c("ss_error"), otherwise=0.0))


def covariances(cells: DataFrame, subject: str, condition: str, y: str) -> DataFrame:
    """``(c1, c2, covariance)`` over subjects of each pair of conditions, which are few."""
    a = cells.select(F.col(subject).alias("s"), F.col(condition).alias("c1"), F.col(y).alias("y1"))
    b = cells.select(F.col(subject).alias("s"), F.col(condition).alias("c2"), F.col(y).alias("y2"))
    return a.join(b, "s").groupBy("c1", "c2").agg(F.covar_samp("y1", "y2").alias("covariance"))


def sphericity_epsilon(cells: DataFrame, subject: str, condition: str, y: str) -> DataFrame:
    """One row, ``epsilon`` (Greenhouse and Geisser's): from the double-centred covariances, clipped to 1/(k - 1) and 1."""
    v = covariances(cells, subject, condition, y)
    everything = W.partitionBy()
    z = v.withColumn("z", F.col("covariance") - F.avg("covariance").over(W.partitionBy("c1")) - F.avg("covariance").over(W.partitionBy("c2")) + F.avg("covariance").over(everything))
    t = z.agg(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("z"))).alias("tr"), F.sum(F.col("z") * F.col("z")).alias("sq"), F.count_distinct("c1").alias("k"))
    e = F.col("tr") * F.col("tr") / F.when(F.col("sq") * (F.col("k") - 1) > 0, F.col("sq") * (F.col("k") - 1))
    return t.select(F.greatest(1 / F.greatest(F.col("k") - 1, F.lit(1)), F.least(F.lit(1.0), F.coalesce(e, F.lit(1.0)))).alias("epsilon"))


def interaction_epsilon(cells: DataFrame, subject: str, a: str, b: str, y: str) -> DataFrame:
    """As :func:`sphericity_epsilon` for the interaction: the cells are first centred by both factors within the subject."""
    ws = lambda *k: W.partitionBy(subject, *k)
    v = F.col(y)
    d = cells.withColumn("__y", v - F.avg(v).over(ws(a)) - F.avg(v).over(ws(b)) + F.avg(v).over(ws()))
    d = d.withColumn("__c", F.concat_ws("|", F.col(a).cast("string"), F.col(b).cast("string")))
    cov = covariances(d, subject, "__c", "__y")
    n = cells.agg(((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"))
    t = cov.agg(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("covariance"))).alias("tr"), F.sum(F.col("covariance") * F.col("covariance")).alias("sq")).join(n, F.lit(True))
    e = F.col("tr") * F.col("tr") / F.when(F.col("sq") * F.col("df") > 0, F.col("sq") * F.col("df"))
    return t.select(F.greatest(1 / F.greatest(F.col("df"), F.lit(1)), F.least(F.lit(1.0), F.coalesce(e, F.lit(1.0)))).alias("epsilon"))


# ---- paired comparisons ----------------------------------------------------------------------


def paired(facts: DataFrame, case: str, condition: str, y: str, contrasts: DataFrame) -> DataFrame:
    """``contrasts(contrast_id, first, second)`` with each case's difference ``d`` = first - second; cases that lack either are left out."""
    a = facts.select(F.col(case).alias("case"), F.col(condition).alias("first"), F.col(y).alias("y1"))
    b = facts.select(F.col(case).alias("case"), F.col(condition).alias("second"), F.col(y).alias("y2"))
    j = a.join(F.broadcast(contrasts), "first").join(b, ["case", "second"])
    return j.select("contrast_id", "first", "second", "case", (F.col("y1") - F.col("y2")).alias("d")).where("d is not null")


def contrast_summary(pairs: DataFrame) -> DataFrame:
    """By contrast: pairs, mean and median difference, sd, and how many are positive, negative or 0."""
    d = F.col("d")
    return pairs.groupBy("contrast_id", "first", "second").agg(F.count("*").alias("pairs"), F.avg(d).alias("mean_difference"), F.percentile("d", 0.5).alias("median_difference"), F.stddev_samp(d).alias("sd_difference"), count_where(d > 0).alias("positive"), count_where(d < 0).alias("negative"), count_where(d == 0).alias("zero"))


def rank_biserial(pairs: DataFrame, by: Sequence[str] = ("contrast_id",), zero: float = 0.0) -> DataFrame:
    """w_plus, w_minus and effect = (W+ - W-) / (W+ + W-); differences up to ``zero`` in size are dropped; 0 if all are."""
    d = pairs.where(F.abs("d") > zero).withColumn("size", F.abs("d"))
    r = d.withColumn("rank", average_rank(by, F.col("size")))
    w = r.groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    out = pairs.select(*by).distinct().join(w, list(by), "left").fillna(0.0, ["w_plus", "w_minus"])
    return out.withColumn("effect", ratio(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus"), otherwise=0.0))


def wilcoxon(pairs: DataFrame, by: Sequence[str] = ("contrast_id",)) -> DataFrame:
    """statistic and p of the signed-rank test by contrast.  A contrast's differences, one a case of the study, are gathered."""
    g = pairs.groupBy(*by).agg(F.array_sort(F.collect_list("d")).alias("ds"))
    return g.withColumn("t", signed_rank("ds")).select(*by, "t.statistic", "t.p")


def places(df: DataFrame, value: str) -> DataFrame:
    """``(value, rank)`` of each distinct value over the whole table, equal ones on their average rank; missing ones have none.

    Equal values are counted, the counts sorted by ranges, and each range goes on from where it starts, so no task has more than a range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(counts.repartitionByRange(parts, value).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum("__n").alias("__sum"))
    before = F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    starts = sums.select(F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.sum("__n").over(W.partitionBy("__part").orderBy(value))
    r = ranged.withColumn("__own", own).join(starts, F.col("__part") == F.col("__p"))
    return r.select(value, (F.col("__start") + F.col("__own") - (F.col("__n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, ``rho``, over the rows that have both; average ranks by :func:`places`."""
    d = staged(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("__x"), F.col(y).alias("__y")))
    r = d.join(places(d, "__x").withColumnRenamed("rank", "rx"), "__x").join(places(d, "__y").withColumnRenamed("rank", "ry"), "__y")
    return r.agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("pairs"))


# ---- resampling ------------------------------------------------------------------------------


def resamples(cases: DataFrame, case: str, iterations: int, seed: str) -> DataFrame:
    """``(iteration, case, weight)``: how often each resample with replacement draws a case.

    Draws are hashes of seed, iteration and draw, so they are alike in every run and for every condition: one
    set of draws keeps the conditions' dependence.  The cases are numbered by ranges; each draw is a row, so for many cases see :mod:`resampling`.
    """
    numbered = staged(places(cases.select(case).distinct(), case).select(case, (F.col("rank") - 1).cast("int").alias("__i")))
    n = numbered.agg(F.count("*").alias("__n"))
    its = cases.sparkSession.range(iterations).withColumnRenamed("id", "iteration")
    draws = its.join(F.broadcast(n), F.lit(True)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    draws = draws.withColumn("__i", draw(seed, F.col("__n"), F.col("iteration"), F.col("k")).cast("int"))
    return draws.groupBy("iteration", "__i").agg(F.count("*").alias("weight")).join(numbered, "__i").select("iteration", case, "weight")


def bootstrap_means(facts: DataFrame, weights: DataFrame, case: str, condition: str, y: str) -> DataFrame:
    """``(condition, iteration, mean)`` of each resample."""
    j = facts.select(case, condition, y).where(F.col(y).isNotNull()).join(weights, case)
    return j.groupBy(condition, "iteration").agg((F.sum(F.col(y) * F.col("weight")) / F.sum("weight")).alias("mean"))


def percentile_interval(means: DataFrame, by: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return means.groupBy(by).agg(F.percentile("mean", low).alias("low"), F.percentile("mean", high).alias("high"), F.avg("mean").alias("centre"))


def difference_bound(means: DataFrame, by: str, candidate: Column, reference: str, level: float = 0.95) -> DataFrame:
    """The one-sided upper bound of reference minus candidate, resample by resample: what non-inferiority compares with its margin."""
    r = means.where(F.col(by) == reference).select("iteration", F.col("mean").alias("__r"))
    return means.where(candidate).join(r, "iteration").groupBy(by).agg(F.percentile(F.col("__r") - F.col("mean"), level).alias("upper_bound"))


# ---- agreement -------------------------------------------------------------------------------


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: items, agreement, expected, kappa (1 if agreement by chance is certain)."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = d.groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count("*").alias("n"))
    left, right = n.groupBy("x").agg(F.sum("n").alias("nx")), n.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("ny"))
    e = left.join(right, "x").agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("e"))
    t = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("same")).join(F.broadcast(e), F.lit(True))
    agreement, expected = ratio(F.col("same"), F.col("items")), ratio(F.col("e"), F.col("items") * F.col("items"))
    return t.select("items", agreement.alias("agreement"), expected.alias("expected")).withColumn("kappa", F.when(F.col("expected") == 1, 1.0).otherwise((F.col("agreement") - F.col("expected")) / F.when(F.col("expected") < 1, 1 - F.col("expected"))))


def class_report(df: DataFrame, truth: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """label, support, precision, recall, f1 by class; ratios are 0 without a denominator."""
    c = lambda x, k: F.col(x).cast("string") == k
    aggs = []
    for i, k in enumerate(classes):
        aggs += [count_where(c(truth, k) & c(predicted, k)).alias(f"tp{i}"), count_where(c(truth, k)).alias(f"t{i}"), count_where(c(predicted, k)).alias(f"p{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"t{i}").alias("support"), F.col(f"p{i}").alias("predicted")) for i, k in enumerate(classes)])
    r = one.select(F.explode(rows).alias("r")).select("r.*")
    r = r.withColumn("precision", ratio(F.col("tp"), F.col("predicted"), 0.0)).withColumn("recall", ratio(F.col("tp"), F.col("support"), 0.0))
    return r.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0)).drop("tp", "predicted")


def class_summary(df: DataFrame, truth: str, predicted: str, classes: Sequence[str], accepted: str) -> DataFrame:
    """One row: macro_f1 over the classes, false_accept_rate (of what is not ``accepted``, how much is predicted so) and false_reject_rate
    (of what is, how much is not).  Rates are 0 without a denominator; rows that lack either label count as another class.
    """
    f1 = class_report(df, truth, predicted, classes).agg(F.avg("f1").alias("macro_f1"))
    is_ = lambda c: F.coalesce(F.col(c).cast("string") == accepted, F.lit(False))
    t, p = is_(truth), is_(predicted)
    rates = df.agg(count_where(~t & p).alias("a"), count_where(~t).alias("na"), count_where(t & ~p).alias("r"), count_where(t).alias("nr"))
    return f1.join(F.broadcast(rates), F.lit(True)).select("macro_f1", ratio(F.col("a"), F.col("na"), 0.0).alias("false_accept_rate"), ratio(F.col("r"), F.col("nr"), 0.0).alias("false_reject_rate"))


def planned_contrasts(spark: SparkSession, models: Sequence[str], levels: Sequence[str], baseline: str) -> DataFrame:
    """The contrast table of a design of models and evidence levels: ``(contrast_id, family, first, second)``, conditions named ``model|level``.

    All pairs of models within each level, then each model's levels against its ``baseline``: 18 and 15 for three models and six levels.
    """
    if baseline not in levels:
        raise ValueError(f"the baseline {baseline} is not among the levels")
    name = lambda m, e: f"{m}|{e}"
    pairs = [("model_within_level", name(a, e), name(b, e)) for e in levels for i, a in enumerate(models) for b in models[i + 1 :]]
    pairs += [("level_against_baseline", name(m, e), name(m, baseline)) for m in models for e in levels if e != baseline]
    return spark.createDataFrame([(f"{a} - {b}", f, a, b) for f, a, b in pairs], "contrast_id string, family string, first string, second string")


def planned_summary(facts: DataFrame, case: str, model: str, level: str, y: str, design: DataFrame) -> DataFrame:
    """Each contrast of :func:`planned_contrasts` with its family, the cases planned, those with both values (pairs) and their differences.

    A contrast without a pair is a row too, with 0 pairs.
    """
    f = facts.withColumn("__c", F.concat_ws("|", F.col(model), F.col(level)))
    planned = f.agg(F.count_distinct(case).alias("planned_pairs"))  # one row
    s = contrast_summary(paired(f, case, "__c", y, design.select("contrast_id", "first", "second"))).drop("first", "second")
    out = design.join(s, "contrast_id", "left").join(F.broadcast(planned), F.lit(True))
    return out.fillna(0, ["pairs", "positive", "negative", "zero"])
