"""Preparing data for a model: splits, leakage checks, imputation, scaling, categories, one-hot columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import hash_order
from .audits import melted
from .quantiles import quantiles

RARE, MISSING, UNKNOWN = "__RARE__", "__MISSING__", "__UNKNOWN__"


def stratified_split(df: DataFrame, key: str, stratum: str, seed: str, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """``split``: train, valid or test, in exact proportion within each stratum, by hash order of the key.

    Rows are ranked within (stratum, two digits of the hash) and the digits' counts summed, so that no task
    ranks a whole stratum.
    """
    d = df.withColumn("__h", hash_order(seed, F.col(key))).withColumn("__b", F.substring("__h", 1, 2))
    n = d.groupBy(stratum, "__b").agg(F.count("*").alias("__n"))
    before = W.partitionBy(stratum).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    n = n.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__all", F.sum("__n").over(W.partitionBy(stratum)))
    n = n.select(F.col(stratum).alias("__s"), F.col("__b").alias("__bb"), "__start", "__all")
    rn = F.row_number().over(W.partitionBy(stratum, "__b").orderBy("__h", key))
    d = d.withColumn("__rn", rn).join(n, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__bb")))
    place = F.col("__start") + F.col("__rn")
    # whole numbers of a thousandth, so that the cut is exact
    cut = lambda share: F.floor((F.col("__all") * round(1000 * share) + 500) / 1000)
    split = F.when(place <= cut(train), "train").when(place <= cut(train + valid), "valid").otherwise("test")
    return d.withColumn("split", split).select(*df.columns, "split")


def split_stats(df: DataFrame, target: str) -> DataFrame:
    """Rows, positives, rate and the gap of the rate from the whole's, by split."""
    n = df.groupBy("split").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col(target).cast("long")), F.lit(0)).alias("positives"))
    whole = W.partitionBy()
    return n.withColumn("rate", F.col("positives") / F.col("rows")).withColumn("gap", F.col("positives") / F.col("rows") - F.sum("positives").over(whole) / F.sum("rows").over(whole))


def overlaps(df: DataFrame, key: str) -> DataFrame:
    """Keys that several splits have."""
    return df.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def suspicious_columns(names: Sequence[str], forbidden: Sequence[str], words: Sequence[str] = ("target", "label", "outcome", "default_flag")) -> list[tuple[str, str]]:
    """(column, why) of names that are forbidden or speak of the target."""
    out = [(n, "forbidden") for n in names if n.lower() in {f.lower() for f in forbidden}]
    return out + [(n, "suspicious") for n in names if any(w in n.lower() for w in words) and n.lower() not in {f.lower() for f in forbidden}]


def target_correlations(long: DataFrame, target: str, threshold: float = 0.80) -> DataFrame:
    """Features whose correlation with the target reaches the threshold in size."""
    return long.groupBy("feature").agg(F.corr("value", F.col(target).cast("double")).alias("correlation")).where(F.abs("correlation") >= threshold)


def imputation(train: DataFrame, numeric: Sequence[str], binary: Sequence[str]) -> DataFrame:
    """One row fitted on the training rows: for each numeric column its exact median, mean and sd (n) after filling; for each binary one its mode, the least of equally frequent ones."""
    med = train.agg(F.lit(1).alias("__one"), *[F.mode(c, True).alias(f"{c}__fill") for c in binary])
    if numeric:
        q = quantiles(melted(train, numeric), ["feature"], "value", [0.5])
        med = med.join(q.agg(*[F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"{c}__fill") for c in numeric]), F.lit(True))  # one row each
    med = med.drop("__one")
    filled = train.select(*numeric).join(F.broadcast(med), F.lit(True))  # one row
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__fill"))
    sd = filled.agg(*[F.avg(v(c)).alias(f"{c}__mean") for c in numeric], *[F.stddev_pop(v(c)).alias(f"{c}__sd") for c in numeric])
    return med.join(sd, F.lit(True)) if numeric else med


def imputed_scaled(df: DataFrame, fitted: DataFrame, numeric: Sequence[str], binary: Sequence[str] = ()) -> DataFrame:
    """Numeric columns filled and standardised by the fitted row (constant ones become 0), binary ones filled."""
    j = df.join(F.broadcast(fitted), F.lit(True))  # one row
    sd = lambda c: F.when(F.col(f"{c}__sd") > 0, F.col(f"{c}__sd")).otherwise(1.0)
    cols = {c: (F.coalesce(F.col(c).cast("double"), F.col(f"{c}__fill")) - F.col(f"{c}__mean")) / sd(c) for c in numeric}
    cols |= {c: F.coalesce(F.col(c), F.col(f"{c}__fill")) for c in binary}
    return j.withColumns(cols).select(df.columns)


def category_levels(train: DataFrame, column: str, least: float = 0.01) -> DataFrame:
    """``(category, rows, share, level)`` of the training rows: what has a smaller share than ``least`` is rare; a null is missing."""
    n = train.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("category")).agg(F.count("*").alias("rows"))
    share = F.col("rows") / F.sum("rows").over(W.partitionBy())
    return n.withColumn("share", share).withColumn("level", F.when((F.col("category") != MISSING) & (F.col("share") < least), RARE).otherwise(F.col("category")))


def encoded_category(df: DataFrame, column: str, levels: DataFrame, name: str) -> DataFrame:
    """``name``: the level of the category, :data:`UNKNOWN` for one that the training rows lack."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    m = levels.select(F.col("category").alias("__c"), F.col("level").alias("__l"))
    return df.join(m, key == F.col("__c"), "left").withColumn(name, F.coalesce("__l", F.lit(UNKNOWN))).drop("__c", "__l")


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """A 0/1 column for each level, with names that are safe and must differ; ``column`` itself goes."""
    names = [f"{column}__{re.sub(r'[^A-Za-z0-9]+', '_', v).strip('_').lower()}" for v in levels]
    if len(set(names)) < len(names):
        raise ValueError(f"levels of {column} have one name: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.withColumns({n: F.when(F.col(column) == v, 1).otherwise(0) for n, v in zip(names, levels, strict=True)}).drop(column)


def with_balanced_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """``name``: n / (k n_c) for k classes present, the weight that gives each class the same total; NULL without a label.

    The classes are counted and their few rows go to where the others lie; no task holds a class.
    """
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__n"))
    k = n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    w = n.join(k, F.lit(True)).select(F.col(label).alias("__label"), (F.col("__all") / (F.col("__k") * F.col("__n"))).alias(name))
    return df.join(F.broadcast(w), F.col(label) == F.col("__label"), "left").drop("__label")  # a row for each class


def kinds(df: DataFrame) -> dict[str, str]:
    """numeric or categorical by a column's type; binary is decided by :func:`binary_columns`."""
    return {f.name: "numeric" if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal") else "categorical" for f in df.schema.fields}


def binary_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns without other values than 0 and 1."""
    aggs = [F.bool_and(F.col(c).isin(0, 1)).alias(c) for c in columns]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(c, F.lit(False)).alias("binary")) for c in columns])).alias("r")).select("r.*")
