"""Exact quantiles of groups of any size, by counted values and running totals instead of a buffer a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

#: Distinct values up to this number are totalled by group; more are sorted by ranges, whatever groups they belong to.
SMALL = 1_000_000


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], discrete: bool = False, small: int = SMALL, times: str | None = None) -> DataFrame:
    """``by``, ``present``, ``distinct`` and ``q``: how many values, how many different ones, and the quantiles for ``shares``.

    Quantiles are linear between neighbours, or with ``discrete`` the least value whose share is reached.  Missing
    values don't count; a group without values has no row.  Equal values are counted first; rows that are counts already
    name the column of their ``times``.  Beyond
    ``small`` of them the counts are sorted by ranges of group and value, each range is totalled from where it
    starts, and no task has more than a range: one group may hold all rows.
    """
    by = list(by)
    v = F.col(value) if discrete else F.col(value).cast("double")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, v.alias("__v")).agg((F.sum(times) if times else F.count("*")).alias("__n"))
    counts = staged(counts)
    if counts.count() <= small:
        group = W.partitionBy(*by)
        d = counts.withColumn("__end", F.sum("__n").over(group.orderBy("__v"))).withColumn("__all", F.sum("__n").over(group))
    else:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = staged(counts.repartitionByRange(parts, *by, "__v").withColumn("__part", F.spark_partition_id()))
        group = W.partitionBy(*by)
        sums = ranged.groupBy(*by, "__part").agg(F.sum("__n").alias("__n"))
        before = F.sum("__n").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
        starts = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__start"), F.sum("__n").over(group).alias("__all"))
        own = F.sum("__n").over(W.partitionBy(*by, "__part").orderBy("__v"))
        on = [F.col("__part") == F.col("__p"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]]
        d = ranged.withColumn("__own", own).join(starts, on).withColumn("__end", F.col("__own") + F.col("__start"))
    first = F.col("__end") - F.col("__n")
    at = lambda place: F.max(F.when((first <= place) & (place < F.col("__end")), F.col("__v")))
    found = []
    for s in shares:
        if discrete:
            found.append(at(F.greatest(F.ceil(s * F.col("__all")) - 1, F.lit(0))))
            continue
        place = F.lit(float(s)) * (F.col("__all") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        found.append(low + (high - low) * part)
    return d.groupBy(*by).agg(F.sum("__n").alias("present"), F.count("*").alias("distinct"), F.array(*found).alias("q"))


def with_quantiles(groups: DataFrame, df: DataFrame, by: Sequence[str], value: str, names: Mapping[str, float], discrete: bool = False, times: str | None = None) -> DataFrame:
    """``groups``, a row for each group of ``df``, with a quantile of ``value`` under each name; missing where the group has no value."""
    q = quantiles(df, by, value, list(names.values()), discrete, times=times)
    q = q.select(*[F.col(c).alias(f"__{c}") for c in by], *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    # without groups both sides have one row at most
    return groups.join(q, on if by else F.lit(True), "left").drop(*[f"__{c}" for c in by])
