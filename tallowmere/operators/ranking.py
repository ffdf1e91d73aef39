"""Ranks, running values, first and best rows, exclusive groups, samples and pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

#: Up to this number of rows a window numbers each group; more are numbered by ranges, whatever groups they belong to.
SMALL = 1_000_000


def average_rank(by: Sequence[str], value: Column) -> Column:
    """The mean of the places that equal values share, from 1."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def competition_rank(by: Sequence[str], value: Column) -> Column:
    """The least of the places that equal values share, largest value first."""
    return F.rank().over(W.partitionBy(*by).orderBy(value.desc_nulls_last()))


def holm(df: DataFrame, by: Sequence[str], p: str, tie: str, name: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within ``by``; missing ones stay missing and don't count as tests."""
    some = df.where(F.col(p).isNotNull())
    order = W.partitionBy(*by).orderBy(F.col(p), F.col(tie))
    m = F.count("*").over(W.partitionBy(*by))
    stepped = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))
    out = some.withColumn("__s", stepped).withColumn(name, F.max("__s").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__s")
    return out.unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def preferred(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in ``order``, which should end in a unique column.

    An aggregate of the least row keeps partial results, so a key that very many rows share is no skew; it
    needs ascending orders without nulls that matter.  For other orders a window ranks the rows.
    """
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def least_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the one least in the columns of ``order``, ascending with nulls first."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__b"))
    return best.select(*keys, *[F.col("__b")[c].alias(c) for c in rest])


def exclusive_groups(df: DataFrame, key: str, groups: Sequence[tuple[str, Column, Sequence[Column], int]]) -> DataFrame:
    """Groups that take their first ``n`` rows in turn, none taken before: ``group`` and ``group_rank`` added.

    Each group is (name, condition, order, n).  The groups are few and ordered; each step is a bounded
    top-n, and what earlier groups took is at most the sum of their n.
    """
    taken = None
    for name, condition, order, n in groups:
        left = df.where(condition)
        if taken is not None:
            left = left.join(taken.select(key), key, "left_anti")
        got = left.orderBy(*order).limit(n)
        got = got.withColumn("group", F.lit(name)).withColumn("group_rank", F.row_number().over(W.orderBy(*order)))
        taken = got if taken is None else taken.unionByName(got)
    return taken


def slices(df: DataFrame, by: str, order: Sequence[Column], n: int = 2) -> DataFrame:
    """``level``: easy for the first ``n`` rows of a stratum, hard for the last, medium for the middle ones; others are left out."""
    rn, cnt = F.row_number().over(W.partitionBy(by).orderBy(*order)), F.count("*").over(W.partitionBy(by))
    d = df.withColumn("__rn", rn).withColumn("__n", cnt)
    start = F.floor((F.col("__n") - n) / 2)
    level = F.when(F.col("__rn") <= n, "easy").when(F.col("__rn") > F.col("__n") - n, "hard").when((F.col("__rn") > start) & (F.col("__rn") <= start + n), "medium")
    return d.withColumn("level", level).where("level is not null").drop("__rn", "__n")


def round_robin(df: DataFrame, stratum: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows, one of each stratum in turn."""
    d = df.withColumn("__d", F.row_number().over(W.partitionBy(stratum).orderBy(*order)))
    return d.orderBy("__d", stratum).limit(n).drop("__d")


def page(df: DataFrame, order: Sequence[tuple[str, bool]], size: int, after: Sequence[object] | None = None) -> DataFrame:
    """A page of keyset pagination with ``has_more``: ``order`` is (column, descending), ``after`` the last row's values."""
    if after is not None:
        past, equal = [], F.lit(True)
        for (c, desc), v in zip(order, after, strict=True):
            past.append(equal & ((F.col(c) < F.lit(v)) if desc else (F.col(c) > F.lit(v))))
            equal = equal & (F.col(c) == F.lit(v))
        df = df.where(reduce(lambda a, b: a | b, past))
    keys = [F.col(c).desc() if d else F.col(c).asc() for c, d in order]
    got = df.orderBy(*keys).limit(size + 1)  # a page is bounded, so is the window over it
    rn = got.withColumn("__rn", F.row_number().over(W.orderBy(*keys)))
    return rn.withColumn("has_more", F.max("__rn").over(W.partitionBy()) > size).where(F.col("__rn") <= size).drop("__rn")


def choose(df: DataFrame, order: Sequence[Column], n: int = 1) -> DataFrame:
    """The lexicographically first rows; give nulls_last orders for nullable criteria."""
    return df.orderBy(*order).limit(n)


def ties(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``tied``: another row of the group has the same value."""
    return df.withColumn("tied", F.count("*").over(W.partitionBy(*by, value)) > 1)


def until_share(df: DataFrame, by: str, mass: Column, order: Sequence[Column], share: float, least: int, most: int) -> DataFrame:
    """The rows of each group up to the one with which the running mass reaches ``share`` of the whole, ``least`` to ``most`` of them.

    ``place``, ``coverage`` (the running share; 0 without mass) are added.
    """
    order_ = W.partitionBy(by).orderBy(*order)
    whole = F.sum("__m").over(W.partitionBy(by))
    d = df.withColumn("__m", F.coalesce(mass, F.lit(0.0))).withColumn("place", F.row_number().over(order_)).withColumn("__w", whole)
    d = d.withColumn("__c", F.sum("__m").over(order_.rowsBetween(W.unboundedPreceding, 0)))
    keep = ((F.col("__c") - F.col("__m") < share * F.col("__w")) | (F.col("place") <= least)) & (F.col("place") <= most)
    return d.where(keep).withColumn("coverage", F.when(F.col("__w") > 0, F.col("__c") / F.col("__w")).otherwise(0.0)).drop("__m", "__w", "__c")


def running_counts(df: DataFrame, by: Sequence[str], order: Sequence[Column], names: dict[str, Column], small: int = SMALL) -> DataFrame:
    """For each name how many rows of the group meet its condition up to and with this one in ``order``; missing where this row doesn't meet it.

    ``order`` must end in what is unique within a group.  Beyond ``small`` rows they are sorted by ranges of group and order,
    and each range goes on from where it starts, so one group may hold all rows.
    """
    by = list(by)
    d = staged(df)
    count = lambda c, w: F.count(F.when(c, 1)).over(w)
    if d.count() <= small:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return d.withColumns({n: F.when(c, count(c, w)).cast("int") for n, c in names.items()})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(d.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "__part").agg(*[F.count(F.when(c, 1)).alias(f"__s_{n}") for n, c in names.items()])
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each group and range
    starts = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in names])
    w = W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    on = [F.col("__part") == F.col("__p"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]]
    own = ranged.withColumns({f"__own_{n}": count(c, w) for n, c in names.items()}).join(starts, on)
    return own.select(*df.columns, *[F.when(c, F.col(f"__own_{n}") + F.col(f"__before_{n}")).cast("int").alias(n) for n, c in names.items()])


def searched(df: DataFrame, searches: dict[str, tuple[dict[str, object], dict[str, tuple[object, object]], Sequence[object] | None]], order: Sequence[str], size: int) -> DataFrame:
    """Several filtered searches of one table in one pass: ``search``, ``place`` from 1 and ``has_more`` with the columns of each search's page.

    A search is (equal values by column, where None filters nothing; ranges by column, from inclusively and to exclusively, None
    open; the values of ``order`` after which its page begins, or None for the first).  Pages come in ``order`` descending, missing values last;
    it ends in a unique column.  A page ends after ``size`` rows.  A row goes to the searches whose filters it meets, and of a search only the first
    ``size`` + 1 of each partition are shuffled.
    """
    found = []
    for name, (equal, ranges, after) in searches.items():
        on = [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
        for c, (low, high) in ranges.items():
            on += [F.col(c) >= F.lit(low)] * (low is not None) + [F.col(c) < F.lit(high)] * (high is not None)
        if after is not None:
            past, same = [], F.lit(True)
            for c, v in zip(order, after, strict=True):
                if v is not None:  # missing values come last, so they lie after every value
                    past.append(same & ((F.col(c) < F.lit(v)) | F.col(c).isNull()))
                same = same & F.col(c).eqNullSafe(F.lit(v))
            on.append(reduce(lambda a, b: a | b, past, F.lit(False)))
        found.append(F.when(reduce(lambda a, b: a & b, on, F.lit(True)), name))
    d = df.select(F.explode(F.array_compact(F.array(*found))).alias("search"), *df.columns)
    w = W.partitionBy("search").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    page = d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size + 1)
    return page.withColumn("has_more", F.max("place").over(W.partitionBy("search")) > size).where(F.col("place") <= size)
