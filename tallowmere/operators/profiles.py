"""Entity profiles: histories aggregated by entity and joined to the entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import count_where, positive_part, ratio, sum0


def onto_spine(spine: DataFrame, history: DataFrame, key: str, has: str, zero: Sequence[str] = ()) -> DataFrame:
    """One row an entity: the history's columns, ``zero`` ones 0 where it has none, and ``has`` 1 or 0.

    ``history`` has one row a key at most and no null key.
    """
    h = history.where(F.col(key).isNotNull()).withColumn(has, F.lit(1))
    out = spine.join(h, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in [*zero, has]})


def profile(child: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """The measures by key, rows without a key left out."""
    return child.where(F.col(key).isNotNull()).groupBy(key).agg(*[c.alias(n) for n, c in measures.items()])


def two_level(child: DataFrame, low: str, high: str, first: dict[str, Column], second: dict[str, Column]) -> DataFrame:
    """Aggregated by (high, low) and then by high: a mean at the second level is one of means."""
    return profile(child.where(F.col(low).isNotNull()).groupBy(high, low).agg(*[c.alias(n) for n, c in first.items()]), high, second)


def mapped_to_parent(child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The child's rows with their parent's columns; unknown parents are left out."""
    return child.join(parents, key)


def latest(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, which should end in a unique column."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def positive_measures(c: Column, name: str) -> dict[str, Column]:
    """Count, sum, mean and maximum over the positive values only."""
    p = positive_part(c)
    return {f"{name}_count": F.count(p), f"{name}_sum": sum0(p), f"{name}_mean": F.avg(p), f"{name}_max": F.max(p)}


def amounts(c: Column, name: str, kinds: Sequence[str]) -> dict[str, Column]:
    """The named measures of an amount, of ``total`` (0 where all are missing), ``mean``, ``max`` and ``min``."""
    every = {"total": sum0(c), "mean": F.avg(c), "max": F.max(c), "min": F.min(c)}
    return {f"{name}_{k}": every[k] for k in kinds}


def status_counts(c: Column, names: dict[str, object]) -> dict[str, Column]:
    """By name how many rows have the status; a missing one is none of them."""
    return {f"{n}_count": count_where(c == F.lit(v)) for n, v in names.items()}


def history(spine: DataFrame, child: DataFrame, key: str, has: str, measures: dict[str, Column], ratios: dict[str, tuple[str, str | float]], zero: Sequence[str]) -> DataFrame:
    """The whole profile of a history: its ``measures`` by key in one aggregate, then ``ratios`` of these (missing unless the denominator is
    positive; a number is a constant one), onto each entity of the spine; ``zero`` measures are 0 and ``has`` is 0 where there is no history.

    Ratios are taken before entities without history come in, so theirs are missing, not 0.
    """
    h = profile(child, key, measures)
    below = lambda b: F.col(b) if isinstance(b, str) else F.lit(float(b))
    h = h.withColumns({n: ratio(F.col(a), below(b)) for n, (a, b) in ratios.items()})
    return onto_spine(spine, h, key, has, zero)
