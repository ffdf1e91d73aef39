"""Sensitivity suites as data: a table of scenarios, all evaluated in one pass over the rows.

A scenario names the population, the claim types that it leaves out, the metric and the margin.  A unit is one row of sums, those of each
scenario beside each other, so that one aggregate serves all of them, and their conclusions are compared with the primary one's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged


@dataclass(frozen=True)
class Scenario:
    suite: str
    name: str
    population: str
    metric: str
    excluded: tuple[str, ...] = ()
    margin: float = 0.0


def evaluated(claims: DataFrame, unit: str, option: str, kind: str, populations: Mapping[str, Column], counted: Mapping[str, Column], metrics: Mapping[str, Column], scenarios: Sequence[Scenario]) -> DataFrame:
    """``(suite, scenario, option, units, claims, value, rank)``: the mean of a scenario's metric over an option's units.

    ``claims`` has a row for each claim of a unit; ``populations`` are conditions on a row, ``counted`` numbers that are added up by unit, ``metrics``
    expressions of these sums.  A scenario that leaves out types of which there is none isn't evaluated.
    A unit without a claim left has no value.  The first scenario is the primary one.
    """
    none, names = F.lit(False), list(counted)
    left_out = [F.coalesce(F.col(kind).isin(*s.excluded), none) if s.excluded else none for s in scenarios]
    # scenarios with the same population and types add up the same rows
    cases = list(dict.fromkeys((s.population, s.excluded) for s in scenarios))
    at = [cases.index((s.population, s.excluded)) for s in scenarios]
    kept = [F.coalesce(populations[scenarios[at.index(k)].population] & ~left_out[at.index(k)], none).alias(f"__keep{k}") for k in range(len(cases))]
    held = [left_out[at.index(k)].alias(f"__held{k}") for k in range(len(cases))]
    d = claims.select(F.col(unit).alias("__u"), F.col(option).alias("option"), *[c.alias(f"__{n}") for n, c in counted.items()], *kept, *held)
    sums = [s for k in range(len(cases)) for s in (*[F.sum(F.when(F.col(f"__keep{k}"), F.col(f"__{n}"))).alias(f"__{k}_{n}") for n in names], F.count_if(f"__keep{k}").alias(f"__claims{k}"), F.max(f"__held{k}").alias(f"__held{k}"))]
    u = d.groupBy("option", "__u").agg(*sums)
    rows = [F.struct(F.lit(i).alias("__i"), *[F.col(f"__{k}_{n}").alias(n) for n in names], F.col(f"__claims{k}").alias("__claims"), (F.col(f"__held{k}") if scenarios[i].excluded else F.lit(True)).alias("__held")) for i, k in enumerate(at)]
    u = u.select("option", F.explode(F.array(*rows)).alias("__r")).select("option", "__r.*")
    value = F.lit(None).cast("double")
    for i, s in enumerate(scenarios):
        value = F.when((F.col("__i") == i) & (F.col("__claims") > 0), metrics[s.metric]).otherwise(value)
    o = u.withColumn("__v", value).groupBy("__i", "option").agg(F.count("__v").alias("units"), F.sum("__claims").alias("claims"), F.avg("__v").alias("value"), F.max("__held").alias("__held"))
    # rows from here on are options of scenarios, stored for all that compare them
    o = staged(o)
    known = o.groupBy("__i").agg(F.max("__held").alias("__h")).where("__h").select("__i")
    o = o.drop("__held").where("claims > 0")
    o = o.withColumn("rank", F.rank().over(W.partitionBy("__i").orderBy(F.desc_nulls_last(F.round("value", 12)))))
    table = claims.sparkSession.createDataFrame([(i, s.suite, s.name, s.margin) for i, s in enumerate(scenarios)], "__i int, suite string, scenario string, margin double")
    return o.join(table, "__i").join(known, "__i", "left_semi")


def compared(values: DataFrame) -> DataFrame:
    """:func:`evaluated` rows beside the primary scenario's: deltas, rank shifts, whether an option is within the margin of the best, and whether the best is the same."""
    first = values.where("__i = 0").select("option", F.col("value").alias("primary_value"), F.col("rank").alias("primary_rank"))
    best = values.groupBy("__i").agg(F.max("value").alias("best_value"), F.min(F.struct("rank", "option"))["option"].alias("best_option"))
    own = best.where("__i = 0").select(F.col("best_option").alias("primary_best"))
    j = values.join(first, "option", "left").join(best, "__i").join(F.broadcast(own), F.lit(True))  # one row
    return j.select(
        "suite", "scenario", "option", "units", "claims", "value", "rank", (F.col("value") - F.col("primary_value")).alias("delta"), (F.col("rank") - F.col("primary_rank")).alias("rank_shift"),
        (F.round(F.col("best_value") - F.col("value"), 12) <= F.col("margin")).alias("within_margin"), "best_option", (F.col("best_option") == F.col("primary_best")).alias("best_stable"),
    )


def conclusions(comparison: DataFrame) -> DataFrame:
    """By scenario: options, the largest change and rank shift, and whether best option and order stay."""
    g = comparison.groupBy("suite", "scenario").agg(
        F.count("*").alias("options"), F.max(F.abs("delta")).alias("largest_delta"), F.max(F.abs("rank_shift")).alias("largest_shift"), F.bool_and("best_stable").alias("best_stable"), F.min("best_option").alias("best_option"),
    )
    return g.withColumn("order_stable", F.col("largest_shift") == 0)


def conditional(tests: DataFrame, omnibus: DataFrame, family: str, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Secondary ``tests`` with ``status``: RUN where their family's omnibus test is significant, else NOT_RUN, without omnibus MISSING; only those run keep ``p``."""
    o = omnibus.select(F.col(family).alias("__f"), F.col(p).alias("__p"))
    j = tests.join(o, F.col(family) == F.col("__f"), "left")
    status = F.when(F.col("__f").isNull() | F.col("__p").isNull(), "MISSING").when(F.col("__p") < alpha, "RUN").otherwise("NOT_RUN")
    return j.select(*[c for c in tests.columns if c != p], F.when(status == "RUN", F.col(p)).alias(p), status.alias("status"))


def knee(points: DataFrame, group: str, item: str, cost: str, value: str) -> DataFrame:
    """By group the item furthest above the chord of normalised cost and value: ``(group, points, item, distance)``.

    Costs and values are scaled to 0..1 by the group's least and greatest; distance is value less cost.  NULL where one is missing, costs coincide, or all values are equal;
    of equally far ones the least item.
    """
    w = W.partitionBy(group)
    scale = lambda c: (F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))
    d = points.select(group, item, F.col(cost).cast("double").alias("__x"), F.col(value).cast("double").alias("__y"))
    d = d.withColumn("__d", F.round(scale("__y") - scale("__x"), 12))
    g = d.groupBy(group).agg(
        F.count("*").alias("points"), (F.count_if(F.col("__x").isNull() | F.col("__y").isNull()) == 0).alias("__whole"), F.size(F.collect_set("__x")).alias("__costs"),
        F.min(F.struct((-F.col("__d")).alias("less"), item)).alias("best"),
    )
    ok = F.col("__whole") & (F.col("__costs") == F.col("points")) & F.col("best.less").isNotNull()
    return g.select(group, "points", F.when(ok, F.col(f"best.{item}")).alias(item), F.when(ok, -F.col("best.less")).alias("distance"))
