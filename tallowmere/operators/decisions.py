"""Decisions over options: constraints, utility, Pareto frontier, gates, recommendations."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import scaled, sigmoid
from ..session import staged
from .ranking import SMALL, running_counts

TOLERANCE = 1e-12


def long_criteria(options: DataFrame, criteria: Sequence[str], key: str = "option_id") -> DataFrame:
    """``(option_id, criterion_id, value)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("criterion_id"), F.col(c).cast("double").alias("value")) for c in criteria])
    return options.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def constraints(long: DataFrame, rules: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """By scenario and option: constraints, failed (ids joined by ``|`` in their order) and eligible.

    ``rules(scenario_id, criterion_id, minimum_value, maximum_value, criterion_order)`` are few; a missing value
    fails every rule on it.
    """
    v = F.col("value")
    ok = F.coalesce(F.coalesce(v + tolerance >= F.col("minimum_value"), F.col("minimum_value").isNull()) & F.coalesce(v - tolerance <= F.col("maximum_value"), F.col("maximum_value").isNull()) & v.isNotNull(), F.lit(False))
    j = long.join(F.broadcast(rules), "criterion_id").withColumn("ok", ok)
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("criterion_order", "criterion_id"))))
    return j.groupBy("scenario_id", "option_id").agg(F.count("*").alias("constraints"), F.array_join(failed["criterion_id"], "|").alias("failed"), F.bool_and("ok").alias("eligible"))


def available(long: DataFrame, weights: DataFrame, state: DataFrame) -> DataFrame:
    """``(scenario_id, option_id, eligible, score_available)``: an option is scored where it is eligible and lacks none of the scenario's objectives.

    ``weights(scenario_id, criterion_id, direction, weight)`` are a scenario's objectives; ``state`` has
    ``eligible`` by scenario and option, as :func:`constraints` gives it.
    """
    whole = long.join(F.broadcast(weights.select("scenario_id", "criterion_id")), "criterion_id")
    whole = whole.groupBy("scenario_id", "option_id").agg(F.bool_and(F.col("value").isNotNull()).alias("__whole"))
    j = state.select("scenario_id", "option_id", "eligible").join(whole, ["scenario_id", "option_id"])
    return j.select("scenario_id", "option_id", "eligible", (F.col("eligible") & F.col("__whole")).alias("score_available"))


def utility(long: DataFrame, weights: DataFrame, state: DataFrame) -> DataFrame:
    """By scenario and option eligible, score_available and utility, the weighted sum of min-max scaled criteria.

    Each criterion is scaled between its least and greatest value among the scenario's scored options only (see
    :func:`available`); all others have no utility.  Minimised criteria count backwards; a criterion that is
    equal for all scored options counts 1.
    """
    a = available(long, weights, state)
    j = long.join(F.broadcast(weights), "criterion_id").join(a.where("score_available").select("scenario_id", "option_id"), ["scenario_id", "option_id"])
    # a row for each scenario and criterion: as few as the rules
    ends = j.groupBy("scenario_id", "criterion_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = j.join(F.broadcast(ends), ["scenario_id", "criterion_id"])
    level = F.col("hi") - F.col("lo") <= TOLERANCE
    s = scaled(F.col("value"), F.col("lo"), F.col("hi"))
    s = F.when((F.upper("direction") == "MIN") & ~level, 1 - s).otherwise(s)
    u = j.groupBy("scenario_id", "option_id").agg(F.sum(F.col("weight") * s).alias("utility"))
    return a.join(u, ["scenario_id", "option_id"], "left")


def frontier(long: DataFrame, weights: DataFrame, state: DataFrame, **more) -> DataFrame:
    """By scenario and option eligible, score_available, dominated_by, dominates and on_frontier.

    Options compete within a scenario, by its objectives alone, and only those that are scored (see
    :func:`available`); the others dominate nothing and are not on the frontier.  ``more`` goes to :func:`pareto`.
    """
    names = [r["criterion_id"] for r in weights.select("criterion_id").distinct().orderBy("criterion_id").collect()]  # a row for each rule
    sign = F.when(F.upper("direction") == "MIN", -1.0).otherwise(1.0)
    j = long.join(F.broadcast(weights), "criterion_id").withColumn("__v", F.col("value") * sign)
    wide = j.groupBy("scenario_id", "option_id").agg(*[F.max(F.when(F.col("criterion_id") == c, F.col("__v"))).alias(c) for c in names])
    a = available(long, weights, state).join(wide, ["scenario_id", "option_id"])
    # criteria that are no objective of the scenario are equal for all of its options
    point = {c: F.when(F.col("score_available"), F.coalesce(c, F.lit(0.0))) for c in names}
    out = pareto(a.withColumns(point), "scenario_id", "option_id", names, **more)
    return out.select("scenario_id", "option_id", "eligible", "score_available", "dominated_by", "dominates", "on_frontier")


def pareto(options: DataFrame, by: str, key: str, maximise: Sequence[str], minimise: Sequence[str] = (), tolerance: float = TOLERANCE, block: int = 2048) -> DataFrame:
    """``dominated_by``, ``dominates`` (counts) and ``on_frontier`` of the options of each group.

    One option dominates another if it is as good in every criterion and better in one, up to the tolerance.
    Options that lack a criterion take no part: they neither dominate nor are on the frontier.  Equal
    options are one point with a count.  Those as good as a point are counted without being paired (see :func:`_as_good`),
    ``block`` or fewer of a group excepted; less those that are alike up to the tolerance, they are the ones that dominate it.
    """
    c = [*maximise, *minimise]
    v = [f"__v{k}" for k in range(len(c))]
    whole = F.lit(True)
    for x in c:
        whole = whole & F.col(x).isNotNull()
    # greater is better in all of them; no negative zeros
    values = [(F.col(x).cast("double") * (1.0 if x in maximise else -1.0) + 0.0).alias(n) for x, n in zip(c, v, strict=True)]
    base = staged(options.select("*", whole.alias("__whole"), *values))
    points = base.where("__whole").groupBy(by, *v).agg(F.count("*").alias("__n"))
    points = staged(points.withColumn("__id", F.monotonically_increasing_id()))
    worse = points.select(by, *[(-F.col(x)).alias(x) for x in v], "__n", "__id")
    counted = points.join(_alike(points, by, v, tolerance), "__id")
    for name, side in (("dominated_by", points), ("dominates", worse)):
        counted = counted.join(_as_good(side, by, v, tolerance, block), "__id").withColumn(name, F.col("__good") - F.col("__alike")).drop("__good")
    out = base.join(counted.select(by, *v, "dominated_by", "dominates"), [by, *v], "left").fillna(0, ["dominated_by", "dominates"])
    return out.withColumn("on_frontier", F.col("__whole") & (F.col("dominated_by") == 0)).select(*options.columns, "dominated_by", "dominates", "on_frontier")


def _paired(data: DataFrame, asked: DataFrame, on: Sequence[str], by: str, v: Sequence[str], fit: Callable[[Column], Column]) -> DataFrame:
    """``(__id, __n)``: for each point of ``asked`` the counts of those of ``data`` with the same ``on`` whose values less its own all ``fit``."""
    side = lambda d, p: d.select(*[F.col(x).alias(p + x) for x in (by, *on, *v, "__n", "__id")])
    same = [F.col(f"a{x}") == F.col(f"b{x}") for x in (by, *on)]
    # an estimate of what was multiplied is too low, and few bytes are many pairs: no broadcast
    j = side(data, "a").hint("merge").join(side(asked, "b"), reduce(and_, [*same, *[fit(F.col(f"a{x}") - F.col(f"b{x}")) for x in v]]))
    return j.select(F.col("b__id").alias("__id"), F.col("a__n").alias("__n"))


def _alike(points: DataFrame, by: str, v: Sequence[str], tolerance: float) -> DataFrame:
    """``(__id, __alike)``: how many options are equal to a point in every value, up to the tolerance; itself counts."""
    if tolerance <= 0:
        return points.select("__id", F.col("__n").alias("__alike"))
    width, k = 1024 * tolerance, [f"__k{x}" for x in v]
    place = lambda x, d: F.rint((F.col(x) + d * tolerance) / width) + 0.0
    data, asked = points, points
    for x, n in zip(v, k, strict=True):
        data = data.withColumn(n, place(x, 0))
        asked = asked.withColumn(n, F.explode(F.array_distinct(F.array(place(x, -2), place(x, 2)))))
    return _paired(data, asked, k, by, v, lambda gap: gap.between(-tolerance, tolerance)).groupBy("__id").agg(F.sum("__n").alias("__alike"))


def _as_good(points: DataFrame, by: str, v: Sequence[str], tolerance: float, block: int) -> DataFrame:
    """``(__id, __good)``: how many options have no value less than the point's by more than the tolerance; itself counts.

    Quantiles cut each value into numbered cells, a value that is frequent being a cell of its own.  All in a greater cell
    than the point's are as good, and of two different numbers the greater one has a 1 where the other has a 0, behind the
    same leading bits: a node of a binary tree, of which there are as many as the number has bits.  So an option is listed under the nodes of its
    1s, a point asks at those of its 0s, in all values at once, and a node has but a count.  Only options in the point's cell are compared with it.
    The cells grow in number with the points, so the pairs compared grow as these do.
    """
    sizes = points.groupBy(by).count()
    n, m = (x or 0 for x in sizes.agg(F.max("count"), F.sum("count")).first())
    # at most about 512 nodes a point
    cuts = 2 ** min(math.ceil(math.log2(max(1, n / block))), math.floor(2 * (512 ** (1 / len(v)) - 1)))
    edges = points.join(sizes.where(F.col("count") > block), by).groupBy(by).agg(*[F.percentile_approx(x, [k / cuts for k in range(1, cuts + 1)], max(10_000, 8 * cuts)).alias(f"__e{x}") for x in v])
    repeated = lambda es: F.array_distinct(F.filter(es, lambda e, i: (i > 0) & (F.get(es, i - 1) == e)))
    own_edges = {f"__h{x}": repeated(F.col(f"__e{x}")) for x in v} | {f"__e{x}": F.array_distinct(f"__e{x}") for x in v}
    # made by group, not again for each point
    d = points.join(staged(edges.withColumns(own_edges)), by, "left").withColumns({n: F.coalesce(n, F.array().cast("array<double>")) for n in own_edges})

    def first(es: str, less: Callable[[Column], Column]) -> Column:
        """How many of the ascending ``es`` are ``less``, by halving: a point meets as many of them as their number has bits."""
        bits = F.sequence(F.length(F.bin(F.size(es))) - 1, F.lit(0), F.lit(-1))
        return F.aggregate(bits, F.lit(0), lambda a, i: a + F.when(less(F.get(es, a + F.call_function("shiftleft", F.lit(1), i) - 1)), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))

    below = lambda x, edge, frequent: first(f"__e{x}", edge) + first(f"__h{x}", frequent) + 1

    def placing(x: str) -> list[Column]:
        less = lambda e: e - F.col(x) < -tolerance
        own, least = below(x, lambda e: e < F.col(x), lambda e: e <= F.col(x)), below(x, less, less)
        return [own.alias(f"__p{x}"), least.alias(f"__q{x}"), F.length(F.bin(F.size(f"__e{x}") + F.size(f"__h{x}") + 1)).alias(f"__b{x}")]

    d = staged(d.select(by, *v, "__n", "__id", *[c for x in v for c in placing(x)])).repartition(math.ceil(m / 4096) or 1, "__id")
    k = [f"__k{x}" for x in v]

    def places(x: str, number: str, bit: int) -> Column:
        c = F.col(f"__{number}{x}")
        levels = F.filter(F.sequence(F.lit(0), F.col(f"__b{x}") - 1), lambda i: F.getbit(c, i) == bit)
        return F.concat(F.transform(levels, lambda i: i * (1 << 20) + F.call_function("shiftright", c, i + 1)), F.array(-c))

    def listed(number: str, bit: int) -> DataFrame:
        out = d
        for x, name in zip(v, k, strict=True):
            out = out.withColumn(name, F.explode(places(x, number, bit)))
        return out.select(by, *v, "__n", "__id", *k)

    data, asked = listed("p", 1), listed("q", 0)
    equal = reduce(or_, [F.col(x) < 0 for x in k])
    nodes = data.where(~equal).groupBy(by, *k).agg(F.sum("__n").alias("__n"))
    sure = asked.where(~equal).select(by, *k, "__id").hint("merge").join(nodes, [by, *k]).select("__id", "__n")
    near = _paired(data.where(equal), asked.where(equal), k, by, v, lambda gap: gap >= -tolerance)
    return sure.unionByName(near).groupBy("__id").agg(F.sum("__n").alias("__good"))


def ranked(df: DataFrame, by: str, key: str, tie: Sequence[Column] = (), most: int = 3, small: int = SMALL) -> DataFrame:
    """scenario_rank, eligible_rank, pareto_rank, utility_rank and role of options with eligible, score_available, on_frontier and utility.

    Eligible options come first, of these the scored ones, of these the frontier, then by utility; ``tie`` and the
    key settle the rest.  The ranks among the eligible, the frontier and the scored follow the same order
    and are missing for all others.  ``role`` is PRIMARY for the first of the frontier and ALTERNATIVE for the next
    up to ``most``.  Beyond ``small`` options they are numbered by ranges.
    """
    u = F.col("utility").desc_nulls_last()
    order = [F.col("eligible").desc(), F.col("score_available").desc(), F.col("on_frontier").desc(), u, *tie, F.col(key)]
    d = running_counts(df, [by], order, {"scenario_rank": F.lit(True), "eligible_rank": F.col("eligible"), "pareto_rank": F.col("on_frontier")}, small)
    d = running_counts(d, [by], [u, *tie, F.col(key)], {"utility_rank": F.col("score_available")}, small)
    return d.withColumn("role", F.when(F.col("pareto_rank") == 1, "PRIMARY").when(F.col("pareto_rank") <= most, "ALTERNATIVE"))


def non_inferior(bound: Column, margin: float) -> Column:
    return F.coalesce(bound <= margin, F.lit(False))


def replication_class(low1: Column, high1: Column, low2: Column, high2: Column, mean1: Column, mean2: Column) -> Column:
    """REPLICATED (both intervals on one side of 0), CONFLICT (on different sides), DIRECTIONALLY_CONSISTENT (means of one sign) or INCONCLUSIVE."""
    s = lambda lo, hi: F.when(lo > 0, 1).when(hi < 0, -1).otherwise(0)
    a, b = s(low1, high1), s(low2, high2)
    return F.when((a != 0) & (a == b), "REPLICATED").when((a != 0) & (b != 0), "CONFLICT").when(F.signum(mean1) * F.signum(mean2) > 0, "DIRECTIONALLY_CONSISTENT").otherwise("INCONCLUSIVE")


def acceptance(quality: Column, gate: Column, intercept: float, slope: float, threshold: float = 0.9) -> tuple[Column, Column]:
    """The calibrated probability and whether a gated answer is accepted at the threshold."""
    p = sigmoid(F.lit(intercept) + F.lit(slope) * quality)
    return p, F.coalesce(gate & (p >= threshold), F.lit(False))


def certified(artifact: DataFrame, where: dict[str, object], field: str | None, aggregation: str) -> DataFrame:
    """One row ``value``: COUNT_ROWS, SUM, MEAN or DIRECT_SINGLE_ROW of a field over the filtered rows (NULL if not one row)."""
    from .checks import filtered

    d = filtered(artifact, where, none_means_null=True)
    kinds = {"COUNT_ROWS": F.count("*").cast("double")}
    if field is not None:
        v = F.col(field).cast("double")
        kinds |= {"SUM": F.sum(v), "MEAN": F.avg(v), "DIRECT_SINGLE_ROW": F.when(F.count("*") == 1, F.max(v))}
    return d.agg(kinds[aggregation].alias("value"))


def oriented(tests: DataFrame, option: Column, first: str, second: str, effect: str) -> DataFrame:
    """Paired tests in which the option takes part, the effect's sign turned so that positive favours it, and ``verdict`` by the adjusted p (``p_holm``)."""
    t = tests.where((F.col(first) == option) | (F.col(second) == option))
    e = F.when(F.col(first) == option, F.col(effect)).otherwise(-F.col(effect))
    return t.withColumn("oriented", e).withColumn("verdict", F.when(F.col("p_holm") >= 0.05, "no_difference").when(F.col("oriented") > 0, "favours").when(F.col("oriented") < 0, "against").otherwise("no_difference"))
