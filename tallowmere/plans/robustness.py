"""Resampling within strata and across studies, sensitivity suites, and the knee of a trade-off."""

from pyspark.sql import functions as F

from ..operators import resampling, suites
from ..session import staged
from .registry import query, rounded, t

_ITERATIONS, _SEED = 100, "strata"
_DRAWS = "CASE " + " ".join(f"WHEN h < {x} THEN {k}" for k, x in enumerate(resampling._STEPS)) + f" ELSE {len(resampling._STEPS)} END"
_QUALITY = """
    q AS (SELECT c_custkey, c_mktsegment, o_orderpriority AS p, avg(o_totalprice) / 1000 AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
    d AS (SELECT a.c_custkey, a.c_mktsegment, a.p, b.y - a.y AS d FROM q a JOIN q b ON a.c_custkey = b.c_custkey AND b.p = '1-URGENT' AND a.p <> '1-URGENT')"""


def _means_sql(group, seed):
    return f"""
    z AS (SELECT {group}, c_mktsegment, i, d, ('0x' || substr(md5('{seed}:' || i || ':' || c_custkey), 1, 7))::BIGINT AS h FROM d, range({_ITERATIONS}) r(i)),
    s AS (SELECT {group}, c_mktsegment, i, count(*) AS n, avg(d) AS m, sum({_DRAWS}) AS w, sum({_DRAWS} * d) AS wd FROM z GROUP BY ALL),
    m AS (SELECT {group}, i, sum(n * CASE WHEN w > 0 THEN wd / w ELSE m END) / sum(n) AS mean FROM s GROUP BY ALL)"""


def _differences(spark, sf_dir):
    """By customer and priority: the mean price of its urgent orders less that of this priority, in thousands."""
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = o.groupBy("c_custkey", "c_mktsegment", F.col("o_orderpriority").alias("p")).agg((F.avg("o_totalprice") / 1000).alias("y"))
    best = q.where("p = '1-URGENT'").select(F.col("c_custkey").alias("k"), F.col("y").alias("best"))
    return q.where("p <> '1-URGENT'").join(best, F.col("c_custkey") == F.col("k")).select("c_custkey", "c_mktsegment", "p", (F.col("best") - F.col("y")).alias("d"))


@query("WITH " + _QUALITY + "," + _means_sql("p", _SEED) + """
    SELECT p, cases, round(mean_difference, 6) + 0.0 AS mean_difference, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, high <= 10 AS non_inferior
    FROM (SELECT p, count(*) AS cases, avg(d) AS mean_difference FROM d GROUP BY p) JOIN (SELECT p, quantile_cont(mean, 0.05) AS low, quantile_cont(mean, 0.95) AS high FROM m GROUP BY p) USING (p)""")
def stratified_noninferiority(spark, sf_dir):
    """Each priority against the urgent one, customers resampled within their market segments."""
    out = resampling.noninferiority(_differences(spark, sf_dir), "p", "c_mktsegment", "c_custkey", "d", 10.0, _ITERATIONS, _SEED)
    return rounded(out, {"mean_difference": 6, "low": 6, "high": 6})


@query("WITH " + _QUALITY.replace("a.c_mktsegment, a.p,", "a.c_mktsegment, a.p, a.c_custkey % 2 AS half,") + "," + _means_sql("p, half", "studies") + """,
    j AS (SELECT p, i, max(mean) FILTER (half = 0) AS m1, max(mean) FILTER (half = 1) AS m2 FROM m GROUP BY p, i),
    e AS (SELECT p, quantile_cont(m1, 0.025) AS l1, quantile_cont(m1, 0.975) AS h1, quantile_cont(m2, 0.025) AS l2, quantile_cont(m2, 0.975) AS h2, quantile_cont(m2 - m1, 0.025) AS ld, quantile_cont(m2 - m1, 0.975) AS hd FROM j GROUP BY p),
    o AS (SELECT p, avg(d) FILTER (half = 0) AS f, avg(d) FILTER (half = 1) AS g FROM d GROUP BY p),
    y AS (SELECT *, CASE WHEN l1 > 0 THEN 1 WHEN h1 < 0 THEN -1 ELSE 0 END AS s1, CASE WHEN l2 > 0 THEN 1 WHEN h2 < 0 THEN -1 ELSE 0 END AS s2 FROM e JOIN o USING (p))
    SELECT p, round(f, 6) + 0.0 AS first, round(g, 6) + 0.0 AS second, round(l1, 6) + 0.0 AS first_low, round(h1, 6) + 0.0 AS first_high, round(l2, 6) + 0.0 AS second_low, round(h2, 6) + 0.0 AS second_high,
           round(g - f, 6) + 0.0 AS delta, round(ld, 6) + 0.0 AS delta_low, round(hd, 6) + 0.0 AS delta_high, ld > 0 OR hd < 0 AS heterogeneous,
           CASE WHEN s1 <> 0 AND s1 = s2 THEN 'REPLICATED' WHEN s1 <> 0 AND s2 <> 0 THEN 'CONFLICT' WHEN sign(f) * sign(g) > 0 THEN 'DIRECTIONALLY_CONSISTENT' ELSE 'INCONCLUSIVE' END AS replication FROM y""")
def differences_across_studies(spark, sf_dir):
    """The same contrasts in two studies, even and odd customers, and the interval of their difference, resample by resample."""
    d = staged(_differences(spark, sf_dir).withColumn("half", F.col("c_custkey") % 2))
    means = resampling.resampled_means(d, ["p", "half"], "c_mktsegment", "c_custkey", "d", _ITERATIONS, "studies")
    means = staged(means)
    first, second = (means.where(F.col("half") == k) for k in (0, 1))
    observed = d.groupBy("p").agg(F.avg(F.when(F.col("half") == 0, F.col("d"))).alias("first"), F.avg(F.when(F.col("half") == 1, F.col("d"))).alias("second"))
    out = resampling.across_studies(first, second, "p", observed)
    return rounded(out, {c: 6 for c in ("first", "second", "first_low", "first_high", "second_low", "second_high", "delta", "delta_low", "delta_high")})


#: The scenarios of five suites; the first is the primary one.
_SCENARIOS = (
    suites.Scenario("PRIMARY", "ALL_APPLICABLE", "ALL", "supported_share"),
    suites.Scenario("POPULATION", "COMPLETE_CASE", "COMPLETE", "supported_share"),
    suites.Scenario("CLAIM_TYPE", "WITHOUT_T1", "ALL", "supported_share", ("t1",)),
    suites.Scenario("CLAIM_TYPE", "WITHOUT_T2_T3", "ALL", "supported_share", ("t2", "t3")),
    suites.Scenario("CLAIM_TYPE", "WITHOUT_UNKNOWN", "ALL", "supported_share", ("t9",)),
    suites.Scenario("METRIC", "RESOLVED_SHARE", "ALL", "resolved_share"),
    suites.Scenario("METRIC", "SUPPORTED_COUNT", "ALL", "supported_count"),
    suites.Scenario("MARGIN", "WIDE", "ALL", "supported_share", margin=0.01),
    suites.Scenario("SEED", "HALF_1", "HALF_1", "supported_share"),
    suites.Scenario("SEED", "HALF_2", "HALF_2", "supported_share"),
)


def _suite(spark, sf_dir):
    l, o = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "orders")
    c = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_orderpriority", "o_orderstatus", F.concat(F.lit("t"), (F.col("l_linenumber") % 4).cast("string")).alias("claim_type"), "l_returnflag")
    half = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 7), 16, 10).cast("long") % 2
    populations = {"ALL": F.lit(True), "COMPLETE": F.col("o_orderstatus") != "P", "HALF_1": half == 0, "HALF_2": half == 1}
    flag = lambda *x: F.col("l_returnflag").isin(*x).cast("long")
    counted = {"supported": flag("A"), "resolved": flag("A", "R"), "total": F.lit(1)}
    share = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    metrics = {"supported_share": share("supported", "total"), "resolved_share": share("supported", "resolved"), "supported_count": F.col("supported").cast("double")}
    return suites.compared(suites.evaluated(c, "o_orderkey", "o_orderpriority", "claim_type", populations, counted, metrics, _SCENARIOS))


_SUITES_SQL = """
    WITH c AS (SELECT o_orderkey AS u, o_orderpriority AS option, o_orderstatus, 't' || l_linenumber % 4 AS kind, l_returnflag AS f, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 7))::BIGINT % 2 AS half FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    s(i, suite, scenario, population, metric, excluded, margin) AS (VALUES {rows}),
    g AS (SELECT i, suite, scenario, metric, margin, option, u, count(*) AS claims, count(*) FILTER (f = 'A') AS a, count(*) FILTER (f IN ('A', 'R')) AS r FROM c JOIN s
          ON NOT list_contains(excluded, kind) AND CASE population WHEN 'COMPLETE' THEN o_orderstatus <> 'P' WHEN 'HALF_1' THEN half = 0 WHEN 'HALF_2' THEN half = 1 ELSE true END
          WHERE len(excluded) = 0 OR len(list_intersect(excluded, (SELECT list(DISTINCT kind) FROM c))) > 0 GROUP BY ALL),
    o AS (SELECT i, suite, scenario, margin, option, count(CASE metric WHEN 'resolved_share' THEN nullif(r, 0) ELSE 1 END) AS units, sum(claims)::BIGINT AS claims,
                 avg(CASE metric WHEN 'supported_share' THEN a / claims WHEN 'resolved_share' THEN a / nullif(r, 0) ELSE a END) AS value FROM g GROUP BY ALL),
    k AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY round(value, 12) DESC NULLS LAST) AS rank, max(value) OVER (PARTITION BY i) AS best FROM o),
    w AS (SELECT i, first(option ORDER BY rank, option) AS best_option FROM k GROUP BY i),
    x AS (SELECT k.suite, k.scenario, k.option, k.units, k.claims, k.value, k.rank, k.value - p.value AS delta, k.rank - p.rank AS rank_shift, round(k.best - k.value, 12) <= k.margin AS within_margin, best_option,
                 best_option = (SELECT best_option FROM w WHERE i = 0) AS best_stable FROM k LEFT JOIN k p ON p.i = 0 AND p.option = k.option JOIN w ON w.i = k.i)
""".format(rows=", ".join(f"({i}, '{s.suite}', '{s.name}', '{s.population}', '{s.metric}', {list(s.excluded)}::VARCHAR[], {s.margin}::DOUBLE)" for i, s in enumerate(_SCENARIOS)))


@query(_SUITES_SQL + "SELECT suite, scenario, option, units, claims, round(value, 9) AS value, rank, round(delta, 9) + 0.0 AS delta, rank_shift, within_margin, best_option, best_stable FROM x")
def sensitivity_suites(spark, sf_dir):
    """All scenarios of five suites by option, in one pass over the claims, beside the primary scenario."""
    return rounded(_suite(spark, sf_dir), {"value": 9, "delta": 9})


@query(_SUITES_SQL + """SELECT suite, scenario, count(*) AS options, round(max(abs(delta)), 9) AS largest_delta, max(abs(rank_shift)) AS largest_shift, bool_and(best_stable) AS best_stable, min(best_option) AS best_option, max(abs(rank_shift)) = 0 AS order_stable
    FROM x GROUP BY ALL""")
def sensitivity_conclusions(spark, sf_dir):
    """What each scenario changes: the largest difference and shift of rank, and whether the best option stays."""
    return rounded(suites.conclusions(_suite(spark, sf_dir)), {"largest_delta": 9})


@query("""
    WITH p AS (SELECT c_mktsegment AS g, o_orderpriority AS item, avg(n)::DOUBLE AS x, avg(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1, 2),
    d AS (SELECT *, round((y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0) - (x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 12) AS d, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY g)),
    b AS (SELECT g, n, count(DISTINCT x) AS costs, first(item ORDER BY d DESC, item) AS item, max(d) AS d FROM d GROUP BY g, n)
    SELECT g AS c_mktsegment, n AS points, CASE WHEN costs = n AND d IS NOT NULL THEN item END AS o_orderpriority, CASE WHEN costs = n THEN round(d, 9) + 0.0 END AS distance FROM b""")
def tradeoff_knee(spark, sf_dir):
    """By market segment the priority whose orders are worth most for the lines that they have: the knee of lines against price."""
    n = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = t(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey")).join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    points = o.groupBy("c_mktsegment", "o_orderpriority").agg(F.avg("n").alias("cost"), F.avg("o_totalprice").alias("value"))
    return rounded(suites.knee(points, "c_mktsegment", "o_orderpriority", "cost", "value"), {"distance": 9})
