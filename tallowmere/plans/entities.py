"""Profiles of entities and the panel target."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import count_where, flag, ratio, row_stats, sum0, unless
from ..operators import panel, profiles
from .registry import query, rounded, t


@query("""
    WITH h AS (
        SELECT o_custkey AS c_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished, sum(o_totalprice) AS total,
               avg(o_totalprice) AS mean_price, max(o_totalprice) AS max_price, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
        FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)
    SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(finished, 0) AS finished, round(coalesce(total, 0), 2) AS total, round(mean_price, 8) AS mean_price,
           max_price, CASE WHEN orders IS NULL THEN 0 ELSE 1 END AS has_order_history, round(CASE WHEN orders > 0 THEN finished / orders END, 6) AS finished_rate,
           round(CASE WHEN c_acctbal > 0 THEN total / c_acctbal END, 4) AS total_to_balance, date_diff('day', first_date, last_date) AS span_days
    FROM customer LEFT JOIN h USING (c_custkey)""")
def entity_history_profile(spark, sf_dir):
    """Each customer's order history: counts and sums 0 without one, ratios missing unless the denominator is positive."""
    o, price = t(spark, sf_dir, "orders"), F.col("o_totalprice")
    h = profiles.profile(o.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", {
        "orders": F.count("*"), "finished": count_where(F.col("o_orderstatus") == "F"), "total": F.sum(price), "mean_price": F.avg(price), "max_price": F.max(price),
        "span_days": F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long"),
    })
    d = profiles.onto_spine(t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), h, "c_custkey", "has_order_history", ["orders", "finished"])
    d = d.withColumns({"finished_rate": ratio(F.col("finished"), F.col("orders")), "total_to_balance": ratio(F.col("total"), F.col("c_acctbal")), "total": F.coalesce("total", F.lit(0.0))})
    return rounded(d.drop("c_acctbal"), {"total": 2, "mean_price": 8, "finished_rate": 6, "total_to_balance": 4})


@query("""
    WITH lo AS (SELECT o_custkey, l_orderkey, count(*) AS n, avg(l_quantity) AS q, max(l_extendedprice) AS m, count(*) FILTER (l_returnflag = 'R') AS r
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT o_custkey, count(*) AS orders, sum(n)::BIGINT AS items, round(avg(q), 6) AS mean_of_mean_quantity, max(m) AS max_price, round(avg(r), 6) AS mean_returned
    FROM lo GROUP BY 1""")
def two_level_rollup(spark, sf_dir):
    """Items by order and then by customer: the second mean is one of means."""
    items = profiles.mapped_to_parent(t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    first = {"n": F.count("*"), "q": F.avg("l_quantity"), "m": F.max("l_extendedprice"), "r": count_where(F.col("l_returnflag") == "R")}
    second = {"orders": F.count("*"), "items": F.sum("n"), "mean_of_mean_quantity": F.avg("q"), "max_price": F.max("m"), "mean_returned": F.avg("r")}
    return rounded(profiles.two_level(items, "o_orderkey", "o_custkey", first, second), {"mean_of_mean_quantity": 6, "mean_returned": 6})


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    SELECT o_custkey, count(*) AS recent, round(avg(o_totalprice), 8) AS mean_price, min(o_orderkey) FILTER (rn = 1) AS last_order, round(stddev_samp(o_totalprice), 4) AS sd_price
    FROM r WHERE rn <= 12 GROUP BY 1""")
def latest_n_per_entity(spark, sf_dir):
    """The last twelve orders of each customer; a single one has no deviation."""
    d = profiles.latest(t(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 12)
    g = d.groupBy("o_custkey").agg(F.count("*").alias("recent"), F.avg("o_totalprice").alias("mean_price"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), F.stddev_samp("o_totalprice").alias("sd_price"))
    return rounded(g, {"mean_price": 8, "sd_price": 4})


@query("""
    SELECT l_suppkey, count(CASE WHEN l_discount > 0 THEN 1 END) AS discount_count, round(coalesce(sum(CASE WHEN l_discount > 0 THEN l_discount END), 0), 2) AS discount_sum,
           round(avg(CASE WHEN l_discount > 0 THEN l_discount END), 6) AS discount_mean, max(CASE WHEN l_discount > 0 THEN l_discount END) AS discount_max,
           count(CASE WHEN l_tax > 0 THEN 1 END) AS tax_count, round(coalesce(sum(CASE WHEN l_tax > 0 THEN l_tax END), 0), 2) AS tax_sum,
           round(avg(CASE WHEN l_tax > 0 THEN l_tax END), 6) AS tax_mean, max(CASE WHEN l_tax > 0 THEN l_tax END) AS tax_max
    FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1""")
def positive_part_profile(spark, sf_dir):
    """Averages and maxima over the positive part only."""
    m = profiles.positive_measures(F.col("l_discount"), "discount") | profiles.positive_measures(F.col("l_tax"), "tax")
    return rounded(profiles.profile(t(spark, sf_dir, "lineitem"), "l_suppkey", m), {"discount_sum": 2, "tax_sum": 2, "discount_mean": 6, "tax_mean": 6})


@query("""
    SELECT o_custkey, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) AS items
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def distinct_contracts(spark, sf_dir):
    j = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return profiles.profile(j, "o_custkey", {"suppliers": F.count_distinct("l_suppkey"), "parts": F.count_distinct("l_partkey"), "items": F.count("*")})


@query("""
    WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b, l_quantity / 50 AS c FROM lineitem),
    v AS (SELECT *, [z FOR z IN [a, b, c] IF z IS NOT NULL] AS w FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, least(a, b, c) AS lo, greatest(a, b, c) AS hi, round(list_avg(w), 6) AS mean, round(list_stddev_samp(w), 6) AS std, 3 - len(w) AS missing
    FROM v""")
def row_stats_query(spark, sf_dir):
    """Statistics across the columns of a row, missing ones (here 0) skipped."""
    zero = lambda c: unless(F.col(c) == 0, F.col(c))
    s = row_stats([zero("l_discount"), zero("l_tax"), F.col("l_quantity") / 50])
    d = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s["min"].alias("lo"), s["max"].alias("hi"), s["mean"].alias("mean"), s["std"].alias("std"), s["missing"].alias("missing"))
    return rounded(d, {"mean": 6, "std": 6})


def _panel(spark, sf_dir):
    """Customers by month as a panel: one row a month with the worst status of its orders."""
    o = t(spark, sf_dir, "orders").withColumn("period", F.date_format("o_orderdate", "yyyyMM"))
    bad = F.max(flag((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 450000)))
    dim = F.max(flag((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 5000)))
    gone = F.max(flag((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 480000)))
    done = F.max(flag((F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") > 470000)))
    p = o.groupBy(F.col("o_custkey").alias("entity"), "period").agg(bad.alias("bad"), dim.alias("dim"), gone.alias("gone"), done.alias("done"))
    status = F.when(F.col("dim") == 1, "XX").when(F.col("bad") == 1, "3").otherwise("0")
    code = F.when(F.col("gone") == 1, "15").when(F.col("done") == 1, "01").otherwise("")
    return p.select("entity", "period", status.alias("status"), code.alias("code"))


@query("""
    WITH p AS (
        SELECT o_custkey AS entity, year(o_orderdate) * 12 + month(o_orderdate) AS m,
               CASE WHEN max((o_orderstatus = 'P' AND o_totalprice < 5000)::INT) = 1 THEN 'XX' WHEN max((o_orderstatus = 'F' AND o_totalprice > 450000)::INT) = 1 THEN '3' ELSE '0' END AS status,
               CASE WHEN max((o_orderpriority = '1-URGENT' AND o_totalprice > 480000)::INT) = 1 THEN '15' WHEN max((o_orderpriority = '5-LOW' AND o_totalprice > 470000)::INT) = 1 THEN '01' END AS code
        FROM orders GROUP BY 1, 2),
    i AS (SELECT *, m - min(m) OVER (PARTITION BY entity) + 1 AS idx FROM p),
    f AS (
        SELECT entity, min(idx) AS first_idx, max(idx) AS last_idx, coalesce(bit_or(CASE WHEN idx <= 12 THEN 1 << (idx - 1)::INT END), 0) AS om,
               coalesce(bit_or(CASE WHEN idx <= 12 AND status = 'XX' THEN 1 << (idx - 1)::INT END), 0) AS um, min(CASE WHEN idx <= 12 AND status = '3' THEN idx END) AS event_idx,
               min(CASE WHEN code IS NOT NULL THEN idx END) AS terminal_idx, arg_min(code, idx) FILTER (code IS NOT NULL) AS tc
        FROM i GROUP BY 1),
    g AS (SELECT *, (1 << greatest(0, least(12, coalesce(terminal_idx, 12)))::INT) - 1 AS need FROM f),
    h AS (SELECT *, CASE WHEN event_idx IS NOT NULL THEN 1
                         WHEN first_idx <= 1 AND ((last_idx >= 12 AND om = 4095 AND um = 0) OR (last_idx < 12 AND coalesce(tc = '01', false) AND om & need = need AND um & need = 0)) THEN 0 END AS target FROM g)
    SELECT entity, target, event_idx, terminal_idx, bit_count(om::BIGINT)::BIGINT AS observed_months,
           CASE WHEN target IS NULL THEN CASE
               WHEN first_idx > 1 THEN 'left_censored_after_payment_month_1' WHEN last_idx >= 12 AND om <> 4095 THEN 'missing_month_inside_12m_horizon'
               WHEN last_idx >= 12 AND um <> 0 THEN 'unknown_delinquency_inside_12m_horizon' WHEN tc = '01' AND om & need <> need THEN 'missing_month_before_voluntary_payoff'
               WHEN tc = '01' AND um & need <> 0 THEN 'unknown_status_before_voluntary_payoff' WHEN tc = '15' THEN 'non_outcome_termination_15' ELSE 'insufficient_12m_observation' END END AS censor_reason
    FROM h""")
def panel_target_12m(spark, sf_dir):
    """The twelve-month target of each customer, with the reason of censoring."""
    p = _panel(spark, sf_dir)
    anchors = p.groupBy("entity").agg(F.min("period").alias("first_period"))
    return panel.panel_target(p, anchors).select("entity", "target", "event_idx", "terminal_idx", "observed_months", "censor_reason")


@query("""
    WITH p AS (SELECT DISTINCT o_custkey AS entity, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders),
    s AS (SELECT *, m - lag(m) OVER (PARTITION BY entity ORDER BY m) AS step FROM p)
    SELECT entity, m::INT AS ordinal, step::INT AS step FROM s WHERE step <> 1""")
def panel_gap_check(spark, sf_dir):
    """Months that do not follow the previous one of their customer."""
    d = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("ordinal")).distinct()
    return panel.gaps(d, "entity", "ordinal")


@query("""
    WITH d AS (SELECT o_custkey, o_orderstatus, o_totalprice,
                      CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS big FROM orders)
    SELECT o_custkey, count(*) AS orders, sum(big)::BIGINT AS big_orders, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS finished_sum,
           round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 8) AS finished_mean
    FROM d GROUP BY 1""")
def conditional_profile(spark, sf_dir):
    """Sums over nothing are 0, means over nothing are missing."""
    o = t(spark, sf_dir, "orders")
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    d = profiles.profile(o, "o_custkey", {"orders": F.count("*"), "big_orders": F.sum(flag(F.col("o_totalprice") > 400000)).cast("long"), "finished_sum": sum0(done), "finished_mean": F.avg(done)})
    return rounded(d, {"finished_sum": 2, "finished_mean": 8})


@query("""
    WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS running,
                      max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS highest FROM orders)
    SELECT o_custkey, o_orderkey, round(running, 2) AS running, highest FROM o""")
def running_values(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    d = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum("o_totalprice").over(w).alias("running"), F.max("o_totalprice").over(w).alias("highest"))
    return rounded(d, {"running": 2})


# ---- whole profiles --------------------------------------------------------------------------

_CREDIT = ("record_count", "loan_count", "active_count", "closed_count", "sold_count", "late_count", "overdue_count", "recent_count", "credit_total", "debt_total", "limit_total", "overdue_total")


@query("""
    WITH l AS (SELECT o_custkey, l_linenumber, l_returnflag, l_linestatus, l_extendedprice AS credit, CASE WHEN l_discount > 0 THEN l_extendedprice * l_discount END AS debt, CASE WHEN l_linestatus = 'O' THEN l_quantity * 1000 END AS lim, CASE WHEN l_tax > 0.04 THEN l_extendedprice * l_tax END AS over,
                      -date_diff('day', l_shipdate::DATE, DATE '2002-01-01') AS days, greatest(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - 60, 0) AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity > 40),
    h AS (SELECT o_custkey AS c_custkey, count(l_linenumber) AS record_count, count(l_linenumber) AS loan_count, count(*) FILTER (l_returnflag = 'A') AS active_count, count(*) FILTER (l_returnflag = 'N') AS closed_count, count(*) FILTER (l_returnflag = 'R') AS sold_count, count(*) FILTER (l_linestatus = 'F') AS late_count,
                 count(*) FILTER (late > 0) AS overdue_count, max(late) AS days_overdue_max, avg(late) AS days_overdue_mean, coalesce(sum(credit), 0) AS credit_total, avg(credit) AS credit_mean, max(credit) AS credit_max, coalesce(sum(debt), 0) AS debt_total, avg(debt) AS debt_mean, max(debt) AS debt_max,
                 coalesce(sum(lim), 0) AS limit_total, avg(lim) AS limit_mean, coalesce(sum(over), 0) AS overdue_total, max(over) AS overdue_max, avg(days) AS days_mean, min(days) AS days_min, max(days) AS days_max, count(*) FILTER (days >= -365) AS recent_count FROM l GROUP BY 1)
    SELECT c_custkey, coalesce(record_count, 0) AS record_count, coalesce(loan_count, 0) AS loan_count, coalesce(active_count, 0) AS active_count, coalesce(closed_count, 0) AS closed_count, coalesce(sold_count, 0) AS sold_count, coalesce(late_count, 0) AS late_count, coalesce(overdue_count, 0) AS overdue_count, coalesce(recent_count, 0) AS recent_count,
           days_overdue_max, round(days_overdue_mean, 6) AS days_overdue_mean, round(coalesce(credit_total, 0), 2) AS credit_total, round(credit_mean, 8) AS credit_mean, credit_max, round(coalesce(debt_total, 0), 6) AS debt_total, round(debt_mean, 8) AS debt_mean, round(debt_max, 4) AS debt_max, coalesce(limit_total, 0) AS limit_total, round(limit_mean, 8) AS limit_mean,
           round(coalesce(overdue_total, 0), 6) AS overdue_total, round(overdue_max, 4) AS overdue_max, round(days_mean, 6) AS days_mean, days_min, days_max, round(CASE WHEN credit_total > 0 THEN debt_total / credit_total END, 6) AS debt_to_credit, round(-days_min / 30, 6) AS history_months, (h.c_custkey IS NOT NULL)::INT AS has_credit_history
    FROM customer LEFT JOIN h USING (c_custkey)""")
def credit_history_profile(spark, sf_dir):
    """23 measures and 2 ratios of each customer's large urgent items; many customers have none."""
    o = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderdate")
    i = profiles.mapped_to_parent(t(spark, sf_dir, "lineitem").where("l_quantity > 40").withColumnRenamed("l_orderkey", "o_orderkey"), o, "o_orderkey").withColumnRenamed("o_custkey", "c_custkey")
    days, late, price = -F.datediff(F.lit("2002-01-01").cast("date"), F.col("l_shipdate").cast("date")).cast("long"), F.greatest(F.datediff("l_shipdate", "o_orderdate").cast("long") - 60, F.lit(0)), F.col("l_extendedprice")
    m = {"record_count": F.count("l_linenumber"), "loan_count": F.count("l_linenumber"), **profiles.status_counts(F.col("l_returnflag"), {"active": "A", "closed": "N", "sold": "R"}), **profiles.status_counts(F.col("l_linestatus"), {"late": "F"})}
    m |= {"overdue_count": count_where(late > 0), "recent_count": count_where(days >= -365)} | profiles.amounts(late, "days_overdue", ["max", "mean"]) | profiles.amounts(price, "credit", ["total", "mean", "max"])
    m |= profiles.amounts(F.when(F.col("l_discount") > 0, price * F.col("l_discount")), "debt", ["total", "mean", "max"]) | profiles.amounts(F.when(F.col("l_linestatus") == "O", F.col("l_quantity") * 1000), "limit", ["total", "mean"])
    m |= profiles.amounts(F.when(F.col("l_tax") > 0.04, price * F.col("l_tax")), "overdue", ["total", "max"]) | profiles.amounts(days, "days", ["mean", "min", "max"]) | {"__past": -F.min(days)}
    out = profiles.history(t(spark, sf_dir, "customer").select("c_custkey"), i, "c_custkey", "has_credit_history", m, {"debt_to_credit": ("debt_total", "credit_total"), "history_months": ("__past", 30)}, _CREDIT).drop("__past")
    return rounded(out, {"days_overdue_mean": 6, "credit_total": 2, "credit_mean": 8, "debt_total": 6, "debt_mean": 8, "debt_max": 4, "limit_mean": 8, "overdue_total": 6, "overdue_max": 4, "days_mean": 6, "debt_to_credit": 6, "history_months": 6})


@query("""
    WITH h AS (SELECT l_suppkey AS s_suppkey, count(*) AS application_count, count(*) FILTER (l_returnflag = 'N') AS approved_count, count(*) FILTER (l_returnflag = 'R') AS refused_count, count(*) FILTER (l_returnflag = 'A') AS canceled_count, count(*) FILTER (l_returnflag = 'U') AS unused_count,
                 avg(l_extendedprice) AS credit_mean, max(l_extendedprice) AS credit_max, sum(l_extendedprice) AS credit_total, avg(l_quantity) AS annuity_mean, max(l_quantity) AS annuity_max, avg(l_extendedprice * (1 - l_discount)) AS asked_mean, sum(l_extendedprice * (1 - l_discount)) AS asked_total,
                 avg(-date_diff('day', l_shipdate::DATE, DATE '2002-01-01')) AS decision_mean, count(*) FILTER (date_diff('day', l_shipdate::DATE, DATE '2002-01-01') <= 365) AS recent_count, count(*) FILTER (l_linenumber = 1) AS cash_count, count(*) FILTER (l_linenumber = 2) AS consumer_count, count(*) FILTER (l_linenumber = 3) AS revolving_count FROM lineitem GROUP BY 1)
    SELECT s_suppkey, application_count, approved_count, refused_count, canceled_count, unused_count, round(credit_mean, 8) AS credit_mean, credit_max, round(credit_total, 2) AS credit_total, round(annuity_mean, 6) AS annuity_mean, annuity_max, round(asked_mean, 8) AS asked_mean, round(asked_total, 6) AS asked_total,
           round(decision_mean, 6) AS decision_mean, recent_count, cash_count, consumer_count, revolving_count, round(approved_count / application_count, 6) AS approval_ratio, round(refused_count / application_count, 6) AS refusal_ratio, round(canceled_count / application_count, 6) AS canceled_ratio, round(credit_total / asked_total, 6) AS credit_to_asked,
           1 AS has_application_history FROM supplier JOIN h USING (s_suppkey)""")
def application_history_profile(spark, sf_dir):
    """17 measures and 4 ratios of the items that each supplier sold."""
    i, price = t(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey"), F.col("l_extendedprice")
    days, asked = -F.datediff(F.lit("2002-01-01").cast("date"), F.col("l_shipdate").cast("date")), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    m = {"application_count": F.count("*"), **profiles.status_counts(F.col("l_returnflag"), {"approved": "N", "refused": "R", "canceled": "A", "unused": "U"}), **profiles.status_counts(F.col("l_linenumber"), {"cash": 1, "consumer": 2, "revolving": 3})}
    m |= profiles.amounts(price, "credit", ["mean", "max", "total"]) | profiles.amounts(F.col("l_quantity"), "annuity", ["mean", "max"]) | profiles.amounts(asked, "asked", ["mean", "total"]) | profiles.amounts(days, "decision", ["mean"]) | {"recent_count": count_where(days >= -365)}
    ratios = {"approval_ratio": ("approved_count", "application_count"), "refusal_ratio": ("refused_count", "application_count"), "canceled_ratio": ("canceled_count", "application_count"), "credit_to_asked": ("credit_total", "asked_total")}
    zero = [c for c in m if c.endswith(("_count", "_total"))]
    out = profiles.history(t(spark, sf_dir, "supplier").select("s_suppkey"), i, "s_suppkey", "has_application_history", m, ratios, zero)
    return rounded(out, {"credit_mean": 8, "credit_total": 2, "annuity_mean": 6, "asked_mean": 8, "asked_total": 6, "decision_mean": 6} | dict.fromkeys(ratios, 6))


@query("""
    WITH l AS (SELECT *, CASE WHEN l_tax > 0 THEN l_discount / l_tax END AS relief, CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END AS unit FROM lineitem),
    h AS (SELECT l_partkey, count(l_linenumber) AS months, avg(l_extendedprice) AS balance_mean, max(l_extendedprice) AS balance_max, min(l_extendedprice) AS balance_min, avg(relief) AS relief_mean, max(relief) AS relief_max, min(relief) AS relief_min, avg(unit) AS unit_mean, max(unit) AS unit_max,
                 sum(l_quantity) AS drawings_total, avg(l_quantity) AS drawings_mean, count(*) FILTER (l_discount > 0.05) AS late_count, count(*) FILTER (l_returnflag = 'R') AS returned_count FROM l GROUP BY 1)
    SELECT p_partkey, coalesce(months, 0) AS months, round(balance_mean, 8) AS balance_mean, balance_max, balance_min, round(relief_mean, 9) AS relief_mean, round(relief_max, 9) AS relief_max, round(relief_min, 9) AS relief_min, round(unit_mean, 6) AS unit_mean, round(unit_max, 9) AS unit_max, coalesce(drawings_total, 0) AS drawings_total,
           round(drawings_mean, 6) AS drawings_mean, coalesce(late_count, 0) AS late_count, coalesce(returned_count, 0) AS returned_count, round(late_count / months, 6) AS late_ratio, (months IS NOT NULL)::INT AS has_card_history FROM part LEFT JOIN h ON p_partkey = l_partkey""")
def utilisation_profile(spark, sf_dir):
    """Ratios of each item, then their mean, greatest and least by part; an item whose denominator is not positive has none."""
    i = t(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    i = i.withColumns({"relief": ratio(F.col("l_discount"), F.col("l_tax")), "unit": ratio(F.col("l_extendedprice"), F.col("l_quantity"))})
    m = {"months": F.count("l_linenumber"), **profiles.amounts(F.col("l_extendedprice"), "balance", ["mean", "max", "min"]), **profiles.amounts(F.col("relief"), "relief", ["mean", "max", "min"]), **profiles.amounts(F.col("unit"), "unit", ["mean", "max"])}
    m |= profiles.amounts(F.col("l_quantity"), "drawings", ["total", "mean"]) | {"late_count": count_where(F.col("l_discount") > 0.05)} | profiles.status_counts(F.col("l_returnflag"), {"returned": "R"})
    out = profiles.history(t(spark, sf_dir, "part").select("p_partkey"), i, "p_partkey", "has_card_history", m, {"late_ratio": ("late_count", "months")}, ["months", "drawings_total", "late_count", "returned_count"])
    return rounded(out, {"balance_mean": 8, "relief_mean": 9, "relief_max": 9, "relief_min": 9, "unit_mean": 6, "unit_max": 9, "drawings_mean": 6, "late_ratio": 6})
