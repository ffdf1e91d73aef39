"""Marts, matrices, group summaries, gates and selections."""

from pyspark.sql import functions as F

from ..functions import texts
from ..functions.identity import scoped
from ..functions.numeric import count_where, outcome
from ..operators import audits, claims, decisions, evidence, generations, mart, matching, matrix, metrics, oplog, selection, statistics, summaries
from .audit import _STATS
from .explanation import _CLAIMS, _claims, safe_phrase_match
from .registry import ORACLE_SQL, query, rounded, t
from .summary import _GENERATIONS, _generations

_REASONS = ", ".join(f"('{r}', '{f}', {f"'{s}'" if s else 'NULL'})" for r, f, s in claims.REASONS)


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE c_custkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0 END AS active, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS segment,
           'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS nation_code FROM customer""")
def policy_normalised(spark, sf_dir):
    """Raw texts under a policy for each column; a value outside of it would fail the query."""
    k = F.col("c_custkey")
    d = t(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 11 == 0, " 9999 ").otherwise(F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).alias("balance"), F.when(k % 3 == 0, "Y").when(k % 3 == 1, "N ").otherwise("").alias("active"),
        F.when(k % 13 == 0, "NA").otherwise(F.concat(F.col("c_mktsegment"), F.lit(" "))).alias("segment"), F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("nation_code"),
    )
    policies = {
        "balance": matrix.Policy("numeric", ("9999", ""), least=-1000.0, most=10_000.0), "active": matrix.Policy("binary", ("",), mapping={"Y": 1, "N": 0}),
        "segment": matrix.Policy("categorical", ("NA",), allowed=("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")), "nation_code": matrix.Policy("categorical_regex", pattern="N[0-9]{2}"),
    }
    return d.select("c_custkey", *[matrix.normalised(F.col(c), c, p).alias(c) for c, p in policies.items()])


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus, o.o_orderkey IS NOT NULL AS order_found, p_brand, p.p_partkey IS NOT NULL AS part_found, s_nationkey, s.s_suppkey IS NOT NULL AS supplier_found
    FROM lineitem LEFT JOIN orders o ON l_orderkey = o_orderkey AND o_orderkey % 7 <> 3 LEFT JOIN part p ON l_partkey = p_partkey AND p_partkey % 10 <> 4 LEFT JOIN supplier s ON l_suppkey = s_suppkey""")
def star_enrichment(spark, sf_dir):
    """Items with what three dimensions say of them, and whether each dimension knows them."""
    o = t(spark, sf_dir, "orders").where("o_orderkey % 7 <> 3").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    p = t(spark, sf_dir, "part").where("p_partkey % 10 <> 4").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    i = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return mart.enriched(i, [("order", o, "l_orderkey"), ("part", p, "l_partkey"), ("supplier", s, "l_suppkey")])


@query("""
    WITH o AS (SELECT o_custkey AS k, count(*) AS orders, sum(o_totalprice) AS spent FROM orders GROUP BY 1), s AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') / count(*) AS finished FROM orders GROUP BY 1)
    SELECT c_custkey, c_acctbal, orders, round(spent, 2) AS spent, round(finished, 6) AS finished, c_acctbal < 0 AS target FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN s ON s.k = c_custkey""")
def feature_matrix(spark, sf_dir):
    """Groups of features joined to the customers under guards, and the target aligned with them."""
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    groups = {
        "orders": o.groupBy("c_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent")),
        "status": o.groupBy("c_custkey").agg((count_where(F.col("o_orderstatus") == "F") / F.count("*")).alias("finished")),
    }
    x = matrix.feature_matrix(c.select("c_custkey", "c_acctbal"), "c_custkey", groups)
    return rounded(matrix.aligned(x, c.select("c_custkey", (F.col("c_acctbal") < 0).alias("target")), ["c_custkey"]), {"spent": 2, "finished": 6})


_COUNTED = _CLAIMS.format(reasons=_REASONS) + """
    , z AS (SELECT split_part(claim_id, '-', 1)::BIGINT AS package_id, claim_type, reason_code, validation_status AS st FROM r JOIN v USING (reason_code)) """


@query(_COUNTED + f"""
    SELECT package_id, count(*) AS claim_count, count(*) FILTER (st = 'SUPPORTED') AS supported_count, count(*) FILTER (st = 'UNSUPPORTED') AS unsupported_count, count(*) FILTER (st = 'CONTRADICTED') AS contradicted_count, count(*) FILTER (st = 'NOT_VERIFIABLE') AS not_verifiable_count,
           count(*) FILTER (st = 'NOT_APPLICABLE') AS not_applicable_count, count(*) FILTER (st IN ('SUPPORTED', 'UNSUPPORTED', 'CONTRADICTED')) AS resolved_count, count(*) FILTER (st IN ('SUPPORTED', 'UNSUPPORTED', 'CONTRADICTED', 'NOT_VERIFIABLE')) AS applicable_count,
           count(*) FILTER (reason_code IN ('SEMANTIC_SOURCE_UNFROZEN', 'SEMANTIC_SUBTYPE_UNRESOLVED')) AS semantic_unresolved_count, count(*) FILTER (reason_code IN ('CAUSAL_OVERCLAIM', 'GUARANTEE_OVERCLAIM', 'CERTAINTY_OVERCLAIM')) AS policy_violation_count,
           count(DISTINCT claim_type) AS claim_type_count, {", ".join(f"count(*) FILTER (claim_type = '{k}') AS {k}_claim_count" for k in claims.TYPES)} FROM z GROUP BY 1""")
def claim_type_counts(spark, sf_dir):
    """Each package's claims by status, by what they leave open, and by type."""
    c = claims.validated(*_claims(spark, sf_dir))
    return mart.claim_counts(c, "package_id", claims.TYPES)


@query(_COUNTED + """
    , k AS (SELECT *, package_id % 4 <> 0 AS exposed, package_id % 3 <> 0 AS eligible, CASE package_id % 6 WHEN 1 THEN 'EXACT' WHEN 2 THEN 'CONTAINED' WHEN 4 THEN 'HIGH_OVERLAP' ELSE 'NONE' END AS m FROM z),
    gg AS (SELECT claim_type, count(*) AS claims, count(*) FILTER (st = 'SUPPORTED') AS s, count(*) FILTER (st = 'UNSUPPORTED') AS u, count(*) FILTER (st = 'CONTRADICTED') AS c, count(*) FILTER (st = 'NOT_VERIFIABLE') AS v, count(*) FILTER (st = 'NOT_APPLICABLE') AS n,
                 count(*) FILTER (exposed) AS exposed, count(*) FILTER (eligible) AS e, count(*) FILTER (eligible AND m = 'EXACT') AS m1, count(*) FILTER (eligible AND m = 'CONTAINED') AS m2, count(*) FILTER (eligible AND m = 'HIGH_OVERLAP') AS m3, count(*) FILTER (eligible AND m = 'NONE') AS m4 FROM k GROUP BY 1),
    hh AS (SELECT *, s + u + c AS r, s + u + c + v AS a FROM gg)
    SELECT claim_type, claims, a AS applicable, r AS resolved, s AS supported, v AS not_verifiable, u AS unsupported, c AS contradicted, n AS not_applicable, round(s / nullif(r, 0), 6) AS resolved_faithfulness, round(r / nullif(a, 0), 6) AS verifiability, round(s / nullif(a, 0), 6) AS conservative_faithfulness,
           round(v / nullif(a, 0), 6) AS not_verifiable_rate, round(u / nullif(a, 0), 6) AS unsupported_rate, round(c / nullif(a, 0), 6) AS contradiction_rate, round((u + c) / nullif(r, 0), 6) AS resolved_error_rate, exposed, e AS eligible, round((m1 + m2 + m3) / nullif(e, 0), 6) AS matched_rate,
           m1 AS best_exact, round(m1 / nullif(e, 0), 6) AS best_exact_rate, m2 AS best_contained, round(m2 / nullif(e, 0), 6) AS best_contained_rate, m3 AS best_high_overlap, round(m3 / nullif(e, 0), 6) AS best_high_overlap_rate, m4 AS best_none, round(m4 / nullif(e, 0), 6) AS best_none_rate FROM hh""")
def claim_group_summary(spark, sf_dir):
    k = F.col("package_id") % 6
    m = F.when(k == 1, "EXACT").when(k == 2, "CONTAINED").when(k == 4, "HIGH_OVERLAP").otherwise("NONE")
    c = claims.validated(*_claims(spark, sf_dir)).withColumn("match", m)
    s = summaries.claim_group_summary("validation_status", "match", F.col("package_id") % 3 != 0, F.col("package_id") % 4 != 0)
    out = c.groupBy("claim_type").agg(*[v.alias(n) for n, v in s.items()])
    return rounded(out, {n: 6 for n in s if n.endswith(("_rate", "faithfulness", "verifiability"))})


@query(_GENERATIONS + """
    , x AS (SELECT *, s + u + c + v AS a, usable AND s + u + c + v > 0 AS ok FROM g),
    y AS (SELECT user_id % 5 AS model, usable, a, CASE WHEN ok THEN s / a ELSE 0.0 END AS ys, CASE WHEN ok THEN 0.0 ELSE 1.0 END AS pl, CASE WHEN ok THEN v / a ELSE 0.0 END AS nl, CASE WHEN ok THEN u / a ELSE 0.0 END AS ul, CASE WHEN ok THEN c / a ELSE 0.0 END AS cl FROM x)
    SELECT model, count(*) AS planned, count(*) FILTER (usable) AS usable, count(*) FILTER (NOT usable) AS unusable, round(count(*) FILTER (usable) / count(*), 6) AS usability_rate, round(avg(ys), 6) AS mean_yield_share, round(avg(pl), 6) AS mean_pipeline_loss, round(avg(nl), 6) AS mean_not_verifiable_loss,
           round(avg(ul), 6) AS mean_unsupported_loss, round(avg(cl), 6) AS mean_contradiction_loss, round(avg(ul + cl), 6) AS mean_resolved_error_loss, round(avg(ul + cl + nl), 6) AS mean_claim_quality_loss, round(avg(1 - ys), 6) AS mean_total_loss, round(avg(a), 6) AS mean_claims FROM y GROUP BY 1""")
def generation_group_summary(spark, sf_dir):
    g = metrics.losses(_generations(spark, sf_dir)).withColumn("claim_count", F.col("supported_count") + F.col("unsupported_count") + F.col("contradicted_count") + F.col("not_verifiable_count"))
    s = summaries.generation_group_summary()
    out = g.groupBy((F.col("user_id") % 5).alias("model")).agg(*[c.alias(n) for n, c in s.items()])
    return rounded(out, {n: 6 for n in s if n.startswith("mean_") or n.endswith("_rate")})


_NUMBERS = ORACLE_SQL["numeric_feature_stats"].rpartition("    SELECT feature, rows")[0]


@query(_NUMBERS + """
    SELECT count(*) AS features, max(rows) AS rows, sum(rows - present)::BIGINT AS missing_cells, round(sum(rows - present) / sum(rows), 6) AS missing_rate, count(*) FILTER ("distinct" <= 1) AS constant, count(*) FILTER (abs(skewness) > 2) AS skewed,
           count(*) FILTER (iqr_outliers > 0.05 * present) AS many_outliers, round(avg(abs(skewness)), 5) AS mean_abs_skewness, round(max(abs(skewness)), 5) AS max_abs_skewness FROM s JOIN o USING (feature)""")
def dataset_audit(spark, sf_dir):
    s = audits.numeric_stats(audits.melted(t(spark, sf_dir, "lineitem"), _STATS))
    return rounded(audits.dataset_audit(s), {"missing_rate": 6, "mean_abs_skewness": 5, "max_abs_skewness": 5})


def _with_target(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return audits.numeric_stats(audits.melted(d, _STATS, ["y"]), "y")


@query(_NUMBERS + """
    SELECT CASE feature WHEN 'l_quantity' THEN 'size' WHEN 'l_extendedprice' THEN 'size' WHEN 'l_discount' THEN 'terms' END AS concept, count(*) AS features, round(avg(abs(skewness)), 5) AS mean_abs_skewness, round(max(abs(skewness)), 5) AS max_abs_skewness, round(max(abs(target_corr)), 6) AS max_abs_target_corr
    FROM s GROUP BY 1""")
def concept_feature_summary(spark, sf_dir):
    """By concept, a feature without one among them."""
    k = spark.createDataFrame([("l_quantity", "size"), ("l_extendedprice", "size"), ("l_discount", "terms"), ("l_tax", None)], "feature string, concept string")
    return rounded(audits.concept_audit(_with_target(spark, sf_dir), k), {"mean_abs_skewness": 5, "max_abs_skewness": 5, "max_abs_target_corr": 6})


@query(_NUMBERS + """
    , c AS (SELECT feature, avg(value) FILTER (y = 1) AS m1, avg(value) FILTER (y = 0) AS m0, quantile_cont(value, 0.5) FILTER (y = 1) AS d1, quantile_cont(value, 0.5) FILTER (y = 0) AS d0, count(*) FILTER (value > 0) / count(value) AS pr FROM l GROUP BY 1)
    SELECT feature, round(m1 - m0, 4) AS mean_difference, round(d1, 4) AS median_1, round(d0, 4) AS median_0, round(d1 - d0, 4) AS median_difference, round(q75 - q25, 4) AS iqr, round(maximum - minimum, 4) AS value_range, round(pr, 6) AS positive_rate, round(iqr_outliers / present, 6) AS iqr_outliers_rate, round(z_outliers / present, 6) AS z_outliers_rate
    FROM s JOIN o USING (feature) JOIN c USING (feature)""")
def numeric_feature_contrasts(spark, sf_dir):
    """Means and medians of each feature by class, and its spread."""
    digits = {"mean_difference": 4, "median_1": 4, "median_0": 4, "median_difference": 4, "iqr": 4, "value_range": 4, "positive_rate": 6, "iqr_outliers_rate": 6, "z_outliers_rate": 6}
    return rounded(_with_target(spark, sf_dir).select("feature", *digits), digits)


@query("SELECT user_id, greatest(1, max(event_id % 7) + 1)::BIGINT AS next_attempt FROM events GROUP BY 1")
def next_attempts(spark, sf_dir):
    return selection.next_attempts(t(spark, sf_dir, "events").withColumn("attempt", F.col("event_id") % 7), "user_id", "attempt").withColumn("next_attempt", F.col("next_attempt").cast("long"))


@query()
def coverage_subset(spark, sf_dir):
    """Forty orders that cover every status and priority, then two boundaries, then all strata; tested against a loop over all rows."""
    d = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    edges = [F.col("o_totalprice") > 450_000, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 5_000)]
    return selection.coverage_first(d, "o_orderkey", ["o_orderstatus", "o_orderpriority"], 40, edges).select("o_orderkey", "place")


_CANDIDATES = """
    WITH c AS (SELECT s_nationkey AS candidate, count(*) AS planned, count(*) FILTER (l_returnflag <> 'R') AS usable, count(*) FILTER (l_linestatus = 'O') AS valid, avg(l_discount) AS error, avg(l_quantity) AS faith, avg(l_extendedprice) AS cost, s_nationkey % 4 + 1 AS level
               FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey),
    f AS (SELECT *, [x FOR x IN [CASE WHEN usable / planned < 0.66 THEN 'USABLE' END, CASE WHEN valid / planned < 0.5 THEN 'SCHEMA' END, CASE WHEN error > 0.0502 THEN 'ERROR' END, CASE WHEN faith < 25.2 THEN 'FAITHFULNESS' END] IF x IS NOT NULL] AS failed FROM c),
    g AS (SELECT *, len(failed) = 0 AS ok FROM f) """


def _candidates(spark, sf_dir):
    j = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    c = j.groupBy(F.col("s_nationkey").alias("candidate")).agg(
        F.count("*").alias("planned"), count_where(F.col("l_returnflag") != "R").alias("usable"), count_where(F.col("l_linestatus") == "O").alias("valid"),
        F.avg("l_discount").alias("error"), F.avg("l_quantity").alias("faith"), F.avg("l_extendedprice").alias("cost"),
    ).withColumn("level", F.col("candidate") % 4 + 1)
    gates = [("USABLE", F.col("usable") / F.col("planned"), "min", 0.66), ("SCHEMA", F.col("valid") / F.col("planned"), "min", 0.5), ("ERROR", F.col("error"), "max", 0.0502), ("FAITHFULNESS", F.col("faith"), "min", 25.2)]
    return selection.gated(c, gates)


@query(_CANDIDATES + "SELECT candidate, array_to_string(failed, '|') AS failed_gates, ok AS gates_pass FROM g")
def configuration_gates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("candidate", "failed_gates", "gates_pass")


@query(_CANDIDATES + """
    , b AS (SELECT candidate, faith FROM g WHERE ok ORDER BY faith DESC, candidate LIMIT 1), h AS (SELECT g.*, coalesce(g.faith >= (SELECT faith FROM b) - 1.0, false) AS ni FROM g),
    e AS (SELECT * FROM h WHERE ok AND ni), p AS (SELECT * FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.faith >= x.faith AND y.cost <= x.cost AND y.error <= x.error AND (y.faith > x.faith OR y.cost < x.cost OR y.error < x.error)))
    SELECT CASE WHEN (SELECT count(*) FROM g WHERE ok) = 0 THEN 'NO_CANDIDATE_PASSED_HARD_GATES' ELSE 'SELECTED' END AS status, (SELECT candidate FROM p ORDER BY level, cost, candidate LIMIT 1) AS selected, (SELECT candidate FROM b) AS reference,
           CASE WHEN (SELECT count(*) FROM g WHERE ok) = 0 THEN (SELECT candidate FROM g ORDER BY error, candidate LIMIT 1) END AS lowest_risk, (SELECT count(*) FROM g WHERE ok) AS passing""")
def configuration_choice(spark, sf_dir):
    """Hard gates, then not much worse than the best, then the frontier, then the least level and cost."""
    c = _candidates(spark, sf_dir)
    best = c.where("gates_pass").agg(F.max("faith").alias("__best"))
    c = c.join(F.broadcast(best), F.lit(True)).withColumn("non_inferior", F.coalesce(F.col("faith") >= F.col("__best") - 1.0, F.lit(False)))  # one row
    ok = F.col("gates_pass") & F.col("non_inferior")
    point = {x: F.when(ok, F.col(x)) for x in ("faith", "cost", "error")}
    front = decisions.pareto(c.select("candidate", F.lit(1).alias("g"), *[v.alias(k) for k, v in point.items()]), "g", "candidate", ["faith"], ["cost", "error"], tolerance=0.0)
    c = c.join(front.select("candidate", "on_frontier"), "candidate")
    return selection.decision(c, "candidate", "level", [F.desc("faith")], [F.asc("error")], [F.asc("cost")])


@query("""
    WITH h AS (SELECT l_suppkey AS option_id, l_orderkey % 2 AS side, count(*) AS planned, count(*) FILTER (l_returnflag <> 'R') / count(*) AS usability, avg(l_discount) AS error FROM lineitem GROUP BY 1, 2),
    g AS (SELECT *, array_to_string([x FOR x IN [CASE WHEN planned + 1e-12 < 20 THEN 'PLANNED' END, CASE WHEN usability + 1e-12 < 0.64 THEN 'USABILITY' END, CASE WHEN error - 1e-12 > 0.052 THEN 'ERROR' END] IF x IS NOT NULL], '|') AS failed FROM h)
    SELECT option_id, a.failed AS first_failed, b.failed AS second_failed, coalesce(a.failed = '' AND b.failed = '', false) AS both_pass, CASE option_id % 5 WHEN 0 THEN 'CONTROL' WHEN 4 THEN 'FALLBACK_ONLY' ELSE 'PRIMARY_CANDIDATE' END AS option_role,
           coalesce(a.failed = '' AND b.failed = '', false) AND option_id % 5 <> 0 AS robust_eligible, round(least(a.usability, b.usability), 6) AS worst_usability, round(greatest(a.error, b.error), 6) AS worst_error
    FROM (SELECT * FROM g WHERE side = 0) a FULL JOIN (SELECT * FROM g WHERE side = 1) b USING (option_id)""")
def cross_dataset_gate(spark, sf_dir):
    """Options that pass in both of two datasets, by the worse of both."""
    h = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("option_id"), (F.col("l_orderkey") % 2).alias("side")).agg(F.count("*").alias("planned"), (count_where(F.col("l_returnflag") != "R") / F.count("*")).alias("usability"), F.avg("l_discount").alias("error"))
    g = selection.gated(h, [("PLANNED", F.col("planned"), "min", 20), ("USABILITY", F.col("usability"), "min", 0.64), ("ERROR", F.col("error"), "max", 0.052)], 1e-12)
    side = lambda k, n: g.where(F.col("side") == k).select("option_id", F.col("failed_gates").alias(f"{n}_failed"), F.col("gates_pass").alias(f"{n}_pass"), F.col("usability").alias(f"{n}_u"), F.col("error").alias(f"{n}_e"))
    j = side(0, "first").join(side(1, "second"), "option_id", "full_outer")
    both = F.coalesce(F.col("first_pass") & F.col("second_pass"), F.lit(False))
    kind = selection.role((F.col("option_id") % 5).cast("string"), ["0"], ["1", "2", "3"])
    out = j.select("option_id", "first_failed", "second_failed", both.alias("both_pass"), kind.alias("option_role"), (both & (kind != "CONTROL")).alias("robust_eligible"), F.least("first_u", "second_u").alias("worst_usability"), F.greatest("first_e", "second_e").alias("worst_error"))
    return rounded(out, {"worst_usability": 6, "worst_error": 6})


@query("""
    WITH f AS (SELECT c_nationkey, o_orderpriority, floor(avg(o_totalprice) / 100)::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), n AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey FROM f)),
    q AS (SELECT seed, it, ('0x' || substr(md5(seed || ':' || it || ':' || k), 1, 7))::BIGINT % (SELECT max(n) FROM n) AS i FROM (SELECT unnest(['seed1', 'seed2', 'seed3']) AS seed), (SELECT unnest(range(100)) AS it), (SELECT unnest(range((SELECT max(n) FROM n))) AS k)),
    m AS (SELECT seed, o_orderpriority, it, avg(y) AS mean FROM q JOIN n USING (i) JOIN f USING (c_nationkey) GROUP BY 1, 2, 3), b AS (SELECT a.seed, a.o_orderpriority, round(quantile_cont(r.mean - a.mean, 0.95), 4) AS upper_bound FROM m a JOIN m r ON r.seed = a.seed AND r.it = a.it AND r.o_orderpriority = '1-URGENT' WHERE a.o_orderpriority <> '1-URGENT' GROUP BY 1, 2),
    c AS (SELECT *, CASE WHEN upper_bound <= 20 THEN 'NON_INFERIOR' ELSE 'INCONCLUSIVE' END AS state FROM b)
    SELECT o_orderpriority, count(*) AS repetitions, string_agg(DISTINCT state, '|' ORDER BY state) AS states, count(DISTINCT state) = 1 AS agreed, bool_and(upper_bound <= 20) AS all_pass FROM c GROUP BY 1""")
def seed_agreement(spark, sf_dir):
    """Whether a conclusion is the same for each seed of the resampling."""
    from .inference import _facts

    f, out = _facts(spark, sf_dir), None
    for seed in ("seed1", "seed2", "seed3"):
        w = statistics.resamples(f.select("c_nationkey").distinct(), "c_nationkey", 100, seed)
        b = statistics.difference_bound(statistics.bootstrap_means(f, w, "c_nationkey", "o_orderpriority", "y"), "o_orderpriority", F.col("o_orderpriority") != "1-URGENT", "1-URGENT")
        out = b if out is None else out.unionByName(b)
    out = rounded(out, {"upper_bound": 4})
    ok = F.col("upper_bound") <= 20
    return selection.agreement(out.withColumn("state", F.when(ok, "NON_INFERIOR").otherwise("INCONCLUSIVE")), ["o_orderpriority"], "state", ok)


@query("""
    SELECT event_id, array_to_string([x FOR x IN [CASE WHEN event_type = 'error' THEN 'RUNTIME_FAILED' END, CASE WHEN value > 90 THEN 'TRUNCATED' END, CASE WHEN event_type = 'click' THEN 'PARSE_FAILED' END, CASE WHEN event_id % 9 = 0 THEN 'SCHEMA_INVALID' END, CASE WHEN event_id % 10 = 0 THEN 'EMPTY_RESPONSE' END] IF x IS NOT NULL], '|') AS reasons,
           NOT (event_type IN ('error', 'click') OR coalesce(value > 90, false) OR event_id % 9 = 0 OR event_id % 10 = 0) AS usable FROM events""")
def usability_reasons(spark, sf_dir):
    """Events as answers, with all that makes one unusable."""
    k, e = F.col("event_id"), F.col("event_type")
    d = t(spark, sf_dir, "events").select("event_id", F.when(e == "error", "FAILED").otherwise("SUCCESS").alias("runtime_status"), (F.col("value") > 90).alias("truncated_response"), (e != "click").alias("json_parse_success"), (k % 9 != 0).alias("schema_valid"), F.when(k % 10 != 0, "text").alias("response_text"))
    u = generations.usability(d)
    return u.select("event_id", F.array_join("unusable_reasons", "|").alias("reasons"), "usable")


@query("""
    WITH w AS (SELECT o_custkey AS gate_id, arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS st, arg_max(o_orderdate + INTERVAL 30 DAY, struct_pack(d := o_orderdate, k := o_orderkey)) AS ex FROM orders GROUP BY 1)
    SELECT c_custkey AS gate_id FROM customer WHERE c_acctbal < 0 AND NOT EXISTS (SELECT 1 FROM w WHERE w.gate_id = c_custkey AND st = 'O' AND ex > TIMESTAMP '1998-06-01')""")
def blocking_gates(spark, sf_dir):
    """Customers in the red as failed gates, open orders as waivers that end a month after their date."""
    g = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gate_id"), F.when(F.col("c_acctbal") < 0, "FAILED").otherwise("PASSED").alias("status"))
    w = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gate_id"), F.struct("o_orderdate", "o_orderkey").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("REVOKED").alias("status"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    return oplog.blocking(g, w, "1998-06-01 00:00:00").select("gate_id")


@query("""
    WITH e AS (SELECT user_id AS k, count(*) AS events, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS last_event FROM events GROUP BY 1), o AS (SELECT o_custkey AS k, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS outputs FROM orders GROUP BY 1)
    SELECT c_custkey AS id, events, last_event, outputs FROM customer LEFT JOIN e ON e.k = c_custkey LEFT JOIN o ON o.k = c_custkey""")
def run_detail(spark, sf_dir):
    """Customers as runs, with their events and the orders that they put out."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("pipeline_run_id"), "event_type", F.col("ts").alias("occurred_at"), F.col("event_id").alias("id"))
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pipeline_run_id"), F.col("o_orderkey").alias("artifact_id"))
    d = oplog.run_detail(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), e, o)
    return d.select("id", "events", "last_event", F.array_join(F.transform("outputs", lambda x: x.cast("string")), "|").alias("outputs"))


@query("""
    SELECT o_orderkey, round(1 / (1 + exp(-(-4.0 + 2e-5 * o_totalprice))), 6) AS probability, o_orderstatus = 'F' AND 1 / (1 + exp(-(-4.0 + 2e-5 * o_totalprice))) >= 0.9 AS accepted FROM orders""")
def calibrated_acceptance(spark, sf_dir):
    p, ok = decisions.acceptance(F.col("o_totalprice"), F.col("o_orderstatus") == "F", -4.0, 2e-5)
    return rounded(t(spark, sf_dir, "orders").select("o_orderkey", p.alias("probability"), ok.alias("accepted")), {"probability": 6})


@query("""
    WITH d AS (SELECT doc_id, quality AS y, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, CASE WHEN y = 1 AND p = 1 THEN 'TP' WHEN y = 0 AND p = 1 THEN 'FP' WHEN y = 1 AND p = 0 THEN 'FN' WHEN y = 0 AND p = 0 THEN 'TN' END AS outcome FROM d""")
def outcomes(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(t(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", outcome(F.col("quality"), F.when(F.col("n_chars") > 400, 1).otherwise(0)).alias("outcome"))


@query("""
    SELECT event_id, (event_type <> 'error')::INT AS runtime_success, (event_type <> 'click')::INT AS parse_success, (event_id % 9 <> 0)::INT AS schema_success, (event_type = 'view' AND event_id % 3 = 0)::INT AS first_pass_success, (event_id % 3 > 0)::INT AS needed_retry FROM events""")
def reliability_flags(spark, sf_dir):
    k, e = F.col("event_id"), F.col("event_type")
    d = t(spark, sf_dir, "events").select("event_id", F.when(e == "error", "FAILED").otherwise("SUCCESS").alias("runtime_status"), (e != "click").alias("json_parse_success"), (k % 9 != 0).alias("schema_valid"), (e == "view").alias("usable"), (k % 3).alias("retry_count"))
    return metrics.reliability(d).select("event_id", "runtime_success", "parse_success", "schema_success", "first_pass_success", "needed_retry")


@query("""
    SELECT doc_id, CASE WHEN contains(text, 'the ') THEN strpos(text, 'the ') - 1 END::BIGINT AS start, CASE WHEN contains(text, 'the ') THEN strpos(text, 'the ') + 3 END::BIGINT AS finish, regexp_replace(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name,
           concat_ws(chr(10), source, lang, 'end') AS whole, (coalesce(length(source) + 1, 0))::BIGINT AS second_start, 'docs::' || doc_id AS scoped_id FROM documents""")
def text_spans(spark, sf_dir):
    """Where a word stands in a text, the sections of a text with their starts, safe and scoped names."""
    start, end = texts.span(F.col("text"), F.lit("the "))
    joined, starts = texts.sections([F.col("source"), F.col("lang"), F.lit("end")])
    name = texts.safe_name(F.concat("source", F.lit(" / "), "lang"))
    return t(spark, sf_dir, "documents").select("doc_id", start.cast("long").alias("start"), end.cast("long").alias("finish"), name.alias("name"), joined.alias("whole"), starts[1].cast("long").alias("second_start"), scoped("docs", F.col("doc_id")).alias("scoped_id"))


@query("""
    WITH c AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS claim_id, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT concat_ws('-', l_orderkey, l_linenumber % 5) AS claim_id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT coalesce(c.claim_id, r.claim_id) AS claim_id, coalesce(r.n, 0) AS results, CASE WHEN c.claim_id IS NULL THEN 'unexpected' WHEN r.n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem FROM c FULL JOIN r ON c.claim_id = r.claim_id WHERE c.claim_id IS NULL OR r.n IS NULL OR r.n > 1""")
def results_reconciled(spark, sf_dir):
    """Claims without exactly one result, and results without a claim."""
    i = t(spark, sf_dir, "lineitem")
    return claims.reconciled(i.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id")), i.select(F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber") % 5).alias("claim_id")))


@query("""
    SELECT o_orderkey, CASE WHEN o_totalprice / 1e6 >= 0.10 THEN 'strong' WHEN o_totalprice / 1e6 >= 0.03 THEN 'moderate' ELSE 'weak' END AS strength,
           CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'not_ready' WHEN o_orderkey % 3 > 0 OR o_orderkey % 5 * 3 < 5 THEN 'ready_with_warnings' ELSE 'ready' END AS readiness,
           round(0.35 * (1 - least(abs(o_totalprice / 1e6 - 0.25) / 0.25, 1)) + 0.30 * least(o_orderkey % 11 / 10, 1) + 0.20 * (o_orderkey % 3 / 4) + 0.15 * least(o_orderkey % 30 / 20, 1), 10) AS difficulty FROM orders""")
def case_readiness(spark, sf_dir):
    """Orders as cases: strength, readiness and difficulty."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice") / 1e6
    ready = evidence.readiness(F.when(k % 7 != 0, p), k % 5 * 3, F.lit(0.0), k % 3)
    hard = evidence.difficulty(p - 0.25, k % 11 / 10.0, k % 3 / 4.0, k % 30)
    return rounded(t(spark, sf_dir, "orders").select("o_orderkey", evidence.strength(p).alias("strength"), ready.alias("readiness"), hard.alias("difficulty")), {"difficulty": 10})


@query(ORACLE_SQL["safe_phrase_match"].rpartition("    SELECT doc_id AS claim_id")[0] + """
    , b2 AS (SELECT doc_id % 20 AS narrative_id, t, round(cov, 6) AS cov FROM r WHERE rn = 1)
    SELECT narrative_id, max(cov) AS max_coverage, bool_or(t = 'EXACT') AS any_exact, bool_or(t = 'CONTAINED') AS any_contained, count(*) AS parts FROM b2 GROUP BY 1""")
def narrative_match(spark, sf_dir):
    """Documents as parts of narratives, by their best phrase."""
    return matching.narrative_matches(safe_phrase_match(spark, sf_dir).withColumn("narrative_id", F.col("claim_id") % 20))


@query("""
    SELECT o_custkey, coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, 'none') AS reason, count(*) AS entities, count(*) FILTER (o_totalprice > 400000) AS events FROM orders GROUP BY ALL""")
def censor_reasons(spark, sf_dir):
    from ..operators.panel import reason_counts

    d = t(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("censor_reason"), F.when(F.col("o_totalprice") > 400000, 1).otherwise(0).alias("target"))
    return reason_counts(d, "o_custkey")


@query("""
    SELECT l_orderkey, l_linenumber, array_to_string([x FOR x IN [CASE WHEN l_discount >= 0.05 THEN 'discounted' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_linestatus IN ('O', 'P') THEN 'open' END] IF x IS NOT NULL], '|') AS allowed FROM lineitem""")
def truth_conditions(spark, sf_dir):
    """What may be said of an item, by rules on its fields."""
    rules = [("discounted", "l_discount", ">=", 0.05), ("returned", "l_returnflag", "=", "R"), ("open", "l_linestatus", "in", ("O", "P"))]
    return evidence.truth_conditions(rules, t(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", F.array_join("allowed_claims", "|").alias("allowed"))
