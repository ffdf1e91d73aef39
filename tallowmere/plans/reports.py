"""Profiles, differences between datasets and against baselines, registries, reasons, nesting of levels."""

from pyspark.sql import functions as F

from ..functions.numeric import count_where
from ..operators import checks, claims, evidence, ranking, reports, statistics
from .explanation import _LOCAL, _claims, _local
from .inference import _OPTIONS, _facts, _options, _study
from .mart import _COUNTED
from .registry import query, rounded, t


@query(_COUNTED + """
    SELECT claim_type, st AS validation_status, count(*) AS rows, round(count(*) / sum(count(*)) OVER (PARTITION BY claim_type), 6) AS share FROM z GROUP BY 1, 2""")
def claim_type_profile(spark, sf_dir):
    """Each type's claims by status, those without one among them."""
    return rounded(reports.profile(claims.validated(*_claims(spark, sf_dir)), ["claim_type"], "validation_status"), {"share": 6})


@query(_COUNTED + """
    SELECT count(*) AS claims, count(*) FILTER (st IS NULL) AS failed, count(DISTINCT claim_type) AS types, count(*) FILTER (reason_code = 'UNSUPPORTED_CLAIM_TYPE') AS untyped, count(*) = (SELECT count(*) FROM lineitem) AS complete FROM z""")
def release_checks(spark, sf_dir):
    """What must hold before results are released, from one pass and one count."""
    v = claims.validated(*_claims(spark, sf_dir))
    n = t(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))
    s = v.agg(F.count("*").alias("claims"), count_where(F.col("validation_status").isNull()).alias("failed"), F.count_distinct("claim_type").alias("types"), count_where(F.col("reason_code") == "UNSUPPORTED_CLAIM_TYPE").alias("untyped"))
    return s.join(n, F.lit(True)).select("claims", "failed", "types", "untyped", (F.col("claims") == F.col("n")).alias("complete"))


@query("""
    WITH g AS (SELECT l_suppkey AS option_id, l_orderkey % 2 AS d, l_discount AS x, l_quantity AS q FROM lineitem)
    SELECT option_id, round(avg(x) FILTER (d = 0), 6) AS x_first, round(avg(x) FILTER (d = 1), 6) AS x_second, round(avg(x) FILTER (d = 1) - avg(x) FILTER (d = 0), 6) + 0.0 AS x_delta,
           round(avg(q) FILTER (d = 0), 6) AS q_first, round(avg(q) FILTER (d = 1), 6) AS q_second, round(avg(q) FILTER (d = 1) - avg(q) FILTER (d = 0), 6) + 0.0 AS q_delta FROM g GROUP BY 1""")
def failure_deltas(spark, sf_dir):
    i = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("option_id"), (F.col("l_orderkey") % 2).cast("string").alias("d"), F.col("l_discount").alias("x"), F.col("l_quantity").alias("q"))
    return rounded(reports.deltas(i, "option_id", "d", "0", "1", ["x", "q"]), {f"{m}_{s}": 6 for m in "xq" for s in ("first", "second", "delta")})


@query("""
    WITH g AS (SELECT o_custkey, avg(floor(o_totalprice)) FILTER (o_orderpriority = '1-URGENT') AS system, avg(floor(o_totalprice)) FILTER (o_orderpriority = '5-LOW') AS baseline FROM orders GROUP BY 1)
    SELECT o_custkey, round(system, 4) AS system, round(baseline, 4) AS baseline, round(system - baseline, 4) + 0.0 AS difference, CASE WHEN system > baseline THEN 'system' WHEN system < baseline THEN 'baseline' ELSE 'tie' END AS winner FROM g WHERE system IS NOT NULL AND baseline IS NOT NULL""")
def baseline_pairs(spark, sf_dir):
    """Urgent orders against low ones of the customers that have both."""
    o = t(spark, sf_dir, "orders").withColumn("v", F.floor("o_totalprice").cast("double"))
    return rounded(reports.paired_with_baseline(o, "o_custkey", "o_orderpriority", "1-URGENT", "5-LOW", "v"), {"system": 4, "baseline": 4, "difference": 4})


@query()
def sensitivity_summary(spark, sf_dir):
    """The signed-rank conclusions of all nations and of those that have every priority; p-values have no SQL."""
    from .inference import _pairs

    f = _facts(spark, sf_dir)
    whole = checks.complete_cases(f.withColumn("n", F.lit(1)), "c_nationkey", F.col("y") > 1000).drop("n")
    k = _pairs(spark, sf_dir).select("contrast_id", "first", "second").distinct()
    test = lambda pairs: ranking.holm(statistics.wilcoxon(pairs).join(statistics.rank_biserial(pairs), "contrast_id").withColumn("family", F.lit("p")), ["family"], "p", "contrast_id")
    other = statistics.paired(whole, "c_nationkey", "o_orderpriority", "y", k)
    return reports.stable_conclusions(test(_pairs(spark, sf_dir)), test(other), ["contrast_id"], "effect", "p_holm")


@query("""
    WITH d(t, feature, data_type, "rows", present) AS (
        SELECT 'orders', c.n, c.k, count(*), count(CASE c.n WHEN 'o_orderkey' THEN o_orderkey::VARCHAR WHEN 'o_totalprice' THEN o_totalprice::VARCHAR WHEN 'o_orderstatus' THEN o_orderstatus END) FROM orders, (VALUES ('o_orderkey', 'bigint'), ('o_totalprice', 'double'), ('o_orderstatus', 'string'), ('o_nothing', 'string')) c(n, k) GROUP BY ALL
        UNION ALL SELECT 'customer', c.n, c.k, count(*), count(CASE c.n WHEN 'c_custkey' THEN c_custkey::VARCHAR WHEN 'c_acctbal' THEN c_acctbal::VARCHAR ELSE c_mktsegment END) FROM customer, (VALUES ('c_custkey', 'bigint'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) c(n, k) GROUP BY ALL
        UNION ALL SELECT 'lineitem', c.n, c.k, count(*), count(CASE c.n WHEN 'l_orderkey' THEN l_orderkey::VARCHAR WHEN 'l_discount' THEN l_discount::VARCHAR ELSE l_returnflag END) FROM lineitem, (VALUES ('l_orderkey', 'bigint'), ('l_discount', 'double'), ('l_returnflag', 'string')) c(n, k) GROUP BY ALL)
    SELECT t AS "table", feature, data_type, "rows", present, CASE WHEN feature IN ('o_totalprice', 'c_acctbal') THEN 'size' WHEN feature = 'l_discount' THEN 'terms' WHEN feature IN ('o_orderstatus', 'l_returnflag', 'c_mktsegment', 'o_nothing') THEN 'state' ELSE 'unknown' END AS concept,
           CASE WHEN feature IN ('o_totalprice', 'c_acctbal') THEN 'money' WHEN feature = 'l_discount' THEN 'share' WHEN feature IN ('o_orderstatus', 'l_returnflag', 'c_mktsegment', 'o_nothing') THEN 'code' ELSE 'unknown' END AS unit,
           CASE WHEN feature IN ('o_totalprice', 'c_acctbal', 'l_discount') THEN 'numeric' WHEN feature IN ('o_orderstatus', 'l_returnflag', 'c_mktsegment', 'o_nothing') THEN 'categorical' ELSE 'unknown' END AS kind,
           CASE WHEN feature IN ('o_orderkey', 'c_custkey', 'l_orderkey') THEN 'UNKNOWN' WHEN present = 0 THEN 'EMPTY' ELSE 'KNOWN' END AS status FROM d""")
def feature_registry(spark, sf_dir):
    """The columns of three tables: what the registry knows of their names, and how many rows have a value."""
    rules = (
        ("o_total", "size", "money", "numeric"), ("c_acct", "size", "money", "numeric"), ("l_discount", "terms", "share", "numeric"), ("o_orderstatus", "state", "code", "categorical"),
        ("l_return", "state", "code", "categorical"), ("c_mkt", "state", "code", "categorical"), ("o_nothing", "state", "code", "categorical"),
    )
    return reports.registered({
        "orders": t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(None).cast("string").alias("o_nothing")),
        "customer": t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "lineitem": t(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_returnflag"),
    }, rules)


@query("""
    SELECT 'o_totalprice' AS feature, 'o_totalprice' AS original, NULL::VARCHAR AS level, count(o_totalprice) AS "rows" FROM orders UNION ALL
    SELECT 'o_orderpriority__' || trim(regexp_replace(lower(p), '[^a-z0-9]+', '_', 'g'), '_'), 'o_orderpriority', p, n FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1) UNION ALL
    SELECT 'o_orderstatus__' || trim(regexp_replace(lower(p), '[^a-z0-9]+', '_', 'g'), '_'), 'o_orderstatus', p, n FROM (SELECT o_orderstatus AS p, count(*) AS n FROM orders GROUP BY 1)""")
def feature_origins(spark, sf_dir):
    """From which column and level each preprocessed feature comes."""
    return reports.origins(t(spark, sf_dir, "orders"), ["o_totalprice"], ["o_orderpriority", "o_orderstatus"])


@query(_OPTIONS + """
    , e AS (SELECT scenario_id, option_id, eligible, volume, discount FROM c JOIN o USING (option_id)),
    q AS (SELECT scenario_id, quantile_cont(volume, 0.5) AS mv, quantile_cont(discount, 0.5) AS md FROM e WHERE eligible GROUP BY 1)
    SELECT scenario_id, option_id, array_to_string([x FOR x IN [CASE WHEN eligible THEN 'MEETS_ALL_CONSTRAINTS' END, CASE WHEN volume >= mv THEN 'HIGH_VOLUME' END, CASE WHEN discount <= md THEN 'LOW_DISCOUNT' END] IF x IS NOT NULL], '|') AS reasons,
           CASE WHEN discount > md THEN 'NOT_LOW_DISCOUNT' ELSE '' END AS cautions FROM e LEFT JOIN q USING (scenario_id)""")
def recommendation_codes(spark, sf_dir):
    """Reasons for and cautions about options, against the medians of the eligible ones."""
    _, _, state = _study(spark, sf_dir)
    d = state.select("scenario_id", "option_id", "eligible").join(_options(spark, sf_dir).select("option_id", "volume", "discount"), "option_id")
    r = reports.coded(d, "scenario_id", F.col("eligible"), {"volume": "HIGH_VOLUME"}, {"discount": "LOW_DISCOUNT"}, [("MEETS_ALL_CONSTRAINTS", F.col("eligible"))])
    return r.select("scenario_id", "option_id", "reasons", "cautions")


@query(_LOCAL + """
    , a AS (SELECT l_orderkey, feature_id FROM l WHERE (c - m < 0.7 * w OR rank <= 5) AND rank <= 20), b AS (SELECT l_orderkey, feature_id FROM l WHERE (c - m < 0.6 * w OR rank <= 3) AND rank <= 10)
    SELECT l_orderkey, count(*)::INT AS missing FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY 1""")
def evidence_nesting(spark, sf_dir):
    """Cases whose fourth level has features that the third lacks."""
    return reports.nesting(evidence.packages(_local(spark, sf_dir), "l_orderkey"), "l_orderkey", "S4", "S3")


@query("""
    WITH f AS (SELECT c_nationkey, o_orderpriority, floor(avg(o_totalprice) / 100)::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), p AS (SELECT DISTINCT o_orderpriority AS p FROM f),
    d AS (SELECT a.o_orderpriority AS first, b.o_orderpriority AS second, a.y - b.y AS d FROM f a JOIN f b ON a.c_nationkey = b.c_nationkey AND a.o_orderpriority < b.o_orderpriority)
    SELECT first || ' - ' || second AS contrast_id, count(*) AS pairs, round(avg(d), 6) + 0.0 AS mean_difference, round(quantile_cont(d, 0.5), 4) + 0.0 AS median_difference FROM d GROUP BY 1""")
def all_contrasts(spark, sf_dir):
    """Every pair of conditions as a planned contrast, built from the list of conditions."""
    f = _facts(spark, sf_dir)
    names = sorted(r[0] for r in f.select("o_orderpriority").distinct().collect())  # the conditions of a design
    k = spark.createDataFrame([(f"{a} - {b}", a, b) for i, a in enumerate(names) for b in names[i + 1 :]], "contrast_id string, first string, second string")
    s = statistics.contrast_summary(statistics.paired(f, "c_nationkey", "o_orderpriority", "y", k))
    return rounded(s.select("contrast_id", "pairs", "mean_difference", "median_difference"), {"mean_difference": 6, "median_difference": 4})
