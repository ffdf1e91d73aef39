"""Audits of the tables."""

from pyspark.sql import functions as F

from ..operators import audits, checks, preparation
from ..operators.statistics import kappa
from .registry import query, rounded, t

_STATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("""
    WITH x AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority', 'o_totalprice', 'o_third']) AS column_name, unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority, o_totalprice::VARCHAR, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END]) AS v FROM orders),
    c AS (SELECT column_name, v, count(*) AS n FROM x GROUP BY ALL)
    SELECT column_name, CASE WHEN column_name IN ('o_orderkey', 'o_custkey') THEN 'bigint' WHEN column_name = 'o_totalprice' THEN 'double' ELSE 'string' END AS data_type, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS missing, count(v) AS "distinct", missing / rows AS missing_rate,
           arg_min(v, struct_pack(a := -n, b := v)) FILTER (v IS NOT NULL) AS most_common, max(n) FILTER (v IS NOT NULL) AS most_common_count FROM c GROUP BY 1""")
def column_profile(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("o_third", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")))
    return audits.column_profile(o, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_third"])


@query("""
    WITH n AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1),
    j AS (SELECT c_custkey AS p, n.k, n.n FROM (SELECT DISTINCT c_custkey FROM customer) c FULL JOIN n ON c_custkey = k)
    SELECT count(p) AS parents, count(*) FILTER (p IS NOT NULL AND n IS NOT NULL) AS parents_with_children, round(avg(n) FILTER (p IS NOT NULL), 6) AS mean_children,
           max(n) FILTER (p IS NOT NULL) AS max_children, count(*) FILTER (p IS NULL) AS unmatched_keys, coalesce(sum(n) FILTER (p IS NULL), 0)::BIGINT AS unmatched_rows FROM j""")
def relationship_profile(spark, sf_dir):
    return rounded(audits.relationship_profile(t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders"), "c_custkey", "o_custkey"), {"mean_children": 6})


@query("""
    WITH a AS (SELECT 'c_acctbal' AS column_name, 'negative' AS rule, count(*) AS rows, count(*) - count(c_acctbal) AS missing, 0::BIGINT AS infinite, count(*) FILTER (c_acctbal = 0) AS zero, count(*) FILTER (c_acctbal < 0) AS negative,
                      min(c_acctbal) AS minimum, max(c_acctbal) AS maximum, count(*) FILTER (c_acctbal < 0) AS violations FROM customer),
    b AS (SELECT 'c_nationkey', 'not_positive', count(*), count(*) - count(c_nationkey), 0, count(*) FILTER (c_nationkey = 0), count(*) FILTER (c_nationkey < 0), min(c_nationkey)::DOUBLE, max(c_nationkey)::DOUBLE, count(*) FILTER (c_nationkey <= 0) FROM customer)
    SELECT * FROM a UNION ALL SELECT * FROM b""")
def anomaly_audit(spark, sf_dir):
    return audits.anomaly_audit(t(spark, sf_dir, "customer"), {"c_acctbal": ("negative", F.col("c_acctbal") < 0), "c_nationkey": ("not_positive", F.col("c_nationkey") <= 0)})


@query("""
    WITH l AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
    s AS (SELECT feature, count(*) AS rows, count(value) AS present, count(DISTINCT value) AS "distinct", avg(value) AS mean, stddev_samp(value) AS std, min(value) AS minimum, max(value) AS maximum,
                 quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.99) AS q99, skewness(value) AS skewness, kurtosis(value) AS kurtosis,
                 count(*) FILTER (value = 0) / count(value) AS zero_rate, corr(value, y) AS target_corr FROM l GROUP BY 1),
    o AS (SELECT feature, count(*) FILTER (value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS iqr_outliers, count(*) FILTER (std > 0 AND abs(value - mean) > 3 * std) AS z_outliers FROM l JOIN s USING (feature) GROUP BY 1)
    SELECT feature, rows, present, "distinct", round(mean, 4) AS mean, round(std, 4) AS std, minimum + 0.0 AS minimum, maximum, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, round(q99, 4) AS q99,
           round(skewness, 5) AS skewness, round(kurtosis, 5) AS kurtosis, round(zero_rate, 6) AS zero_rate, round(target_corr, 6) AS target_corr, iqr_outliers, z_outliers
    FROM s JOIN o USING (feature)""")
def numeric_feature_stats(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    s = audits.numeric_stats(audits.melted(d, _STATS, ["y"]), "y")
    s = s.select("feature", "rows", "present", "distinct", "mean", "std", "minimum", "maximum", "q25", "q50", "q75", "q99", "skewness", "kurtosis", "zero_rate", "target_corr", "iqr_outliers", "z_outliers")
    return rounded(s, {"mean": 4, "std": 4, "minimum": 6, "q25": 4, "q50": 4, "q75": 4, "q99": 4, "skewness": 5, "kurtosis": 5, "zero_rate": 6, "target_corr": 6})


@query("""
    WITH l AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem),
    s AS (SELECT feature, count(*) AS n, count(DISTINCT value) AS d, skewness(value) AS sk, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(*) FILTER (value = 0) AS z FROM l GROUP BY 1),
    o AS (SELECT feature, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS iqr FROM l JOIN s USING (feature) GROUP BY 1),
    w AS (SELECT feature, [x FOR x IN [CASE WHEN d <= 1 THEN 'constant' END, CASE WHEN abs(sk) > 2 THEN 'high_skew' END, CASE WHEN iqr > 0.05 * n THEN 'many_outliers' END, CASE WHEN z / n > 0.95 THEN 'mostly_zero' END] IF x IS NOT NULL] AS w FROM s JOIN o USING (feature))
    SELECT feature, array_to_string(w, '|') AS warnings, len(w)::INT AS n_warnings FROM w""")
def feature_warnings(spark, sf_dir):
    return audits.warnings(audits.numeric_stats(audits.melted(t(spark, sf_dir, "lineitem"), _STATS))).select("feature", "warnings", "n_warnings")


@query("""
    WITH d AS (SELECT lang, source, quality FROM documents JOIN labels USING (doc_id)),
    l AS (SELECT 'lang' AS feature, coalesce(lang, '__MISSING__') AS category, quality FROM d UNION ALL SELECT 'source', coalesce(source, '__MISSING__'), quality FROM d)
    SELECT feature, category, count(*) AS rows, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 6) AS rate FROM l GROUP BY 1, 2""")
def category_frequency_by_target(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(t(spark, sf_dir, "labels"), "doc_id")
    return rounded(audits.category_frequency(d, ["lang", "source"], "quality"), {"rate": 6})


@query("""
    WITH d AS (SELECT l_extendedprice AS v, l_shipdate < TIMESTAMP '1998-06-01' AS r FROM lineitem),
    e AS (SELECT list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM d WHERE r),
    b AS (SELECT r, least(len([x FOR x IN e IF x <= v]), len(e) - 1) AS bin FROM d, e WHERE v >= list_min(e) AND v <= list_max(e)),
    c AS (SELECT bin, count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS b FROM b GROUP BY 1),
    n AS (SELECT count(*) FILTER (r) AS na, count(*) FILTER (NOT r) AS nb FROM d),
    p AS (SELECT greatest(a / na, 1e-6) AS pa, greatest(b / nb, 1e-6) AS pb FROM c, n)
    SELECT count(*) AS bins, round(sum((pb - pa) * ln(pb / pa)), 6) AS psi, CASE WHEN sum((pb - pa) * ln(pb / pa)) < 0.1 THEN 'low' WHEN sum((pb - pa) * ln(pb / pa)) < 0.25 THEN 'medium' ELSE 'high' END AS drift FROM p""")
def psi_drift(spark, sf_dir):
    return rounded(audits.psi(t(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp")), {"psi": 6})


@query("""
    SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM (SELECT l_suppkey, l_returnflag, l_linenumber, l_quantity FROM lineitem) GROUP BY l_suppkey, l_returnflag, l_linenumber, l_quantity)""")
def duplicate_rows(spark, sf_dir):
    return audits.duplicate_rows(t(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber", "l_quantity"))


@query("""
    WITH h AS (SELECT doc_id, quality, md5('split:' || doc_id::VARCHAR) AS h FROM labels),
    r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS p, count(*) OVER (PARTITION BY quality) AS n FROM h),
    s AS (SELECT *, CASE WHEN p <= (n * 700 + 500) // 1000 THEN 'train' WHEN p <= (n * 850 + 500) // 1000 THEN 'valid' ELSE 'test' END AS split FROM r)
    SELECT split, count(*) AS rows, sum(quality)::BIGINT AS positives, round(sum(quality) / count(*), 6) AS rate, round(sum(quality) / count(*) - (SELECT avg(quality) FROM labels), 6) + 0.0 AS gap FROM s GROUP BY 1""")
def stratified_split_stats(spark, sf_dir):
    d = preparation.stratified_split(t(spark, sf_dir, "labels"), "doc_id", "quality", "split")
    return rounded(preparation.split_stats(d, "quality"), {"rate": 6, "gap": 6})


@query("""
    WITH f AS (SELECT p_type, count(*) AS n, count(*) / (SELECT count(*) FROM part WHERE p_size <= 40) AS s FROM part WHERE p_size <= 40 GROUP BY 1)
    SELECT p_partkey, CASE WHEN f.p_type IS NULL THEN '__UNKNOWN__' WHEN s < 0.165 THEN '__RARE__' ELSE f.p_type END AS level FROM part p LEFT JOIN f ON f.p_type = p.p_type""")
def rare_category_encode(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    levels = preparation.category_levels(p.where("p_size <= 40"), "p_type", least=0.165)
    return preparation.encoded_category(p, "p_type", levels, "level").select("p_partkey", "level")


@query("""
    WITH d AS (SELECT c_custkey, nullif(c_acctbal, abs(c_acctbal)) IS NULL AS pos, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v, c_nationkey FROM customer),
    m AS (SELECT quantile_cont(v, 0.5) AS med FROM d WHERE c_nationkey < 20),
    f AS (SELECT avg(coalesce(v, med)) AS mu, stddev_pop(coalesce(v, med)) AS sd FROM d, m WHERE c_nationkey < 20)
    SELECT c_custkey, round((coalesce(v, med) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) + 0.0 AS v FROM d, m, f""")
def median_impute_scale(spark, sf_dir):
    d = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))
    fitted = preparation.imputation(d.where("c_nationkey < 20"), ["v"], [])
    return rounded(preparation.imputed_scaled(d, fitted, ["v"]).select("c_custkey", "v"), {"v": 6})


@query("""
    SELECT p_partkey, (p_type = 'ECONOMY')::INT AS p_type__economy, (p_type = 'LARGE')::INT AS p_type__large, (p_type = 'MEDIUM')::INT AS p_type__medium, (p_type = 'PROMO')::INT AS p_type__promo FROM part""")
def one_hot_columns(spark, sf_dir):
    return preparation.one_hot(t(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO"])


@query("""
    SELECT doc_id, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*) OVER (PARTITION BY quality)), 6) AS weight FROM labels""")
def balanced_weights(spark, sf_dir):
    d = t(spark, sf_dir, "labels").where("quality is not null")
    return rounded(preparation.with_balanced_weight(d, "quality").select("doc_id", "weight"), {"weight": 6})


@query("""
    SELECT feature, round(c, 6) AS correlation FROM (
        SELECT 'n_chars' AS feature, corr(n_chars, quality) AS c FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'leak', corr(1 - quality, quality) FROM labels) WHERE abs(c) >= 0.8""")
def leakage_correlations(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(t(spark, sf_dir, "labels"), "doc_id").withColumn("leak", 1 - F.col("quality"))
    return rounded(preparation.target_correlations(audits.melted(d, ["n_chars", "leak"], ["quality"]), "quality"), {"correlation": 6})


@query("""
    WITH n AS (SELECT quality x, toxic y, count(*) AS n FROM labels GROUP BY ALL), m AS (SELECT sum(n) AS items, sum(n) FILTER (x = y) AS same FROM n),
    a AS (SELECT x, sum(n) AS nx FROM n GROUP BY 1), b AS (SELECT y, sum(n) AS ny FROM n GROUP BY 1), e AS (SELECT sum(nx * ny) AS e FROM a JOIN b ON x = y)
    SELECT items::BIGINT AS items, round(same / items, 6) AS agreement, round(e / (items * items), 6) AS expected, round((same / items - e / (items * items)) / (1 - e / (items * items)), 6) AS kappa FROM m, e""")
def kappa_agreement(spark, sf_dir):
    return rounded(kappa(t(spark, sf_dir, "labels"), "quality", "toxic"), {"agreement": 6, "expected": 6, "kappa": 6})


@query("""
    SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)""")
def orphan_anti(spark, sf_dir):
    big = t(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return checks.orphans(t(spark, sf_dir, "orders").select("o_orderkey"), big, ["o_orderkey"])


@query("""
    SELECT l_orderkey, count(*) AS items FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity > 10)) GROUP BY 1""")
def semi_complete(spark, sf_dir):
    return checks.complete_cases(t(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity") > 10).groupBy("l_orderkey").agg(F.count("*").alias("items"))


@query("""
    WITH a AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, p, n, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge FROM a FULL JOIN b ON a.k = b.k""")
def reconcile_full_outer(spark, sf_dir):
    a = t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    b = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return checks.reconcile(a, b, ["k"])


@query("""
    SELECT l_suppkey, count(DISTINCT l_returnflag) AS "values" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def inconsistent_keys(spark, sf_dir):
    return checks.inconsistent(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag")


@query("""
    WITH p AS (SELECT n_nationkey, s FROM nation, (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'SPACE']) AS s)),
    a AS (SELECT DISTINCT c_nationkey AS n_nationkey, c_mktsegment AS s FROM customer)
    SELECT n_nationkey, s, 'missing' AS state FROM (FROM p EXCEPT FROM a) UNION ALL SELECT n_nationkey, s, 'unexpected' FROM (FROM a EXCEPT FROM p)""")
def matrix_holes(spark, sf_dir):
    seg = spark.createDataFrame([(s,) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SPACE")], "s string")
    planned = checks.expected_cells(t(spark, sf_dir, "nation").select("n_nationkey"), seg)
    actual = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("s"))
    return checks.holes(planned, actual, ["n_nationkey", "s"])


@query("""
    SELECT 'rows' AS check_name, (SELECT count(DISTINCT o_orderkey) FROM orders)::VARCHAR AS expected, count(*)::VARCHAR AS observed, (SELECT count(DISTINCT o_orderkey) FROM orders) = count(*) AS passed FROM orders
    UNION ALL SELECT 'no_null_key', '0', count(*) FILTER (o_custkey IS NULL)::VARCHAR, count(*) FILTER (o_custkey IS NULL) = 0 FROM orders
    UNION ALL SELECT 'no_cheap_order', '0', count(*) FILTER (o_totalprice < 2000)::VARCHAR, count(*) FILTER (o_totalprice < 2000) = 0 FROM orders""")
def check_registry(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return checks.check_table(o, [
        ("rows", F.count_distinct("o_orderkey"), F.count("*")),
        ("no_null_key", F.lit(0), F.count(F.when(F.col("o_custkey").isNull(), 1))),
        ("no_cheap_order", F.lit(0), F.count(F.when(F.col("o_totalprice") < 2000, 1))),
    ])


# ---- whole audits ----------------------------------------------------------------------------

_GAPPY = """
    WITH d AS (SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'N' THEN 0 END AS y, CASE WHEN l_linenumber > 2 THEN l_quantity END AS quantity,
                      CASE WHEN l_tax = 0 THEN 'infinity'::DOUBLE ELSE round(l_discount / l_tax, 6) END AS relief, l_extendedprice - 50000 AS margin, 1.0::DOUBLE AS one, NULL::DOUBLE AS nothing FROM lineitem)"""


def _gappy(spark, sf_dir):
    """Items with a missing, an infinite, a negative, a constant and an empty column, and a target that is missing for some."""
    y = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 0)
    relief = F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.round(F.col("l_discount") / F.when(F.col("l_tax") != 0, F.col("l_tax")), 6))
    return t(spark, sf_dir, "lineitem").select(
        "l_linestatus", y.alias("y"), F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("quantity"), relief.alias("relief"),
        (F.col("l_extendedprice") - 50000).alias("margin"), F.lit(1.0).alias("one"), F.lit(None).cast("double").alias("nothing"),
    )


@query(_GAPPY + """,
    l AS (SELECT y, unnest(['quantity', 'relief', 'margin', 'one', 'nothing']) AS feature, unnest([quantity, relief, margin, one, nothing]) AS raw FROM d),
    v AS (SELECT *, CASE WHEN NOT isinf(raw) THEN raw END AS value FROM l),
    s AS (SELECT feature, count(*) AS rows, count(value) AS present, count(*) - count(value) AS missing, count(*) FILTER (isinf(raw)) AS infinite, count(DISTINCT value) AS "distinct", avg(value) AS mean, var_samp(value) AS variance,
                 min(value) AS minimum, max(value) AS maximum, quantile_cont(value, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q,
                 count(*) FILTER (value = 0) AS zero_count, count(*) FILTER (value < 0) AS negative_count, count(*) FILTER (value > 0) AS positive_count,
                 avg(value) FILTER (y = 1) AS a1, avg(value) FILTER (y = 0) AS a0, quantile_cont(value, 0.5) FILTER (y = 1) AS b1, quantile_cont(value, 0.5) FILTER (y = 0) AS b0 FROM v GROUP BY 1),
    k AS (SELECT feature, CASE WHEN count(DISTINCT value) > 1 THEN skewness(value) WHEN count(value) > 2 THEN 0 END AS skewness, CASE WHEN count(DISTINCT value) > 1 THEN kurtosis(value) WHEN count(value) > 3 THEN 0 END AS kurtosis,
                 CASE WHEN count(DISTINCT value) > 1 THEN corr(value, y) END AS target_corr FROM v GROUP BY 1),
    o AS (SELECT feature, count(*) FILTER (value < q[4] - 1.5 * (q[6] - q[4]) OR value > q[6] + 1.5 * (q[6] - q[4])) AS iqr_outliers, count(*) FILTER (variance > 0 AND abs(value - mean) > 3 * sqrt(variance)) AS z_outliers FROM v JOIN s USING (feature) GROUP BY 1)
    SELECT feature, rows, present, missing, infinite, "distinct", round(missing / rows, 6) AS missing_rate, round(mean, 4) AS mean, round(sqrt(variance), 4) AS std, round(variance, 2) AS variance, minimum, maximum, round(maximum - minimum, 4) AS value_range,
           round(q[1], 4) AS q01, round(q[2], 4) AS q05, round(q[3], 4) AS q10, round(q[4], 4) AS q25, round(q[5], 4) AS q50, round(q[6], 4) AS q75, round(q[7], 4) AS q90, round(q[8], 4) AS q95, round(q[9], 4) AS q99, round(q[6] - q[4], 4) AS iqr,
           round(skewness, 5) + 0.0 AS skewness, CASE WHEN present = 0 THEN 'all_missing' WHEN skewness > 0.5 THEN 'right_skewed' WHEN skewness < -0.5 THEN 'left_skewed' ELSE 'approximately_symmetric' END AS skew_direction, round(kurtosis, 5) + 0.0 AS kurtosis,
           zero_count, negative_count, positive_count, CASE WHEN present > 0 THEN round(zero_count / rows, 6) END AS zero_rate, CASE WHEN present > 0 THEN round(negative_count / rows, 6) END AS negative_rate, CASE WHEN present > 0 THEN round(positive_count / rows, 6) END AS positive_rate,
           iqr_outliers, z_outliers, CASE WHEN present > 0 THEN round(iqr_outliers / rows, 6) END AS iqr_outliers_rate, CASE WHEN present > 0 THEN round(z_outliers / rows, 6) END AS z_outliers_rate, round(target_corr, 6) + 0.0 AS target_corr,
           CASE WHEN "distinct" > 1 THEN round(a1, 4) END AS mean_1, CASE WHEN "distinct" > 1 THEN round(a0, 4) END AS mean_0, CASE WHEN "distinct" > 1 THEN round(a1 - a0, 4) + 0.0 END AS mean_difference,
           CASE WHEN "distinct" > 1 THEN round(b1, 4) END AS median_1, CASE WHEN "distinct" > 1 THEN round(b0, 4) END AS median_0, CASE WHEN "distinct" > 1 THEN round(b1 - b0, 4) + 0.0 END AS median_difference
    FROM s JOIN k USING (feature) JOIN o USING (feature)""")
def numeric_feature_audit(spark, sf_dir):
    """Every measure of numeric features, by the target too, with missing, infinite, constant and empty columns."""
    s = audits.numeric_stats(audits.melted(_gappy(spark, sf_dir), ["quantity", "relief", "margin", "one", "nothing"], ["y"], infinite=True), "y")
    four = ["mean", "std", "value_range", "q01", "q05", "q10", "q25", "q50", "q75", "q90", "q95", "q99", "iqr", "mean_1", "mean_0", "mean_difference", "median_1", "median_0", "median_difference"]
    six = ["missing_rate", "zero_rate", "negative_rate", "positive_rate", "iqr_outliers_rate", "z_outliers_rate", "target_corr"]
    return rounded(s, dict.fromkeys(four, 4) | dict.fromkeys(six, 6) | {"variance": 2, "skewness": 5, "kurtosis": 5})


@query(_GAPPY + """
    SELECT l_linestatus, count(*) AS rows, 5 AS features, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives, round(count(*) FILTER (y = 1) / count(*), 6) AS positive_rate,
           5 * count(*) - count(quantity) - count(relief) - count(margin) - count(one) - count(nothing) AS missing_cells, count(*) FILTER (isinf(relief)) AS infinite_cells, 0 AS object_columns, '' AS object_sample,
           0 AS repeated_columns, false AS key_in_features, false AS target_in_features FROM d GROUP BY 1""")
def matrix_audit(spark, sf_dir):
    """The items of each line status as a matrix with its target."""
    return rounded(audits.matrix_audit(_gappy(spark, sf_dir), ["quantity", "relief", "margin", "one", "nothing"], "l_orderkey", "y", ["l_linestatus"]), {"positive_rate": 6})


@query("""
    WITH l AS (SELECT unnest(['doc_id', 'lang', 'source', 'n_chars', 'quality', 'toxic']) AS column_name, unnest(['bigint', 'string', 'string', 'bigint', 'int', 'int']) AS data_type, unnest([doc_id::VARCHAR, lang, source, n_chars::VARCHAR, quality::VARCHAR, toxic::VARCHAR]) AS v FROM documents LEFT JOIN labels USING (doc_id)),
    n AS (SELECT column_name, data_type, count(*) AS rows, count(*) - count(v) AS missing FROM l GROUP BY ALL),
    c AS (SELECT column_name, count(*) AS k FROM l WHERE v IS NOT NULL GROUP BY column_name, v),
    u AS (SELECT column_name, count(*) AS u, count(*) FILTER (k < 0.01 * (rows - missing)) AS r FROM c JOIN n USING (column_name) GROUP BY 1)
    SELECT column_name, data_type, rows, missing, round(100 * missing / rows, 4) AS missing_percentage, round(100 * missing / rows, 4) >= 40 AS is_high_missing, false AS is_day_column,
           CASE WHEN data_type = 'string' THEN u END AS unique_count, data_type = 'string' AND u > 50 AS is_high_cardinality, CASE WHEN data_type = 'string' THEN r END AS rare_categories FROM n LEFT JOIN u USING (column_name)""")
def missing_audit(spark, sf_dir):
    """Missing values and categories of the labelled documents."""
    return audits.missing_audit(t(spark, sf_dir, "documents").drop("text").join(t(spark, sf_dir, "labels"), "doc_id", "left"))


@query("""
    WITH d AS (SELECT o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS y FROM orders),
    k AS (SELECT k, count(*) AS n, count(DISTINCT y) + (count(*) > count(y))::INT AS targets FROM d GROUP BY 1),
    a AS (SELECT count(*) AS rows, count(*) FILTER (y = 0) AS target_0, count(*) FILTER (y = 1) AS target_1, count(*) FILTER (y IS NULL) AS target_missing, count(*) FILTER (y NOT IN (0, 1)) AS other_values FROM d)
    SELECT a.*, round(target_1 / rows, 6) AS target_1_ratio, (SELECT sum(n - 1) FROM k)::BIGINT AS repeated_keys, (SELECT count(*) FROM k WHERE k IS NOT NULL AND targets > 1) AS keys_with_several_targets,
           CASE WHEN round(target_1 / rows, 6) < 0.2 THEN 'class_imbalance_expected_and_significant' ELSE 'class_imbalance_mild_or_moderate' END AS imbalance,
           CASE WHEN target_missing = 0 AND other_values = 0 AND (SELECT count(*) FROM k WHERE k IS NOT NULL AND targets > 1) = 0 THEN 'target_audit_passed' ELSE 'blocked' END AS status FROM a""")
def target_audit(spark, sf_dir):
    """Whether an order's status could be a customer's target."""
    o = t(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0))
    return audits.target_audit(o, "o_custkey", "y")
