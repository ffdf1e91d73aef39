"""Statistics, resampling, evaluation and decisions."""

from pyspark.sql import functions as F

from ..functions.numeric import count_where, wilson
from ..operators import decisions, evaluation, ranking, statistics
from ..session import staged
from .registry import query, rounded, t

#: Customers' priorities in two years as conditions of a study: the contrast table of its planned comparisons.
_CONTRASTS = (("c1", "1-URGENT", "5-LOW"), ("c2", "2-HIGH", "5-LOW"), ("c3", "3-MEDIUM", "5-LOW"), ("c4", "4-NOT SPECIFIED", "5-LOW"))


def _cells(spark, sf_dir):
    """The mean price by nation, segment and priority."""
    j = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_nationkey", "c_mktsegment", "o_orderpriority").agg(F.avg("o_totalprice").alias("y"))


def _facts(spark, sf_dir):
    """The mean price by nation and priority, rounded so that ties are the same in any order of summing."""
    j = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_nationkey", "o_orderpriority").agg(F.floor(F.avg("o_totalprice") / 100).cast("double").alias("y"))


_FACTS = """
    WITH f AS (SELECT c_nationkey, o_orderpriority, floor(avg(o_totalprice) / 100)::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    k(contrast_id, first, second) AS (VALUES ('c1', '1-URGENT', '5-LOW'), ('c2', '2-HIGH', '5-LOW'), ('c3', '3-MEDIUM', '5-LOW'), ('c4', '4-NOT SPECIFIED', '5-LOW')),
    d AS (SELECT contrast_id, first, second, a.y - b.y AS d FROM k JOIN f a ON a.o_orderpriority = first JOIN f b ON b.o_orderpriority = second AND a.c_nationkey = b.c_nationkey) """


def _pairs(spark, sf_dir):
    k = spark.createDataFrame(list(_CONTRASTS), "contrast_id string, first string, second string")
    return statistics.paired(_facts(spark, sf_dir), "c_nationkey", "o_orderpriority", "y", k)


@query(_FACTS + """
    SELECT contrast_id, first, second, count(*) AS pairs, round(avg(d), 6) AS mean_difference, round(quantile_cont(d, 0.5), 4) AS median_difference, round(stddev_samp(d), 6) AS sd_difference, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d < 0) AS negative, count(*) FILTER (d = 0) AS zero FROM d GROUP BY 1, 2, 3""")
def paired_contrasts(spark, sf_dir):
    return rounded(statistics.contrast_summary(_pairs(spark, sf_dir)), {"mean_difference": 6, "median_difference": 4, "sd_difference": 6})


@query(_FACTS + """
    , r AS (SELECT contrast_id, d, rank() OVER (PARTITION BY contrast_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY contrast_id, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0),
    w AS (SELECT contrast_id, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus FROM r GROUP BY 1)
    SELECT contrast_id, w_plus, w_minus, round((w_plus - w_minus) / (w_plus + w_minus), 6) AS effect FROM w""")
def rank_biserial(spark, sf_dir):
    return rounded(statistics.rank_biserial(_pairs(spark, sf_dir)), {"effect": 6})


@query()
def signed_rank_tests(spark, sf_dir):
    """The signed-rank test of each contrast with its adjusted p-value; tested against known values."""
    w = ranking.holm(statistics.wilcoxon(_pairs(spark, sf_dir)).withColumn("family", F.lit("priority")), ["family"], "p", "contrast_id")
    return rounded(w, {"statistic": 4, "p": 8, "p_holm": 8})


@query("""
    WITH p AS (SELECT l_suppkey % 3 AS family, l_suppkey AS id, round(((l_suppkey * 7919) % 1000) / 5000, 6) AS p FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
    s AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1)) AS s FROM p)
    SELECT family, id, p, round(max(s) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM s""")
def holm_adjust(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id")).distinct().select((F.col("id") % 3).alias("family"), "id", F.round((F.col("id") * 7919) % 1000 / 5000, 6).alias("p"))
    return rounded(ranking.holm(d, ["family"], "p", "id"), {"p_holm": 8})


@query("""
    WITH s AS (SELECT n_nationkey, count(*)::DOUBLE AS x, sum(c_acctbal) AS y FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM s)
    SELECT round(corr(rx, ry), 6) AS rho, count(*) AS pairs FROM r""")
def spearman_rank(spark, sf_dir):
    d = t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("x"), F.sum("c_acctbal").alias("y"))
    return rounded(statistics.spearman(d, "x", "y"), {"rho": 6})


_CELLS = """
    WITH c AS (SELECT c_nationkey AS s, c_mktsegment AS a, o_orderpriority AS b, avg(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
    x AS (SELECT *, avg(y) OVER () AS m, avg(y) OVER (PARTITION BY s) AS ms, avg(y) OVER (PARTITION BY a) AS ma, avg(y) OVER (PARTITION BY b) AS mb, avg(y) OVER (PARTITION BY s, a) AS msa, avg(y) OVER (PARTITION BY s, b) AS msb, avg(y) OVER (PARTITION BY a, b) AS mab FROM c),
    g AS (SELECT count(DISTINCT s) - 1 AS ns, count(DISTINCT a) - 1 AS na, count(DISTINCT b) - 1 AS nb, sum((ma - m)^2) AS a, sum((mb - m)^2) AS b, sum((mab - ma - mb + m)^2) AS ab, sum((msa - ms - ma + m)^2) AS ea, sum((msb - ms - mb + m)^2) AS eb, sum((y - msa - msb - mab + ms + ma + mb - m)^2) AS eab FROM x),
    r AS (SELECT 'a' AS source, a AS ss, na AS df, ea AS e, na * ns AS dfe FROM g UNION ALL SELECT 'b', b, nb, eb, nb * ns FROM g UNION ALL SELECT 'a:b', ab, na * nb, eab, na * nb * ns FROM g) """


@query(_CELLS + """
    SELECT source, round(ss / 1e6, 3) AS ss_millions, df, round(e / 1e6, 3) AS error_millions, dfe AS df_error, round((ss / df) / (e / dfe), 6) AS f, round(ss / (ss + e), 6) AS partial_eta_squared FROM r""")
def rm_anova_ss(spark, sf_dir):
    r = statistics.rm_anova(_cells(spark, sf_dir), "c_nationkey", "c_mktsegment", "o_orderpriority", "y")
    r = r.select("source", (F.col("ss") / 1e6).alias("ss_millions"), "df", (F.col("ss_error") / 1e6).alias("error_millions"), "df_error", "f", "partial_eta_squared")
    return rounded(r, {"ss_millions": 3, "error_millions": 3, "f": 6, "partial_eta_squared": 6})


@query()
def rm_anova_pvalues(spark, sf_dir):
    """p-values with and without the correction for sphericity, by a function that SQL lacks."""
    cells = _cells(spark, sf_dir)
    r = statistics.rm_anova(cells, "c_nationkey", "c_mktsegment", "o_orderpriority", "y")
    marginal = lambda f: cells.groupBy("c_nationkey", f).agg(F.avg("y").alias("y"))
    eps = statistics.sphericity_epsilon(marginal("c_mktsegment"), "c_nationkey", "c_mktsegment", "y").withColumn("source", F.lit("a"))
    eps = eps.unionByName(statistics.sphericity_epsilon(marginal("o_orderpriority"), "c_nationkey", "o_orderpriority", "y").withColumn("source", F.lit("b")))
    eps = eps.unionByName(statistics.interaction_epsilon(cells, "c_nationkey", "c_mktsegment", "o_orderpriority", "y").withColumn("source", F.lit("a:b")))
    r = r.join(eps, "source").withColumn("p", statistics.f_pvalue(F.col("f"), F.col("df").cast("double"), F.col("df_error").cast("double")))
    r = r.withColumn("p_corrected", statistics.f_pvalue(F.col("f"), F.col("df") * F.col("epsilon"), F.col("df_error") * F.col("epsilon")))
    return rounded(r.select("source", "df", "df_error", "epsilon", "p", "p_corrected"), {"epsilon": 6, "p": 8, "p_corrected": 8})


_BOOT = _FACTS.replace("k(contrast_id", "n AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey FROM f)), k(contrast_id") + """
    , q AS (SELECT it, ('0x' || substr(md5('boot:' || it || ':' || k), 1, 7))::BIGINT % (SELECT max(n) FROM n) AS i FROM (SELECT unnest(range(200)) AS it), (SELECT unnest(range((SELECT max(n) FROM n))) AS k)),
    m AS (SELECT o_orderpriority, it, avg(y) AS mean FROM q JOIN n USING (i) JOIN f USING (c_nationkey) GROUP BY 1, 2) """


@query(_BOOT + """
    SELECT o_orderpriority, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high, round(avg(mean), 4) AS centre FROM m GROUP BY 1""")
def hash_bootstrap_ci(spark, sf_dir):
    """Percentile intervals of resampled means; one set of draws for all conditions."""
    f = _facts(spark, sf_dir)
    w = statistics.resamples(f.select("c_nationkey").distinct(), "c_nationkey", 200, "boot")
    return rounded(statistics.percentile_interval(statistics.bootstrap_means(f, w, "c_nationkey", "o_orderpriority", "y"), "o_orderpriority"), {"low": 4, "high": 4, "centre": 4})


@query(_BOOT + """
    , b AS (SELECT a.o_orderpriority, round(quantile_cont(r.mean - a.mean, 0.95), 4) AS upper_bound FROM m a JOIN m r ON r.it = a.it AND r.o_orderpriority = '1-URGENT' WHERE a.o_orderpriority <> '1-URGENT' GROUP BY 1)
    SELECT o_orderpriority, upper_bound, upper_bound <= 60 AS non_inferior FROM b""")
def noninferiority_gate(spark, sf_dir):
    f = _facts(spark, sf_dir)
    w = statistics.resamples(f.select("c_nationkey").distinct(), "c_nationkey", 200, "boot")
    b = statistics.difference_bound(statistics.bootstrap_means(f, w, "c_nationkey", "o_orderpriority", "y"), "o_orderpriority", F.col("o_orderpriority") != "1-URGENT", "1-URGENT")
    b = rounded(b, {"upper_bound": 4})
    return b.withColumn("non_inferior", decisions.non_inferior(F.col("upper_bound"), 60))


@query("""
    WITH h AS (SELECT o_orderpriority AS o, o_custkey % 2 AS half, avg(o_totalprice) - 250000 AS m, stddev_samp(o_totalprice) / sqrt(count(*)) * 1.96 AS w FROM orders GROUP BY 1, 2),
    j AS (SELECT a.o, a.m - a.w AS l1, a.m + a.w AS h1, b.m - b.w AS l2, b.m + b.w AS h2, a.m AS m1, b.m AS m2 FROM h a JOIN h b ON a.o = b.o AND a.half = 0 AND b.half = 1),
    s AS (SELECT *, CASE WHEN l1 > 0 THEN 1 WHEN h1 < 0 THEN -1 ELSE 0 END AS s1, CASE WHEN l2 > 0 THEN 1 WHEN h2 < 0 THEN -1 ELSE 0 END AS s2 FROM j)
    SELECT o AS o_orderpriority, CASE WHEN s1 <> 0 AND s1 = s2 THEN 'REPLICATED' WHEN s1 <> 0 AND s2 <> 0 THEN 'CONFLICT' WHEN sign(m1) * sign(m2) > 0 THEN 'DIRECTIONALLY_CONSISTENT' ELSE 'INCONCLUSIVE' END AS class FROM s""")
def replication_class(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_custkey") % 2).alias("half")).agg((F.avg("o_totalprice") - 250000).alias("m"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count("*")) * 1.96).alias("w"))
    side = lambda k: o.where(F.col("half") == k).select("o_orderpriority", F.col("m").alias(f"m{k}"), F.col("w").alias(f"w{k}"))
    j = side(0).join(side(1), "o_orderpriority")
    c = F.col
    return j.select("o_orderpriority", decisions.replication_class(c("m0") - c("w0"), c("m0") + c("w0"), c("m1") - c("w1"), c("m1") + c("w1"), c("m0"), c("m1")).alias("class"))


@query("""
    WITH n AS (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM n)
    SELECT lang, k, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round(least(1.0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM z""")
def wilson_interval(spark, sf_dir):
    g = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(count_where(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return rounded(g.select("lang", "k", "n", low.alias("low"), high.alias("high")), {"low": 6, "high": 6})


@query("""
    WITH c AS (SELECT unnest(['0', '1']) AS label), m AS (SELECT label, count(*) FILTER (quality::VARCHAR = label AND toxic::VARCHAR = label) AS tp, count(*) FILTER (quality::VARCHAR = label) AS s, count(*) FILTER (toxic::VARCHAR = label) AS p FROM labels, c GROUP BY 1),
    r AS (SELECT label, s, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS re FROM m)
    SELECT label, s AS support, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM r""")
def classification_report(spark, sf_dir):
    return rounded(statistics.class_report(t(spark, sf_dir, "labels"), "quality", "toxic", ["0", "1"]), {"precision": 6, "recall": 6, "f1": 6})


def _scored(spark, sf_dir):
    """A score of the documents from their length, against the quality label."""
    return t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(t(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") % 97 / 97.0).alias("s"))


_SCORED = "WITH d AS (SELECT doc_id, quality AS y, (n_chars % 97) / 97.0::DOUBLE AS s FROM documents JOIN labels USING (doc_id)) "


@query(_SCORED + """
    , g AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM d GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp FROM g)
    SELECT round(sum(n * (tp - p + p / 2)) / (sum(p) * sum(n)), 8) AS roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 8) AS average_precision FROM c""")
def classification_metrics(spark, sf_dir):
    return rounded(evaluation.ranking_metrics(_scored(spark, sf_dir), "y", "s"), {"roc_auc": 8, "average_precision": 8})


@query(_SCORED + """
    , c AS (SELECT h AS threshold, count(*) FILTER (y = 1 AND s >= h) AS tp, count(*) FILTER (y = 0 AND s >= h) AS fp, count(*) FILTER (y = 1 AND s < h) AS fn, count(*) FILTER (y = 0 AND s < h) AS tn FROM d, (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5])::DOUBLE AS h) GROUP BY 1)
    SELECT threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round((tp + fp) / (tp + fp + fn + tn), 6) AS positive_rate, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
def threshold_sweep(spark, sf_dir):
    return rounded(evaluation.at_thresholds(_scored(spark, sf_dir), "y", "s"), {"precision": 6, "recall": 6, "positive_rate": 6, "f1": 6})


@query(_SCORED + "SELECT round(avg((s - y) * (s - y)), 8) AS brier, count(*) AS rows FROM d")
def brier_score(spark, sf_dir):
    return rounded(evaluation.brier(_scored(spark, sf_dir), "y", "s"), {"brier": 8})


_RULES = (("balanced", "volume", 350.0, None, 1), ("balanced", "discount", None, 0.0502, 2), ("strict", "balance", 0.0, None, 1), ("strict", "volume", 380.0, None, 2))
_WEIGHTS = (("balanced", "volume", "max", 0.5), ("balanced", "discount", "min", 0.3), ("balanced", "balance", "max", 0.2), ("strict", "balance", "max", 0.7), ("strict", "volume", "max", 0.3))


def _options(spark, sf_dir):
    """All suppliers as options: balance, number of items, mean discount."""
    v = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("volume"), F.avg("l_discount").alias("discount"))
    s = t(spark, sf_dir, "supplier")
    return s.join(v, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("option_id"), F.col("s_acctbal").alias("balance"), "volume", F.round("discount", 6).alias("discount"))


_OPTIONS = """
    WITH v AS (SELECT l_suppkey, count(*)::DOUBLE AS volume, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1),
    o AS (SELECT s_suppkey AS option_id, s_acctbal AS balance, volume, discount FROM supplier LEFT JOIN v ON s_suppkey = l_suppkey),
    l AS (SELECT option_id, 'balance' AS criterion_id, balance AS value FROM o UNION ALL SELECT option_id, 'volume', volume FROM o UNION ALL SELECT option_id, 'discount', discount FROM o),
    r(scenario_id, criterion_id, lo, hi, n) AS (VALUES ('balanced', 'volume', 350.0, NULL, 1), ('balanced', 'discount', NULL, 0.0502, 2), ('strict', 'balance', 0.0, NULL, 1), ('strict', 'volume', 380.0, NULL, 2)),
    w(scenario_id, criterion_id, direction, weight) AS (VALUES ('balanced', 'volume', 'max', 0.5::DOUBLE), ('balanced', 'discount', 'min', 0.3), ('balanced', 'balance', 'max', 0.2), ('strict', 'balance', 'max', 0.7), ('strict', 'volume', 'max', 0.3)),
    k AS (SELECT scenario_id, option_id, n, criterion_id, coalesce(value IS NOT NULL AND (lo IS NULL OR value + 1e-12 >= lo) AND (hi IS NULL OR value - 1e-12 <= hi), false) AS ok FROM l JOIN r USING (criterion_id)),
    c AS (SELECT scenario_id, option_id, count(*) AS constraints, coalesce(string_agg(criterion_id, '|' ORDER BY n) FILTER (NOT ok), '') AS failed, bool_and(ok) AS eligible FROM k GROUP BY 1, 2),
    a AS (SELECT scenario_id, option_id, any_value(eligible) AS eligible, any_value(eligible) AND count(*) = count(value) AS score_available FROM l JOIN w USING (criterion_id) JOIN c USING (scenario_id, option_id) GROUP BY 1, 2),
    y AS (SELECT scenario_id, option_id, criterion_id, weight, direction, value FROM l JOIN w USING (criterion_id) JOIN a USING (scenario_id, option_id) WHERE score_available),
    m AS (SELECT scenario_id, option_id, weight, direction, value, min(value) OVER g AS lo, max(value) OVER g AS hi FROM y WINDOW g AS (PARTITION BY scenario_id, criterion_id)),
    x AS (SELECT scenario_id, option_id, weight, CASE WHEN hi - lo <= 1e-12 THEN 1.0 WHEN direction = 'min' THEN 1 - (value - lo) / (hi - lo) ELSE (value - lo) / (hi - lo) END AS s FROM m),
    u AS (SELECT scenario_id, option_id, eligible, score_available, utility FROM a LEFT JOIN (SELECT scenario_id, option_id, sum(weight * s) AS utility FROM x GROUP BY 1, 2) USING (scenario_id, option_id)),
    d AS (SELECT scenario_id, f.option_id AS better, g.option_id AS worse FROM (SELECT *, CASE direction WHEN 'min' THEN -value ELSE value END AS v FROM y) f JOIN (SELECT *, CASE direction WHEN 'min' THEN -value ELSE value END AS v FROM y) g USING (scenario_id, criterion_id)
          WHERE f.option_id <> g.option_id GROUP BY ALL HAVING bool_and(f.v >= g.v - 1e-12) AND bool_or(f.v > g.v + 1e-12)),
    p AS (SELECT scenario_id, option_id, eligible, score_available, coalesce(lost, 0) AS dominated_by, coalesce(won, 0) AS dominates, score_available AND lost IS NULL AS on_frontier
          FROM a LEFT JOIN (SELECT scenario_id, worse AS option_id, count(*) AS lost FROM d GROUP BY 1, 2) USING (scenario_id, option_id) LEFT JOIN (SELECT scenario_id, better AS option_id, count(*) AS won FROM d GROUP BY 1, 2) USING (scenario_id, option_id)) """


def _study(spark, sf_dir):
    """The options' criteria in long form, the objectives, and the options' eligibility; lines are read once."""
    rules = spark.createDataFrame(list(_RULES), "scenario_id string, criterion_id string, minimum_value double, maximum_value double, criterion_order int")
    weights = spark.createDataFrame(list(_WEIGHTS), "scenario_id string, criterion_id string, direction string, weight double")
    long = decisions.long_criteria(staged(_options(spark, sf_dir)), ["balance", "volume", "discount"])
    return long, weights, decisions.constraints(long, rules)


@query(_OPTIONS + "SELECT * FROM c")
def constraint_eval(spark, sf_dir):
    return _study(spark, sf_dir)[2]


@query(_OPTIONS + "SELECT scenario_id, option_id, eligible, score_available, round(utility, 6) AS utility FROM u")
def scenario_utility(spark, sf_dir):
    """Utilities of the options that are eligible and lack nothing, scaled among these."""
    return rounded(decisions.utility(*_study(spark, sf_dir)), {"utility": 6})


@query(_OPTIONS + "SELECT * FROM p")
def pareto_frontier(spark, sf_dir):
    """Who dominates whom within each scenario, by its objectives, among the scored options."""
    return decisions.frontier(*_study(spark, sf_dir))


@query(_OPTIONS + """
    , j AS (SELECT p.scenario_id, p.option_id, p.eligible, p.score_available, on_frontier, round(utility, 6) AS utility FROM p JOIN u USING (scenario_id, option_id)),
    h AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY eligible DESC, score_available DESC, on_frontier DESC, utility DESC NULLS LAST, option_id)::INT AS scenario_rank FROM j),
    q AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY scenario_id, eligible ORDER BY scenario_rank) END::INT AS eligible_rank, CASE WHEN on_frontier THEN row_number() OVER (PARTITION BY scenario_id, on_frontier ORDER BY scenario_rank) END::INT AS pareto_rank,
                 CASE WHEN score_available THEN row_number() OVER (PARTITION BY scenario_id, score_available ORDER BY utility DESC, option_id) END::INT AS utility_rank FROM h)
    SELECT *, CASE WHEN pareto_rank = 1 THEN 'PRIMARY' WHEN pareto_rank <= 3 THEN 'ALTERNATIVE' END AS role FROM q""")
def scenario_rank(spark, sf_dir):
    study = _study(spark, sf_dir)
    used = rounded(decisions.utility(*study), {"utility": 6})
    d = decisions.frontier(*study).select("scenario_id", "option_id", "on_frontier").join(used, ["scenario_id", "option_id"])
    return decisions.ranked(d, "scenario_id", "option_id")


@query("""
    WITH v AS (SELECT 'count' AS id, count(*)::DOUBLE AS value FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey::VARCHAR = '7' UNION ALL SELECT 'mean', avg(c_acctbal) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'single', CASE WHEN count(*) = 1 THEN max(c_acctbal) END FROM customer WHERE c_custkey = 17 UNION ALL SELECT 'several', CASE WHEN count(*) = 1 THEN max(c_acctbal) END FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT id, round(value, 6) AS value FROM v""")
def certified_numbers(spark, sf_dir):
    """Numbers of a report, each derived again from its filter, field and aggregation."""
    c = t(spark, sf_dir, "customer")
    specs = (("count", {"c_mktsegment": "BUILDING", "c_nationkey": 7}, None, "COUNT_ROWS"), ("mean", {"c_mktsegment": "BUILDING"}, "c_acctbal", "MEAN"), ("single", {"c_custkey": 17}, "c_acctbal", "DIRECT_SINGLE_ROW"), ("several", {"c_mktsegment": "BUILDING"}, "c_acctbal", "DIRECT_SINGLE_ROW"))
    out = None
    for i, where, field, kind in specs:
        one = decisions.certified(c, where, field, kind).select(F.lit(i).alias("id"), "value")
        out = one if out is None else out.unionByName(one)
    return rounded(out, {"value": 6})
