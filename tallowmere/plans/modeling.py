"""Training, attribution of scores to features, and scores of perturbed cases."""

from pyspark.sql import functions as F

from ..operators import evidence, models, preparation, trees
from ..operators.quantiles import quantiles
from ..session import staged
from .registry import query, rounded, t

#: A linear score of an order: its lines' quantity, mean discount and number.
_WEIGHTS = {"qty": 0.01, "disc": 5.0, "lines": -0.2}
_ORDERS = "WITH o AS (SELECT l_orderkey, sum(l_quantity::DOUBLE) AS qty, avg(l_discount::DOUBLE) AS disc, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1), "
_LONG = _ORDERS + """
    m AS (SELECT avg(qty) AS qty, avg(disc) AS disc, avg(lines) AS lines, quantile_cont(qty, 0.5) AS mq, quantile_cont(disc, 0.5) AS md, quantile_cont(lines, 0.5) AS ml FROM o),
    a AS (SELECT l_orderkey, f.* FROM o, m, LATERAL (VALUES ('qty', 0.01 * (o.qty - m.qty), 0.01 * (o.qty - mq)), ('disc', 5.0 * (o.disc - m.disc), 5.0 * (o.disc - md)), ('lines', -0.2 * (o.lines - m.lines), -0.2 * (o.lines - ml))) f(feature_id, v, d))"""


def _orders(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem")
    return d.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("double")).alias("qty"), F.avg(F.col("l_discount").cast("double")).alias("disc"), F.count("*").cast("double").alias("lines"))


def _attributions(o):
    means = o.agg(*[F.avg(c).alias(c) for c in _WEIGHTS]).first().asDict()
    return models.linear_attributions(o, "l_orderkey", _WEIGHTS, means)


@query(_LONG + " SELECT l_orderkey, feature_id, round(v, 6) + 0.0 AS shap_value FROM a")
def linear_attribution(spark, sf_dir):
    return rounded(_attributions(_orders(spark, sf_dir)), {"shap_value": 6})


@query(_LONG + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(abs(v), 9) DESC, feature_id) AS k FROM a)
    SELECT l_orderkey, round(sum(d) FILTER (k = 1), 6) + 0.0 AS comprehensiveness, round(coalesce(sum(d) FILTER (k > 1), 0), 6) + 0.0 AS sufficiency FROM r GROUP BY 1""")
def perturbed_scores(spark, sf_dir):
    """How far a score falls without its strongest feature, and with that one only."""
    o = _orders(spark, sf_dir)
    local = evidence.ranked_local(_attributions(o).withColumn("shap_value", F.round("shap_value", 9)), "l_orderkey")
    melted = o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in _WEIGHTS])).alias("x")).select("x.*")
    medians = {r.feature: r.q[0] for r in quantiles(melted, ["feature"], "value", [0.5]).collect()}
    score = sum((F.col(f) * w for f, w in _WEIGHTS.items()), F.lit(0.0))
    own = o.select("l_orderkey", score.alias("own"))
    without, only = (models.perturbed(o, local, "l_orderkey", list(_WEIGHTS), medians, 1, keep).select("l_orderkey", score.alias(n)) for keep, n in ((False, "without"), (True, "only")))
    j = own.join(without, "l_orderkey").join(only, "l_orderkey")
    return rounded(j.select("l_orderkey", (F.col("own") - F.col("without")).alias("comprehensiveness"), (F.col("own") - F.col("only")).alias("sufficiency")), {"comprehensiveness": 6, "sufficiency": 6})


@query()
def model_scores(spark, sf_dir):
    """Scores of a logistic regression with balanced weights, fitted on the training split: returned flags from a line's numbers."""
    names = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    d = t(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("case_id"), *[F.col(n).cast("double").alias(n) for n in names], (F.col("l_returnflag") == "R").cast("int").alias("label"))
    d = staged(preparation.stratified_split(d, "case_id", "label", "model"))  # read by the imputation, the fit and the scores
    fitted = preparation.imputation(d.where("split = 'train'"), names, [])
    x = models.assembled(preparation.with_balanced_weight(preparation.imputed_scaled(d, fitted, names), "label"), names)
    model = models.classifiers()["logistic_regression"].fit(x.where("split = 'train'"))
    return models.scored(model, x).select("case_id", "split", "label", F.round("score", 6).alias("score"))


@query()
def permutation_attribution(spark, sf_dir):
    """Sampled-permutation attributions of a saturating score of suppliers; the parts of a case add up to its score less the base."""
    s = t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    predict = lambda m: 1 / (1 + 2.718281828459045 ** -(m[:, 0] / 5000 - m[:, 1] / 25))
    background = [[0.0, 5.0], [2500.0, 12.0], [5000.0, 12.0], [9000.0, 20.0]]
    return models.permutation_attributions(s, "s_suppkey", ["balance", "nation"], predict, background, permutations=4)


#: A small ensemble of stored splits on a line's numbers: (tree, node, feature, threshold, left, right), and the trees' weights.
_NAMES = ["l_quantity", "l_discount", "l_extendedprice"]
_SPLITS = [(0, 0, 0, 24.0, 1, 2), (0, 1, 1, 0.04, 3, 4), (0, 2, 2, 50000.0, 5, 6), (1, 0, 2, 30000.0, 1, 2), (1, 1, 2, 12000.0, 3, 4), (1, 2, 0, 40.0, 5, 6), (1, 5, 1, 0.06, 7, 8)]
_TREES = [0.6, 0.4]


def _lines(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("case_id"), *[F.col(n).cast("double").alias(n) for n in _NAMES], (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return d


@query("""
    WITH x AS (SELECT l_orderkey || '-' || l_linenumber AS case_id, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, l_extendedprice::DOUBLE AS p, (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem),
    s(tree, node, f, th, lo, hi) AS (VALUES (0, 0, 0, 24.0::DOUBLE, 1, 2), (0, 1, 1, 0.04, 3, 4), (0, 2, 2, 50000.0, 5, 6), (1, 0, 2, 30000.0, 1, 2), (1, 1, 2, 12000.0, 3, 4), (1, 2, 0, 40.0, 5, 6), (1, 5, 1, 0.06, 7, 8)),
    edges AS (SELECT tree, node AS up, f, th, lo AS node, true AS low FROM s UNION ALL SELECT tree, node, f, th, hi, false FROM s),
    v AS (SELECT case_id, y, list_value(q, d, p) AS v FROM x),
    -- every node that a row comes through, for covers and values
    r AS (SELECT case_id, y, v, tree, 0 AS node FROM v, (SELECT DISTINCT tree FROM s)),
    r1 AS (SELECT r.case_id, r.y, r.v, r.tree, e.node FROM r JOIN edges e ON e.tree = r.tree AND e.up = r.node AND (r.v[e.f + 1] <= e.th) = e.low),
    r2 AS (SELECT r.case_id, r.y, r.v, r.tree, e.node FROM r1 r JOIN edges e ON e.tree = r.tree AND e.up = r.node AND (r.v[e.f + 1] <= e.th) = e.low),
    r3 AS (SELECT r.case_id, r.y, r.v, r.tree, e.node FROM r2 r JOIN edges e ON e.tree = r.tree AND e.up = r.node AND (r.v[e.f + 1] <= e.th) = e.low),
    c AS (SELECT tree, node, count(*)::DOUBLE AS cover, avg(y) AS value FROM (SELECT tree, node, y FROM r UNION ALL SELECT tree, node, y FROM r1 UNION ALL SELECT tree, node, y FROM r2 UNION ALL SELECT tree, node, y FROM r3) GROUP BY ALL),
    -- the value of every subset of known features, leaf by leaf: splits on known features decide, others count by cover
    sub AS (SELECT range AS m FROM range(8)),
    w AS (SELECT DISTINCT v FROM v),
    g0 AS (SELECT v, m, tree, 0 AS node, 1.0::DOUBLE AS share FROM w, sub, (SELECT DISTINCT tree FROM s)),
    g1 AS (SELECT g.v, m, g.tree, e.node, share * CASE WHEN (m >> e.f) & 1 = 1 THEN ((g.v[e.f + 1] <= e.th) = e.low)::INT ELSE a.cover / b.cover END AS share
           FROM g0 g JOIN edges e ON e.tree = g.tree AND e.up = g.node JOIN c a ON a.tree = e.tree AND a.node = e.node JOIN c b ON b.tree = e.tree AND b.node = e.up),
    g2 AS (SELECT g.v, m, g.tree, e.node, share * CASE WHEN (m >> e.f) & 1 = 1 THEN ((g.v[e.f + 1] <= e.th) = e.low)::INT ELSE a.cover / b.cover END AS share
           FROM g1 g JOIN edges e ON e.tree = g.tree AND e.up = g.node JOIN c a ON a.tree = e.tree AND a.node = e.node JOIN c b ON b.tree = e.tree AND b.node = e.up),
    g3 AS (SELECT g.v, m, g.tree, e.node, share * CASE WHEN (m >> e.f) & 1 = 1 THEN ((g.v[e.f + 1] <= e.th) = e.low)::INT ELSE a.cover / b.cover END AS share
           FROM g2 g JOIN edges e ON e.tree = g.tree AND e.up = g.node JOIN c a ON a.tree = e.tree AND a.node = e.node JOIN c b ON b.tree = e.tree AND b.node = e.up),
    f AS (SELECT v, m, sum(share * value * CASE g.tree WHEN 0 THEN 0.6 ELSE 0.4 END) AS value
          FROM (SELECT * FROM g2 UNION ALL SELECT * FROM g3) g JOIN c USING (tree, node) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.tree = g.tree AND s.node = g.node) GROUP BY v, m),
    phi AS (SELECT a.v, i, sum((b.value - a.value) * CASE bit_count(a.m) WHEN 1 THEN 1.0 / 6 ELSE 1.0 / 3 END) AS phi
            FROM f a JOIN range(3) k(i) ON (a.m >> i) & 1 = 0 JOIN f b ON b.v = a.v AND b.m = a.m + (1 << i) GROUP BY a.v, i)
    SELECT case_id, ['l_quantity', 'l_discount', 'l_extendedprice'][i + 1] AS feature_id, round(phi, 9) + 0.0 AS shap_value, round(n.value, 9) AS base_value, round(o.value, 9) AS model_output
    FROM v JOIN phi USING (v) JOIN f n ON n.v = v.v AND n.m = 0 JOIN f o ON o.v = v.v AND o.m = 7""")
def refitted_tree_attribution(spark, sf_dir):
    """Stored splits refitted to all lines, and what each feature adds to each line's share of returns; the SQL forms all subsets."""
    d = _lines(spark, sf_dir)
    nodes = trees.refitted(d, _NAMES, "label", _SPLITS, _TREES)
    out = trees.tree_attributions(d, "case_id", _NAMES, nodes)
    return rounded(out.select("case_id", "feature_id", "shap_value", "base_value", "model_output"), {"shap_value": 9, "base_value": 9, "model_output": 9})


@query()
def boosted_attribution(spark, sf_dir):
    """Exact attributions of boosted trees fitted on the training split, for every line: margins, with the check that they add up."""
    d = staged(preparation.stratified_split(_lines(spark, sf_dir), "case_id", "label", "model"))  # read by the fit and the attributions
    x = models.assembled(preparation.with_balanced_weight(d, "label"), _NAMES)
    model = models.GBTClassifier(labelCol="label", weightCol="weight", maxIter=10, maxDepth=3, stepSize=0.1, seed=42).fit(x.where("split = 'train'"))
    return trees.tree_attributions(d, "case_id", _NAMES, trees.node_table(model))
