"""Operators on literal rows: missing values, ties, cases at the edge."""

import math
from itertools import product

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallowmere.functions import identity, numeric, texts
from tallowmere.operators import audits, checks, evaluation, metrics, models, oplog, panel, preparation, profiles, summaries


def one(spark, **columns):
    """One row of expressions, as a dict."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


L = F.lit


def null():
    return F.lit(None).cast("double")


def test_ratio_has_three_policies(spark):
    got = one(spark, a=numeric.ratio(L(1), L(2)), b=numeric.ratio(L(1), L(0)), c=numeric.ratio(L(1), L(-2)), d=numeric.ratio(L(1), L(-2), positive=False), e=numeric.ratio(L(1), L(0), 0.0), f=numeric.ratio(L(1), L(0), math.inf), g=numeric.ratio(L(1), null(), 0.0))
    assert got == {"a": 0.5, "b": None, "c": None, "d": -0.5, "e": 0.0, "f": math.inf, "g": None}


def test_missing_values(spark):
    nan, inf = L(float("nan")), L(math.inf)
    got = one(spark, a=numeric.clean(nan), b=numeric.clean(-inf), c=numeric.clean(L(1.5)), d=numeric.flag(null() > 1), e=numeric.number(L("x")), f=numeric.number(L("NaN")), g=numeric.number(L(" 2.5 ")), h=numeric.positive_part(L(-1)), i=numeric.unless(null() > 0, L(1)))
    assert got == {"a": None, "b": None, "c": 1.5, "d": 0, "e": None, "f": None, "g": 2.5, "h": None, "i": None}


def test_row_statistics_skip_missing_ones(spark):
    got = one(spark, **numeric.row_stats([L(1.0), null(), L(3.0)]))
    assert got == {"min": 1.0, "max": 3.0, "mean": 2.0, "std": pytest.approx(math.sqrt(2)), "missing": 1}
    assert one(spark, **numeric.row_stats([L(1.0), null()]))["std"] is None
    assert one(spark, **numeric.row_stats([null(), null()])) == {"min": None, "max": None, "mean": None, "std": None, "missing": 2}


def test_bands_scales_and_means(spark):
    got = one(spark, low=numeric.drift_band(L(0.0999)), mid=numeric.drift_band(L(0.1)), high=numeric.drift_band(L(0.25)), none=numeric.drift_band(null()), flat=numeric.scaled(L(3.0), L(3.0), L(3.0)), over=numeric.scaled(L(9.0), L(0.0), L(3.0)))
    assert got == {"low": "low", "mid": "medium", "high": "high", "none": "unknown", "flat": 1.0, "over": 1.0}
    g = one(spark, a=numeric.geometric_mean([(L(4.0), 1.0), (L(1.0), 1.0)]), b=numeric.geometric_mean([(L(0.0), 1.0), (L(1.0), 1.0)]), c=numeric.geometric_mean([(null(), 3.0), (L(5.0), 1.0)]), d=numeric.geometric_mean([(null(), 1.0)]))
    assert g == {"a": pytest.approx(2.0), "b": 0.0, "c": pytest.approx(5.0), "d": None}
    lo, hi = numeric.wilson(L(8), L(10))
    assert one(spark, lo=lo, hi=hi) == {"lo": pytest.approx(0.490162, abs=1e-6), "hi": pytest.approx(0.943318, abs=1e-6)}


def test_jaccard_and_months(spark):
    a = lambda *x: F.array(*map(L, x)).cast("array<int>")
    assert one(spark, a=numeric.jaccard(a(), a()), b=numeric.jaccard(a(1), a()), c=numeric.jaccard(a(1, 2), a(2, 3, 2))) == {"a": 1.0, "b": 0.0, "c": pytest.approx(1 / 3)}
    assert one(spark, a=numeric.month_ordinal(L("202401")), b=numeric.month_ordinal(L("202413")), c=numeric.month_ordinal(L("x"))) == {"a": 2024 * 12 + 1, "b": None, "c": None}


def test_texts(spark):
    rows = [("Straße_Ⅷ  ﬁn", "strasse viii fin"), (None, ""), ("a-b", "a b")]
    got = spark.createDataFrame(rows, "t string, want string").select(texts.folded("t").alias("f"), "want").collect()
    assert all(r.f == r.want for r in got)
    assert spark.createDataFrame([("Éàü 1!",)], "t string").select(texts.undiacritic("t").alias("x")).first().x == "eau 1"
    kind = lambda a, b: texts.pair_match(L(a), L(b))
    got = one(spark, e=kind("a b", "a b"), c=kind("x a b c d y", "a b c d"), s=kind("x a b y", "a b"), h=kind("e d c b q", "a b c d e"), n=kind("", "a"), part=kind("xa b c d", "a b c d"))
    assert got == {"e": "EXACT", "c": "CONTAINED", "s": "NONE", "h": "HIGH_OVERLAP", "n": "NONE", "part": "NONE" if 3 / 4 < 0.8 else "HIGH_OVERLAP"}
    assert one(spark, p=texts.percentages(L("about 12,5 % or 3%")))["p"] == [0.125, 0.03]
    j = one(spark, a=texts.json_in(L('so: ```json\n{"a": 1}\n``` ok')), b=texts.json_in(L('x {"b": [1]} y')), c=texts.json_in(L("{oops")), d=texts.json_in(L("none")))
    assert j == {"a": '{"a": 1}', "b": '{"b": [1]}', "c": None, "d": None}
    m = one(spark, **texts.content_metrics(L("One two. Three!")))
    assert (m["words"], m["sentences"], m["too_short"]) == (3, 2, True)


def test_identities_are_content(spark):
    got = one(spark, a=identity.case_id("d", L(7)), b=identity.case_id("d", L("7")), c=identity.case_id("e", L(7)))
    assert got["a"] == got["b"] != got["c"] and got["a"].startswith("case_d_7_") and len(got["a"].rsplit("_", 1)[1]) == 20


def test_profiles_on_a_spine(spark):
    spine = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    child = spark.createDataFrame([(1, 10.0), (1, None), (1, -2.0), (3, None), (None, 5.0)], "k int, v double")
    h = profiles.profile(child, "k", {"n": F.count("*"), "total": numeric.sum0(F.col("v")), "mean": F.avg("v")} | profiles.positive_measures(F.col("v"), "pos"))
    got = {r.k: r.asDict() for r in profiles.onto_spine(spine, h, "k", "has", ["n", "total"]).collect()}
    assert got[1] == {"k": 1, "n": 3, "total": 8.0, "mean": 4.0, "pos_count": 1, "pos_sum": 10.0, "pos_mean": 10.0, "pos_max": 10.0, "has": 1}
    assert (got[2]["n"], got[2]["total"], got[2]["mean"], got[2]["has"]) == (0, 0.0, None, 0)
    assert (got[3]["n"], got[3]["total"], got[3]["pos_max"], got[3]["has"]) == (1, 0.0, None, 1)


PANEL = {
    "sixty days are cured": ([(m, "2" if m == 4 else "0", None) for m in range(1, 13)], 0, None),
    "ninety days": ([(m, "3" if m == 12 else "0", None) for m in range(1, 13)], 1, None),
    "month 13 counts not": ([(m, "9" if m == 13 else "0", None) for m in range(1, 14)], 0, None),
    "repossession": ([(1, "0", None), (2, "RA", None)], 1, None),
    "serious code": ([(1, "0", None), (2, "0", "03")], 1, None),
    "gap": ([(m, "0", None) for m in range(1, 13) if m != 5], None, "missing_month_inside_12m_horizon"),
    "unknown": ([(m, "XX" if m == 5 else "0", None) for m in range(1, 13)], None, "unknown_delinquency_inside_12m_horizon"),
    "blank": ([(m, " " if m == 5 else "0", None) for m in range(1, 13)], None, "unknown_delinquency_inside_12m_horizon"),
    "paid early": ([(1, "0", None), (2, "0", "01")], 0, None),
    "paid early with gap": ([(1, "0", None), (3, "0", "01")], None, "missing_month_before_voluntary_payoff"),
    "starts late": ([(m, "0", None) for m in range(2, 14)], None, "left_censored_after_payment_month_1"),
    "sold": ([(1, "0", None), (2, "0", "16")], None, "non_outcome_termination_16"),
    "short": ([(1, "0", None), (2, "0", None)], None, "insufficient_12m_observation"),
}


def month(i):
    return f"{2023 + (i - 1) // 12}{(i - 1) % 12 + 1:02d}"


def test_panel_target(spark):
    rows = [(name, month(i), s, c) for name, (months, *_) in PANEL.items() for i, s, c in months]
    p = spark.createDataFrame(rows, "entity string, period string, status string, code string")
    anchors = spark.createDataFrame([(n, "202301") for n in PANEL] + [("absent", "202301")], "entity string, first_period string")
    for d in (p, p.repartition(5), p.unionByName(p)):  # neither order nor repeated months matter
        got = {r.entity: (r.target, r.censor_reason) for r in panel.panel_target(d, anchors).collect()}
        assert got == {n: (t, why) for n, (_, t, why) in PANEL.items()}


def test_gaps(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 1)], "e string, m int")
    assert sorted((r.e, r.m, r.step) for r in panel.gaps(d, "e", "m").collect()) == [("a", 4, 2), ("b", 1, 0)]


def test_checks(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2, "c"), (None, "d")], "k int, v string")
    assert [tuple(r) for r in checks.duplicates(d, ["k"]).orderBy("k").collect()] == [(1, 2), (2, 2)]
    assert checks.unique_key(d.where("v in ('a', 'c', 'd')"), ["k"]).count() == 3
    with pytest.raises(Exception, match="not unique"):
        checks.unique_key(d, ["k"]).collect()
    assert {(r.k, r["values"]) for r in checks.inconsistent(d, "k", "v").collect()} == {(1, 2), (2, 2)}
    assert sorted(r.v for r in checks.orphans(d, spark.createDataFrame([(1,)], "k int"), ["k"]).collect() if r.v) == ["c", "d"]
    assert {(r.k, r.merge) for r in checks.reconcile(spark.createDataFrame([(1, 1), (2, 1)], "k int, a int"), spark.createDataFrame([(2, 1), (3, 1)], "k int, b int"), ["k"]).collect()} == {(1, "left_only"), (2, "both"), (3, "right_only")}
    cells = checks.expected_cells(spark.createDataFrame([("m",), ("n",)], "x string"), spark.createDataFrame([(1,), (2,)], "y int"))
    assert {(r.x, r.y, r.state) for r in checks.holes(cells, spark.createDataFrame([("m", 1), ("q", 1), ("m", 1)], "x string, y int"), ["x", "y"]).collect()} == {("m", 2, "missing"), ("n", 1, "missing"), ("n", 2, "missing"), ("q", 1, "unexpected")}


def test_moments_are_corrected_and_quantiles_linear(spark):
    v = [1.0, 2.0, 2.0, 3.0, 50.0, None, float("nan")]
    s = audits.numeric_stats(audits.melted(spark.createDataFrame([(x,) for x in v], "x double"), ["x"])).first()
    import pandas as pd

    p = pd.Series(v).dropna()
    assert (s.rows, s.present, s.distinct) == (7, 5, 4)
    assert s["skewness"] == pytest.approx(p.skew()) and s["kurtosis"] == pytest.approx(p.kurt()) and s["std"] == pytest.approx(p.std())
    assert s.q75 == pytest.approx(p.quantile(0.75)) and s.q05 == pytest.approx(p.quantile(0.05))
    assert s.iqr_outliers == 1


def test_drift_of_equal_and_of_constant_values(spark):
    d = spark.createDataFrame([(float(i % 10), i < 50) for i in range(100)], "v double, r boolean")
    assert audits.psi(d, "v", F.col("r")).first().psi == pytest.approx(0.0)
    assert tuple(audits.psi(d.withColumn("v", L(1.0)), "v", F.col("r")).first())[1:] == (0.0, "low")
    assert audits.psi(d.where("r"), "v", F.col("r")).first().psi is None
    assert audits.psi(d.withColumn("v", F.when(F.col("r"), F.col("v")).otherwise(9.0)), "v", F.col("r")).first().drift == "high"


def test_split_is_exact_and_stable(spark):
    d = spark.createDataFrame([(i, i % 4 == 0) for i in range(400)], "k int, y boolean")
    s = preparation.stratified_split(d, "k", "y", "seed")
    n = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert n == {(True, "train"): 70, (True, "valid"): 15, (True, "test"): 15, (False, "train"): 210, (False, "valid"): 45, (False, "test"): 45}
    key = lambda x: {r.k: r.split for r in x.collect()}
    assert key(s) == key(preparation.stratified_split(d.repartition(6), "k", "y", "seed"))
    assert preparation.overlaps(s, "k").count() == 0


def test_categories_and_one_hot(spark):
    train = spark.createDataFrame([("a",)] * 150 + [("b",)] * 149 + [("rare",)] + [(None,)] * 2, "c string")
    levels = preparation.category_levels(train, "c")
    got = {r.c: r.e for r in preparation.encoded_category(spark.createDataFrame([("a",), ("rare",), ("new",), (None,)], "c string"), "c", levels, "e").collect()}
    assert got == {"a": "a", "rare": "__RARE__", "new": "__UNKNOWN__", None: "__MISSING__"}
    assert preparation.one_hot(train, "c", ["a", "b b"]).columns == ["c__a", "c__b_b"]
    with pytest.raises(ValueError, match="one name"):
        preparation.one_hot(train, "c", ["b b", "b-b"])


def test_imputation_uses_training_rows_and_population_sd(spark):
    train = spark.createDataFrame([(1.0, 5.0, 1), (3.0, 5.0, 1), (None, 5.0, 0)], "x double, flat double, b int")
    f = preparation.imputation(train, ["x", "flat"], ["b"])
    got = preparation.imputed_scaled(spark.createDataFrame([(None, 5.0, None), (4.0, 6.0, 0)], "x double, flat double, b int"), f, ["x", "flat"], ["b"]).collect()
    sd = math.sqrt(2 / 3)
    assert [tuple(r) for r in got] == [(0.0, 0.0, 1), (pytest.approx(2 / sd), 1.0, 0)]


def test_ranking_metrics_count_ties_half(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (None, 0.3)], "y int, s double")
    m = evaluation.ranking_metrics(d, "y", "s").first()
    assert m.roc_auc == pytest.approx((0.5 + 1 + 0 + 1) / 4) and m.average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    t = {r.threshold: r for r in evaluation.at_thresholds(d, "y", "s", [0.5, 0.95]).collect()}
    assert (t[0.5].tp, t[0.5].fp, t[0.5].fn, t[0.5].tn) == (2, 1, 0, 1) and t[0.95].precision == 0.0


def test_metrics_and_losses(spark):
    rows = [(1, 2, 1, 1, 0, True), (2, 2, 0, 0, 0, False), (3, 0, 0, 0, 0, True)]
    d = spark.createDataFrame(rows, "g int, supported_count int, unsupported_count int, contradicted_count int, not_verifiable_count int, usable boolean")
    q = {r.g: r for r in metrics.quality(d).collect()}
    assert (q[1].resolved_faithfulness, q[1].end_to_end_yield, q[2].end_to_end_yield, q[3].end_to_end_yield, q[3].resolved_faithfulness) == (0.5, 0.5, 0.0, None, None)
    ls = {r.g: r for r in metrics.losses(d).collect()}
    assert all(r.identity_holds for r in ls.values()) and ls[3].pipeline_loss == ls[2].pipeline_loss == 1.0


def test_grouping_sets_keep_nulls_apart(spark):
    d = spark.createDataFrame([("a", "x"), ("a", None), (None, "x")], "p string, q string")
    got = {(r.group_type, r.p, r.q): r.n for r in summaries.grouping_sets(d, {"all": [], "p": ["p"], "both": ["p", "q"]}, {"n": F.count("*")}).collect()}
    assert got == {("all", None, None): 3, ("p", "a", None): 2, ("p", None, None): 1, ("both", "a", "x"): 1, ("both", "a", None): 1, ("both", None, "x"): 1}
    assert tuple(summaries.mode(d.withColumn("g", L(1)), ["g"], "q").first()) == (1, "x", 2)


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "p string, c string")
    got = {(r.node, r.distance) for r in oplog.closure(e, ["a"], "p", "c", 5).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.node for r in oplog.closure(e, ["d"], "p", "c", 5, "ancestors").collect()} == {"a", "b", "c", "d"}
    acyclic = e.where("c <> 'a'")
    nodes = spark.createDataFrame([(x,) for x in "abcdz"], "n string")
    assert {r.n: r.level for r in oplog.levels(nodes, acyclic, "n", "p", "c").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "z": 0}
    with pytest.raises(ValueError, match="cycle"):
        oplog.levels(nodes, e, "n", "p", "c")
    assert oplog.closes_cycle(acyclic, "p", "c", "d", "a") and not oplog.closes_cycle(acyclic, "p", "c", "a", "d")


def test_models_train_and_score(spark):
    rows = [(i, float(i % 10), float((i * 7) % 11), int(i % 10 > 4)) for i in range(400)]
    d = spark.createDataFrame(rows, "id long, a double, b double, label int").withColumn("weight", L(1.0))
    x = models.assembled(d, ["a", "b"])
    model = models.classifiers()["logistic_regression"].fit(x)
    s = models.scored(model, x)
    assert evaluation.ranking_metrics(s, "label", "score").first().roc_auc > 0.99
    assert models.importance(model, ["a", "b"])[0][0] == "a"


def test_order_of_rows_is_indifferent(spark):
    rows = [Row(k=i % 3, v=float(v)) for i, v in product(range(6), range(4))]
    d = spark.createDataFrame(rows)
    m = {"n": F.count("*"), "mean": F.avg("v")}
    assert sorted(map(tuple, profiles.profile(d, "k", m).collect())) == sorted(map(tuple, profiles.profile(d.orderBy(F.desc("v")).repartition(7), "k", m).collect()))
