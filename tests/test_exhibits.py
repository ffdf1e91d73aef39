"""Mentions, stability, designs of contrasts and release tables against plain reckoning, odd rows included."""

import statistics as plain

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallowmere.functions.texts import heavy_prose, technical_terms
from tallowmere.operators import matching, reports, statistics


def test_technical_words_and_prose(spark):
    d = spark.createDataFrame([(1, "a_b AB aB shaply xShApx\tplain"), (2, None), (3, ""), (4, "The the AND from, thistle this!")], "i int, t string")
    got = {r.i: (r.n, r.h) for r in d.select("i", technical_terms(F.col("t"), ["SHAP"]).alias("n"), heavy_prose(F.col("t"), ["the", "and", "from", "this"], 5).alias("h")).collect()}
    assert got == {1: (4, False), 2: (0, False), 3: (0, False), 4: (1, True)}
    assert d.select(technical_terms(F.col("t")).alias("n")).where("i = 1").first().n == 2


OUTPUTS = "output_id int, package_id string, text string, declared_features array<string>, declared_concepts array<string>"
ITEMS = "package_id string, item_order int, feature_id string, aliases array<string>, concept_id string, concept_aliases array<string>"


def test_mentions_of_a_package(spark):
    items = [("p", 1, "f1", ["income", None], "money", ["wealth"]), ("p", 2, "f2", ["ab"], "money", None), ("p", 3, "f3", ["late payment"], "delay", ["delays"]), ("p", 4, "f4", None, None, None), ("p", 5, "f5", ["age"], "person", [])]
    outputs = [
        (1, "p", "income and ab wealth", ["f4", "f4", "zz", ""], ["person", "other"]),
        (2, "p", None, ["f1"], ["money"]),
        (3, "p", "", [], None),
        (4, "none", "income", ["f1"], []),
    ]
    got = {r.output_id: r for r in matching.evidence_mentions(spark.createDataFrame(outputs, OUTPUTS), spark.createDataFrame(items, ITEMS)).collect()}
    a = got[1]  # f1 by alias, f4 declared; ab is too short
    assert (a.selected_features, a.mentioned_features, a.feature_mention_rate, a.top1_mention_rate, a.top3_mention_rate, a.top5_mention_rate) == (5, 2, 0.4, 1.0, pytest.approx(1 / 3), 0.4)
    assert (a.exposed_concepts, a.mentioned_concepts, a.concept_mention_rate) == (3, 2, pytest.approx(2 / 3))
    assert (a.n_declared_features, a.valid_features, a.invalid_features, a.n_declared_concepts, a.valid_concepts, a.invalid_concepts) == (2, 1, 1, 2, 1, 1)
    b = got[2]
    assert (b.mentioned_features, b.feature_mention_rate, b.mentioned_concepts, b.n_declared_features, b.n_declared_concepts) == (0, 0.0, 0, 0, 0)
    assert (got[3].mentioned_features, got[3].top1_mention_rate, got[3].mentioned_concepts) == (0, 0.0, 0)
    c = got[4]
    assert (c.selected_features, c.feature_mention_rate, c.top1_mention_rate, c.exposed_concepts, c.concept_mention_rate, c.invalid_features) == (0, None, None, 0, None, 1)
    assert matching.evidence_mentions(spark.createDataFrame([], OUTPUTS), spark.createDataFrame(items, ITEMS)).count() == 0


def test_stability_of_repeats(spark):
    rows = [
        ("a", 1, True, True, 10, 2, ["x", "y"], ["k"]), ("a", 2, True, False, 14, 5, ["x"], ["k", "l"]), ("a", 3, False, None, 99, 9, ["q"], []), ("a", 4, True, True, 11, 2, [], []),
        (None, 1, True, True, 3, 1, ["x"], ["k"]), ("c", 1, None, False, 3, 1, ["x"], ["k"]),
    ]
    d = spark.createDataFrame(rows, "g string, r int, usable boolean, schema_valid boolean, length int, factors int, features array<string>, concepts array<string>")
    got = {r.g: r for r in matching.repeat_stability(d, ["g"], "r").collect()}
    a = got["a"]
    assert (a.repeats, a.usable_repeats, a.schema_stability_rate) == (4, 3, 0.5)
    assert a.length_sd == pytest.approx(plain.pstdev([10, 14, 11])) and a.factors_sd == pytest.approx(plain.pstdev([2, 5, 2]))
    assert a.features_jaccard == pytest.approx((0.5 + 0 + 0) / 3) and a.concepts_jaccard == pytest.approx((0.5 + 0 + 0) / 3)
    one, none = got[None], got["c"]
    assert (one.usable_repeats, one.length_sd, one.features_jaccard) == (1, 0.0, None)
    assert (none.usable_repeats, none.length_sd, none.schema_stability_rate) == (0, None, 0.0)


def test_false_accepts_and_rejects(spark):
    d = spark.createDataFrame([("S", "S"), ("S", "U"), ("U", "S"), ("U", "U"), ("U", "U"), (None, "S")], "t string, p string")
    r = statistics.class_summary(d, "t", "p", ["S", "U"], "S").first()
    assert (r.false_accept_rate, r.false_reject_rate) == (0.5, 0.5) and r.macro_f1 == pytest.approx((0.4 + 2 / 3) / 2)
    none = statistics.class_summary(d.limit(0), "t", "p", ["S", "U"], "S").first()
    assert (none.macro_f1, none.false_accept_rate, none.false_reject_rate) == (0, 0, 0)


def test_a_design_of_three_models_and_six_levels(spark):
    k = statistics.planned_contrasts(spark, ["a", "b", "c"], ["S0", "S1", "S2", "S3", "S4", "S5"], "S0")
    assert {r.family: r["count"] for r in k.groupBy("family").count().collect()} == {"model_within_level": 18, "level_against_baseline": 15}
    with pytest.raises(ValueError, match="S9"):
        statistics.planned_contrasts(spark, ["a"], ["S0"], "S9")
    facts = spark.createDataFrame([(1, "a", "S0", 1.0), (1, "b", "S0", 3.0), (2, "a", "S0", 5.0), (2, "b", "S0", None), (1, "a", "S1", 2.0)], "case int, m string, e string, y double")
    got = {r.contrast_id: r for r in statistics.planned_summary(facts, "case", "m", "e", "y", statistics.planned_contrasts(spark, ["a", "b"], ["S0", "S1"], "S0")).collect()}
    assert len(got) == 4 and {r.planned_pairs for r in got.values()} == {2}
    assert (got["a|S0 - b|S0"].pairs, got["a|S0 - b|S0"].mean_difference, got["a|S0 - b|S0"].negative) == (1, -2.0, 1)
    assert got["a|S1 - a|S0"].mean_difference == 1.0 and (got["b|S1 - b|S0"].pairs, got["b|S1 - b|S0"].mean_difference) == (0, None)


def test_rows_of_a_release_agree_with_their_numbers(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double")
    numbers = [("n::a", 0.5 + 1e-13), ("n::b", None), ("n::c", 7.0)]
    certified = lambda xs: spark.createDataFrame(xs, "report_number_id string, value double")
    id_ = F.concat(F.lit("n::"), F.col("k"))
    assert {tuple(r) for r in reports.reconciled(rows, certified(numbers), id_, "v").collect()} == {("a", 0.5, "n::a"), ("b", None, "n::b")}
    for wrong, name in (([("n::a", 0.6), numbers[1]], "n::a"), (numbers[:1], "n::b"), ([*numbers, numbers[0]], "n::a"), ([numbers[0], ("n::b", 1.0)], "n::b")):
        with pytest.raises(PySparkException, match=name):
            reports.reconciled(rows, certified(wrong), id_, "v").collect()
    assert reports.reconciled(rows.limit(0), certified([]), id_, "v").count() == 0


def test_two_studies_side_by_side(spark):
    side = lambda xs: spark.createDataFrame(xs, "effect string, f double, significant boolean")
    a, b = side([("x", 1.0, True), ("y", 2.0, True), ("only", 3.0, True)]), side([("x", 4.0, True), ("y", 5.0, None)])
    got = {r.effect: r for r in reports.across(a, b, "effect", ["f", "significant"], ("h", "g"), "significant").collect()}
    assert set(got) == {"x", "y"} and (got["x"].h_f, got["x"].g_f, got["x"].both_significant, got["y"].both_significant) == (1.0, 4.0, True, False)
    assert reports.across(a, b, "effect", ["f"], ("h", "g")).columns == ["effect", "h_f", "g_f"]


def test_cases_and_columns(spark):
    g = spark.createDataFrame([(1, True, 2), (1, True, None), (2, False, None), (2, None, 3), (None, True, None)], "case int, usable boolean, claims int")
    got = {r.case: tuple(r)[1:] for r in reports.case_index(g, ["case"], F.col("usable"), F.col("claims")).collect()}
    assert got == {1: (2, 2, 2, True), 2: (2, 0, 3, False), None: (1, 1, 0, True)}
    assert [tuple(r) for r in reports.columns_of({"z": g.select("case"), "a": g.select("usable", "claims")}).orderBy("table_name", "place").collect()] == [("a", "usable", 0, "boolean"), ("a", "claims", 1, "int"), ("z", "case", 0, "int")]
