"""Audits, profiles, searches and running counts against pandas and against plain reckoning, odd rows included."""

import datetime
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallowmere.functions.numeric import count_where
from tallowmere.operators import audits, decisions, profiles, ranking


def test_numeric_measures_equal_pandas(spark):
    r = random.Random(5)
    rows = [(r.choice([None, 0.0, -1.5, 2.0, float("inf"), float("nan"), r.gauss(3, 9)]), 7.0, None, r.choice([0, 1, None])) for _ in range(400)]
    d = spark.createDataFrame(rows, "a double, b double, c double, y int")
    got = {x.feature: x for x in audits.numeric_stats(audits.melted(d, ["a", "b", "c"], ["y"], infinite=True), "y").collect()}
    y = pd.Series([x[3] for x in rows], dtype="float")
    a = pd.Series([x[0] for x in rows], dtype="float").replace([math.inf, -math.inf], math.nan)
    s, p = got["a"], a.dropna()
    assert (s.rows, s.present, s.missing, s.infinite, s.distinct) == (400, len(p), 400 - len(p), sum(x[0] == math.inf for x in rows), p.nunique())
    assert s.variance == pytest.approx(p.var()) and s.skewness == pytest.approx(p.skew()) and s.kurtosis == pytest.approx(p.kurt()) and s.target_corr == pytest.approx(a.corr(y))
    assert (s.zero_count, s.negative_count, s.positive_count) == ((p == 0).sum(), (p < 0).sum(), (p > 0).sum()) and s.zero_rate == pytest.approx((p == 0).sum() / 400)
    low, high = p.quantile(0.25), p.quantile(0.75)
    assert s.iqr_outliers == ((p < low - 1.5 * (high - low)) | (p > high + 1.5 * (high - low))).sum() and s.z_outliers == ((p - p.mean()).abs() > 3 * p.std()).sum()
    assert s.mean_difference == pytest.approx(a[y == 1].mean() - a[y == 0].mean()) and s.median_difference == pytest.approx(a[y == 1].median() - a[y == 0].median())
    b, c = got["b"], got["c"]
    assert (b.skewness, b.kurtosis, b.skew_direction, b.target_corr, b.mean_1, b.z_outliers) == (0, 0, "approximately_symmetric", None, None, 0)
    assert (c.present, c["mean"], c.zero_rate, c.skew_direction, c.iqr_outliers) == (0, None, None, "all_missing", 0)


@pytest.mark.parametrize("values, direction", [([1.0, 2.0], "unknown"), ([1.0, 1.0, 1.0, 1.0, 9.0], "right_skewed"), ([9.0, 9.0, 9.0, 9.0, 1.0], "left_skewed")])
def test_direction_of_skew(spark, values, direction):
    d = spark.createDataFrame([(v,) for v in values], "x double")
    assert audits.numeric_stats(audits.melted(d, ["x"])).first().skew_direction == direction


def test_columns_missing_and_categories(spark):
    d = spark.createDataFrame([(i, f"k{i % 60}" if i % 60 else "z", None if i % 2 else "u", "once" if i == 3 else "often") for i in range(600)], "n int, many string, half string, due_date string")
    got = {r.column_name: r for r in audits.missing_audit(d).collect()}
    assert (got["n"].unique_count, got["n"].rare_categories, got["n"].is_high_cardinality) == (None, None, False)
    assert (got["many"].unique_count, got["many"].is_high_cardinality) == (60, True)
    assert (got["half"].missing, got["half"].missing_percentage, got["half"].is_high_missing, got["half"].unique_count) == (300, 50.0, True, 1)
    assert (got["due_date"].rare_categories, got["due_date"].is_day_column) == (1, True)
    empty = {r.column_name: r for r in audits.missing_audit(d.limit(0)).collect()}
    assert len(empty) == 4 and (empty["half"].rows, empty["half"].missing_percentage, empty["half"].unique_count) == (0, 0.0, 0)
    assert audits.missing_audit(d.select("n")).first().unique_count is None


def test_target_of_keys(spark):
    ok = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0)], "k int, y int")
    r = audits.target_audit(ok, "k", "y").first()
    assert (r.rows, r.target_0, r.target_1, r.target_1_ratio, r.repeated_keys, r.status, r.imbalance) == (6, 5, 1, 0.166667, 0, "target_audit_passed", "class_imbalance_expected_and_significant")
    for more, field in (((1, 1), "keys_with_several_targets"), ((1, None), "target_missing"), ((9, 2), "other_values")):
        b = audits.target_audit(ok.unionByName(spark.createDataFrame([more], "k int, y int")), "k", "y").first()
        assert b.status == "blocked" and b[field] == 1
    again = audits.target_audit(ok.unionAll(ok), "k", "y").first()
    assert again.status == "target_audit_passed" and again.repeated_keys == 6
    none = audits.target_audit(ok.limit(0), "k", "y").first()
    assert (none.rows, none.target_1_ratio, none.repeated_keys) == (0, 0.0, 0)


def test_matrix_of_splits(spark):
    d = spark.createDataFrame([("a", 1, None, float("inf"), "t", 1), ("a", 2, 3, float("nan"), None, 0), ("b", 3, 4, 1.0, "u", None)], "split string, id int, x int, z double, s string, y int")
    got = {r.split: r for r in audits.matrix_audit(d, ["x", "z", "s", "x", "id"], "id", "y", ["split"]).collect()}
    a, b = got["a"], got["b"]
    assert (a.rows, a.features, a.positives, a.negatives, a.positive_rate, a.missing_cells, a.infinite_cells) == (2, 5, 1, 1, 0.5, 4, 1)
    assert (a.object_columns, a.object_sample, a.repeated_columns, a.key_in_features, a.target_in_features) == (1, "s", 1, True, False)
    assert (b.positives, b.negatives, b.missing_cells) == (0, 0, 0)
    assert audits.matrix_audit(d, ["x", "y"], "id", None).first().positives is None


def test_history_onto_entities(spark):
    child = spark.createDataFrame([(1, "A", 10.0, 4.0), (1, "B", -2.0, None), (2, None, None, None), (None, "A", 5.0, 5.0)], "k int, status string, x double, w double")
    m = {"n": F.count("*"), **profiles.status_counts(F.col("status"), {"a": "A"}), **profiles.amounts(F.col("x"), "x", ["total", "mean", "max", "min"]), "large": count_where(F.col("x") > 1)}
    out = profiles.history(spark.range(1, 4).select(F.col("id").cast("int").alias("k")), child, "k", "has", m, {"share": ("a_count", "n"), "by_total": ("n", "x_total"), "tens": ("x_total", 10)}, ["n", "a_count", "x_total", "large"])
    got = {r.k: r for r in out.collect()}
    assert (got[1].n, got[1].a_count, got[1].x_total, got[1].x_mean, got[1].x_max, got[1].x_min, got[1].share, got[1].by_total, got[1].tens, got[1].has) == (2, 1, 8.0, 4.0, 10.0, -2.0, 0.5, 0.25, 0.8, 1)
    assert (got[2].n, got[2].x_total, got[2].x_mean, got[2].share, got[2].by_total, got[2].has) == (1, 0.0, None, 0.0, None, 1)
    assert (got[3].n, got[3].x_total, got[3].x_mean, got[3].share, got[3].has) == (0, 0.0, None, None, 0)


@pytest.mark.parametrize("small", [10**6, 0])
def test_running_counts_whatever_their_way(spark, small):
    r = random.Random(2)
    rows = [(r.choice(["p", "p", "p", "q", None]), r.choice([None, 1, 2, 3]), i, r.choice([True, False, None])) for i in range(500)]
    d = spark.createDataFrame(rows, "g string, v int, i int, ok boolean")
    got = {x.i: x for x in ranking.running_counts(d, ["g"], [F.col("v").desc_nulls_last(), F.col("i")], {"place": F.lit(True), "good": F.col("ok")}, small).collect()}
    assert len(got) == 500
    for g in ("p", "q", None):
        good = 0
        for place, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2])), 1):
            good += x[3] is True
            assert (got[x[2]].place, got[x[2]].good) == (place, good if x[3] else None)
    assert ranking.running_counts(d.limit(0), ["g"], [F.col("i")], {"place": F.lit(True)}, small).count() == 0


def test_options_ranked_by_ranges_as_by_windows(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        e = r.random() < 0.7
        s = e and r.random() < 0.8
        rows.append(("one" if i % 5 else "two", i, e, s, s and r.random() < 0.4, round(r.random(), 1) if s else None))
    d = spark.createDataFrame(rows, "scenario string, option int, eligible boolean, score_available boolean, on_frontier boolean, utility double")
    a, b = (sorted(map(tuple, decisions.ranked(d, "scenario", "option", small=n).collect()), key=str) for n in (10**6, 0))
    assert a == b and len(a) == 300


def test_searches_in_one_pass(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    r = random.Random(8)
    rows = [(i, r.choice([None, day(1), day(2), day(3)]), r.choice(["a", "b", None]), r.random()) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, at timestamp, kind string, v double")
    order = lambda x: (x[1] is None, -(x[1].timestamp() if x[1] else 0), -x[0])

    def page(keep, after=None):
        found = [x for x in sorted(rows, key=order) if keep(x) and (after is None or order(x) > order(after))]
        return [x[0] for x in found[:7]], len(found) > 7

    last = sorted(rows, key=order)[190]  # among the missing dates
    searches = {
        "kind": (({"kind": "a"}, {}, None), page(lambda x: x[2] == "a")),
        "range": (({"kind": None}, {"at": (day(2), day(3)), "v": (0.5, None)}, None), page(lambda x: x[1] == day(2) and x[3] >= 0.5)),
        "next": (({}, {}, (day(2), 100)), page(lambda x: True, (100, day(2)))),
        "tail": (({}, {}, (None, last[0])), page(lambda x: True, last)),
        "nothing": (({"kind": "c"}, {}, None), ([], False)),
    }
    got = ranking.searched(d, {n: s for n, (s, _) in searches.items()}, ["at", "id"], 7).collect()
    for n, (_, (ids, more)) in searches.items():
        mine = sorted((x for x in got if x.search == n), key=lambda x: x.place)
        assert [x.id for x in mine] == ids and all(x.has_more == more for x in mine), n
    assert ranking.searched(d.limit(0), {"all": ({}, {}, None)}, ["at", "id"], 7).count() == 0
