"""Resampling within strata, suites and the knee, against values by hand."""

import hashlib
from collections import defaultdict
from math import exp, factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallowmere import catalog
from tallowmere.operators import resampling, suites


def drawn(seed, i, case):
    h = int(hashlib.md5(f"{seed}:{i}:{case}".encode()).hexdigest()[:7], 16)
    return next((k for k, s in enumerate(resampling._STEPS) if h < s), len(resampling._STEPS))


def test_draws_are_poisson(spark):
    n = 20_000
    got = {r.w: r["count"] for r in spark.range(n).select(resampling.draws("s", F.lit(3), F.col("id")).alias("w")).groupBy("w").count().collect()}
    for k in range(5):
        p = exp(-1) / factorial(k)
        assert abs(got.get(k, 0) - n * p) < 5 * (n * p * (1 - p)) ** 0.5
    assert got[0] == sum(drawn("s", 3, i) == 0 for i in range(n))


def test_means_of_resamples_keep_strata(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[i % 3] if i else "alone", g, float(rng.normal(i % 3 * 10, 1))) for i in range(40) for g in ("x", "y")] + [(99, "a", "x", None), (None, "a", "x", 5.0)]
    d = spark.createDataFrame(rows, "case long, stratum string, g string, v double")
    got = {(r.g, r.iteration): r["mean"] for r in resampling.resampled_means(d, ["g"], "stratum", "case", "v", 30, "boot").collect()}
    for g in ("x", "y"):
        for i in range(30):
            by = defaultdict(list)
            for case, stratum, h, v in rows:
                if h == g and case is not None and v is not None:
                    by[stratum].append((drawn("boot", i, case), v))
            means = [(len(x), sum(w * v for w, v in x) / sum(w for w, _ in x) if sum(w for w, _ in x) else sum(v for _, v in x) / len(x)) for x in by.values()]
            assert got[g, i] == pytest.approx(sum(n * m for n, m in means) / sum(n for n, _ in means))


def test_no_window_without_a_partition(spark, small):
    for name in ("stratified_noninferiority", "differences_across_studies"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bounds_cover_the_difference(spark):
    rows = [(i, "s", "c", float(i % 2)) for i in range(400)]
    r = resampling.noninferiority(spark.createDataFrame(rows, "case long, s string, c string, d double"), "c", "s", "case", "d", 0.6, 400, "b").first()
    assert (r.cases, r.mean_difference, r.non_inferior) == (400, 0.5, True)
    assert 0.44 < r.low < 0.475 and 0.525 < r.high < 0.56  # 0.5 -+ 1.645 * 0.5 / 20


def test_scenarios_leave_out_what_they_name(spark):
    claims = [(1, "a", "t1", 1), (1, "a", "t2", 0), (2, "a", "t2", 1), (3, "b", "t1", 1), (3, "b", "t1", 1), (4, "b", "t2", 0)]
    d = spark.createDataFrame(claims, "u int, o string, k string, ok int")
    scenarios = [suites.Scenario("P", "all", "ALL", "share"), suites.Scenario("T", "no t2", "ALL", "share", ("t2",)), suites.Scenario("T", "no t9", "ALL", "share", ("t9",)), suites.Scenario("N", "first", "FIRST", "share", margin=0.5)]
    v = suites.evaluated(d, "u", "o", "k", {"ALL": F.lit(True), "FIRST": F.col("u") < 4}, {"ok": F.col("ok"), "n": F.lit(1)}, {"share": F.col("ok") / F.col("n")}, scenarios)
    got = {(r.scenario, r.option): (r.units, r.claims, r.value, r["rank"], r.delta, r.rank_shift, r.within_margin, r.best_stable) for r in suites.compared(v).collect()}
    assert got == {
        ("all", "a"): (2, 3, 0.75, 1, 0.0, 0, True, True), ("all", "b"): (2, 3, 0.5, 2, 0.0, 0, False, True), ("no t2", "a"): (1, 1, 1.0, 1, 0.25, 0, True, True), ("no t2", "b"): (1, 2, 1.0, 1, 0.5, -1, True, True),
        ("first", "a"): (2, 3, 0.75, 2, 0.0, 1, True, False), ("first", "b"): (1, 2, 1.0, 1, 0.5, -1, True, False),
    }
    c = {r.scenario: (r.options, r.largest_shift, r.best_stable, r.order_stable, r.best_option) for r in suites.conclusions(suites.compared(v)).collect()}
    assert c == {"all": (2, 0, True, True, "a"), "no t2": (2, 1, True, False, "a"), "first": (2, 1, False, False, "b")}


def test_secondary_tests_run_only_behind_their_omnibus(spark):
    tests = spark.createDataFrame([("f", "x", 0.01), ("f", "y", 0.3), ("g", "x", 0.01), ("h", "x", 0.01), ("i", "x", 0.02)], "family string, id string, p double")
    omnibus = spark.createDataFrame([("f", 0.04), ("g", 0.05), ("i", None)], "family string, p double")
    assert {(r.family, r.id): (r.p, r.status) for r in suites.conditional(tests, omnibus, "family").collect()} == {("f", "x"): (0.01, "RUN"), ("f", "y"): (0.3, "RUN"), ("g", "x"): (None, "NOT_RUN"), ("h", "x"): (None, "MISSING"), ("i", "x"): (None, "MISSING")}


def test_the_knee_and_where_there_is_none(spark):
    rows = [("k", "S1", 0, 0), ("k", "S2", 10, 8), ("k", "S3", 50, 9), ("k", "S4", 100, 10), ("tie", "S2", 5, 1), ("tie", "S1", 0, 0), ("tie", "S3", 10, 2), ("same cost", "S1", 1, 1), ("same cost", "S2", 1, 2), ("flat", "S1", 1, 3), ("flat", "S2", 2, 3), ("gap", "S1", 1, None), ("gap", "S2", 2, 3), ("one", "S1", 1, 1)]
    got = {r.g: (r.points, r.item, r.distance) for r in suites.knee(spark.createDataFrame(rows, "g string, item string, x int, y int"), "g", "item", "x", "y").collect()}
    assert got == {"k": (4, "S2", pytest.approx(0.7)), "tie": (3, "S1", 0.0), "same cost": (2, None, None), "flat": (2, None, None), "gap": (2, None, None), "one": (1, None, None)}


def test_a_validator_that_misses_a_mutation_shows_it(spark):
    from tallowmere.operators import mutations

    rows = [(1, "up", 5.0), (2, "up", 6.0), (3, "down", 7.0), (4, "up", None)]
    d = spark.createDataFrame(rows, "claim_id int, direction string, v double")
    right = F.create_map(*[F.lit(x) for k, x in ((1, "up"), (2, "up"), (3, "up"), (4, "up")) for x in (str(k), x)])
    check = lambda c: c.withColumn("validation_status", F.when(F.col("direction") == right[F.col("__of")], "SUPPORTED").otherwise("CONTRADICTED"))
    own = (
        mutations.Mutation("flip", "true", {"direction": "CASE direction WHEN 'up' THEN 'down' ELSE 'up' END"}), mutations.Mutation("more", "v IS NOT NULL", {"v": "v + 1"}),
        mutations.Mutation("never", "v > 99", {"v": "0"}), mutations.Mutation("same", "direction = 'up'", {}, caught=("SUPPORTED",)),
    )
    assert mutations.mutated(d, own).select("claim_id").distinct().count() == 4 + 4 + 3 + 3
    got = {r.mutation: (r.mutants, r.caught, r.changed, r.rate) for r in mutations.sensitivity(d, own, check).collect()}
    assert got == {"flip": (3, 3, 3, 1.0), "more": (2, 0, 0, 0.0), "never": (0, 0, 0, None), "same": (3, 3, 0, 1.0)}


def test_the_validator_catches_every_mutation(spark, small):
    got = {r.mutation: r for r in catalog.QUERIES["validator_sensitivity"](spark, small).collect()}
    assert len(got) == 6 and all(r.mutants > 0 and r.rate == 1.0 for r in got.values())
    assert got["ID_ONLY"].changed == 0 and got["NUMBER_MOVED"].changed == got["NUMBER_MOVED"].mutants
