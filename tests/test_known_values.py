"""Values from tables and small cases worked out by hand or by brute force."""

import random
from hashlib import sha256
from math import erfc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallowmere.functions.identity import digest, draw, hash_order
from tallowmere.operators import audits, decisions, evidence, mart, matrix, oplog, quantiles, selection, statistics, summaries


@pytest.mark.parametrize(("f", "a", "b", "p"), [(4.9646, 1, 10, 0.05), (3.8853, 2, 12, 0.05), (2.9223, 3, 30, 0.05), (5.0503, 5, 5, 0.05), (3.3682, 10, 20, 0.01), (0.0, 3, 4, 1.0)])
def test_tail_of_f(spark, f, a, b, p):
    assert statistics.f_survival(f, a, b) == pytest.approx(p, abs=2e-5)
    got = spark.createDataFrame([(f, float(a), float(b)), (None, 1.0, 1.0)], "f double, a double, b double").select(statistics.f_pvalue("f", "a", "b").alias("p")).collect()
    assert got[0].p == pytest.approx(p, abs=2e-5) and got[1].p is None


def test_incomplete_beta_by_its_closed_forms():
    for x in (0.05, 0.3, 0.5, 0.77, 0.99):
        assert statistics.incomplete_beta(1, 1, x) == pytest.approx(x, abs=1e-12)
        assert statistics.incomplete_beta(3, 1, x) == pytest.approx(x**3, abs=1e-12)
        assert statistics.incomplete_beta(1, 4, x) == pytest.approx(1 - (1 - x) ** 4, abs=1e-12)
        assert statistics.incomplete_beta(2, 2, x) == pytest.approx(3 * x**2 - 2 * x**3, abs=1e-12)


@pytest.mark.parametrize(("d", "w", "p"), [
    ([1, 2, 3, 4, 5], 0, 2 / 32), ([-1, -2, 3, 4, 5, 6, 7, 8], 3, 10 / 256), ([-8, 1, 2, 3, 4, 5, 6, 7, 9, 10], 8, 50 / 1024), ([1], 0, 1.0), ([0, 0], 0, 1.0),
])
def test_signed_rank_by_counting(d, w, p):
    got = statistics.signed_rank_p(d)
    assert got == (pytest.approx(w), pytest.approx(p))


def test_signed_rank_approximation_with_ties():
    d = [1] * 10 + [-1] * 4 + [2] * 12
    n = len(d)
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - (14**3 - 14 + 12**3 - 12) / 48
    w, p = statistics.signed_rank_p(d)
    assert w == 4 * 7.5
    assert p == pytest.approx(erfc((mean - w) / var**0.5 / 2**0.5))


def cells(spark, rows):
    return spark.createDataFrame([(s, c, float(y)) for s, ys in enumerate(rows) for c, y in enumerate(ys)], "s int, c int, y double")


@pytest.mark.parametrize(("rows", "epsilon"), [
    ([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)], 1.0),
    ([(1, 2, 3), (2, 4, 6), (3, 6, 9), (4, 8, 12)], 0.5),
    ([(1, 5), (2, 3), (4, 4)], 1.0),
])
def test_sphericity(spark, rows, epsilon):
    assert statistics.sphericity_epsilon(cells(spark, rows), "s", "c", "y").first().epsilon == pytest.approx(epsilon)


def test_an_effect_without_error_is_the_largest(spark):
    rows = [(s, a, b, float(10 * a)) for s in range(3) for a in range(2) for b in range(2)]
    got = {r.source: r for r in statistics.rm_anova(spark.createDataFrame(rows, "s int, a int, b int, y double"), "s", "a", "b", "y").collect()}
    assert got["a"].f == statistics.LARGEST and got["a"].partial_eta_squared == 1
    assert got["b"].f == 0 and got["b"].partial_eta_squared == 0
    assert statistics.f_survival(statistics.LARGEST, 1, 2) == pytest.approx(0, abs=1e-12)


def test_missing_parts_and_separators_make_other_identities(spark):
    rows = [(None, "x"), ("x", None), ("", "x"), ("x", ""), ("a|b", "c"), ("a", "b|c"), ("\\0", "x"), ("a\\", "|b"), ("a", "|b"), ("a:b", "c"), ("a", "b:c")]
    d = spark.createDataFrame(rows, "a string, b string")
    for f in (lambda a, b: digest(a, b), lambda a, b: hash_order("s", a, b), lambda a, b: draw("s", F.lit(1 << 40), a, b)):
        assert d.select(f(F.col("a"), F.col("b")).alias("h")).distinct().count() == len(rows)
    assert spark.range(1).select(digest(F.lit(7), F.lit("web")).alias("h")).first().h == sha256(b"7|web").hexdigest()


def test_rows_with_different_gaps_are_no_duplicates(spark):
    d = spark.createDataFrame([(None, "x"), ("x", None), (None, "x"), (None, None), (None, None), (None, None)], "a string, b string")
    assert audits.duplicate_rows(d).first().duplicate_rows == 3


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_of_any_size(spark, small, by):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "hot", rng.choice([None, float(rng.randint(0, 40)), rng.gauss(0, 5)])) for i in range(900)] + [("none", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    groups = {g: [v for h, v in rows if v is not None and (not by or h == g)] for g in ({g for g, _ in rows} if by else {None})}
    groups = {g: v for g, v in groups.items() if v}
    for discrete in (False, True):
        got = {r.g if by else None: r for r in quantiles.quantiles(d, by, "v", shares, discrete, small).collect()}
        assert got.keys() == groups.keys()
        for g, v in groups.items():
            want = np.quantile(v, shares, method="inverted_cdf" if discrete else "linear")
            assert got[g].q == pytest.approx(want.tolist(), abs=1e-9) and got[g].present == len(v) and got[g].distinct == len(set(v))


def test_no_percentile_holds_a_column_in_one_buffer(spark):
    d = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    for df in (summaries.macro_micro(d.withColumn("w", F.lit(2.0)), ["g"], "v", "w"), summaries.latency_summary(d, ["g"], "v"), summaries.grouping_sets(d, {"all": [], "g": ["g"]}, summaries.numeric_summary("v"), "v"), audits.psi(d, "v", F.col("g") == 0)):
        assert "percentile" not in df._jdf.queryExecution().executedPlan().toString().lower()


def test_lineage_meets_shared_ancestors_once(spark):
    """25 diamonds in a row: more paths than can be walked."""
    edges = [(f"n{i}", f"{s}{i}") for i in range(25) for s in "lr"] + [(f"{s}{i}", f"n{i + 1}") for i in range(25) for s in "lr"]
    d = spark.createDataFrame(edges, "p string, c string")
    got = {r.node: r.distance for r in oplog.closure(d, ["n0"], "p", "c", None).collect()}
    assert len(got) == 76 and got["n25"] == 50
    assert oplog.closes_cycle(d, "p", "c", "n25", "n0") and not oplog.closes_cycle(d, "p", "c", "n0", "n25")


def test_lineage_page_is_bounded_in_both_directions(spark):
    from collections import deque

    edges = [(f"n{i}", f"n{j}") for i in range(40) for j in (2 * i + 1, 2 * i + 2, i + 7)]
    d = spark.createDataFrame(edges, "p string, c string")
    for direction, most in (("both", 15), ("descendants", 200), ("ancestors", 4), ("both", 1)):
        near = {"descendants": lambda x: {b for a, b in edges if a == x}, "ancestors": lambda x: {a for a, b in edges if b == x}, "both": lambda x: {b for a, b in edges if a == x} | {a for a, b in edges if b == x}}[direction]
        seen, queue, cut = ["n5"], deque([("n5", 0)]), False
        while queue:
            x, level = queue.popleft()
            for y in sorted(near(x)) if level < 3 else ():
                if y not in seen:
                    if len(seen) >= most:
                        cut = True
                        queue.clear()
                        break
                    seen.append(y)
                    queue.append((y, level + 1))
        nodes, inside, truncated = oplog.lineage(d, "n5", "p", "c", direction, 3, most)
        assert [r.node for r in nodes.orderBy("place").collect()] == seen and truncated == cut
        assert sorted(map(tuple, inside.collect())) == sorted((a, b) for a, b in edges if a in seen and b in seen)


def test_levels_of_a_long_chain_and_of_a_cycle(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(30)], "n string")
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(29)] + [("unknown", "n3"), ("n0", "n9")], "p string, c string")
    assert {r.n: r.level for r in oplog.levels(nodes, chain, "n", "p", "c").collect()} == {f"n{i}": i for i in range(30)}
    with pytest.raises(ValueError, match="cycle"):
        oplog.levels(nodes, spark.createDataFrame([("n1", "n2"), ("n2", "n1")], "p string, c string"), "n", "p", "c")


def test_policies_fail_closed(spark):
    number = matrix.Policy("numeric", ("9999",), least=0, above=-1, most=10)
    for raw, p, bad in [("5", number, False), (" 9999 ", number, False), (None, number, False), ("11", number, True), ("-1", number, True), ("x", number, True), ("", number, True), ("y", matrix.Policy("binary", mapping={"Y": 1}), True), ("b", matrix.Policy("categorical", allowed=("a",)), True), ("A12", matrix.Policy("categorical_regex", pattern="A[0-9]+"), False), ("A12x", matrix.Policy("categorical_regex", pattern="A[0-9]+"), True)]:
        d = spark.createDataFrame([(raw,)], "v string").select(matrix.normalised(F.col("v"), "v", p).alias("v"))
        if bad:
            with pytest.raises(Exception, match="v: "):
                d.collect()
        else:
            d.collect()


def test_matrices_and_stars_are_guarded(spark):
    spine = spark.createDataFrame([(1,), (2,)], "k int")
    a, twice = spark.createDataFrame([(1, float("inf"))], "k int, x double"), spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, y double")
    assert [tuple(r) for r in matrix.feature_matrix(spine, "k", {"a": a}).orderBy("k").collect()] == [(1, None), (2, None)]
    with pytest.raises(ValueError, match="earlier group"):
        matrix.feature_matrix(spine, "k", {"a": a, "b": a})
    for bad in (matrix.feature_matrix(spine, "k", {"b": twice}), mart.enriched(spine, [("b", twice, "k")]), matrix.aligned(spine, a, ["k"])):
        with pytest.raises(Exception, match="not unique|different rows"):
            bad.collect()
    assert [(r.k, r.a_found) for r in mart.enriched(spine, [("a", a, "k")]).orderBy("k").collect()] == [(1, True), (2, False)]


def test_structs_are_flattened(spark):
    d = spark.createDataFrame([(1, ("a", 2), (None, 3))], "id int, expected struct<f:string,n:int>, observed struct<f:string,n:int>")
    r = mart.flattened(d).first()
    assert r.asDict() == {"id": 1, "expected_f": "a", "expected_n": 2, "observed_f": None, "observed_n": 3}


def test_subset_covers_first(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", rng.choice("ab"), rng.choice(["x", "y", "z", None]), rng.random()) for i in range(300)] + [("only", "c", "w", 0.5)]
    d = spark.createDataFrame(rows, "k string, p string, q string, v double")
    limit, edges = 14, [lambda r: r[3] > 0.99, lambda r: r[1] == "a" and r[3] < 0.05]
    stable, taken = sorted(rows, key=lambda r: (sha256(f"subset\n{r[0]}".encode()).hexdigest(), r[0])), []

    def take(test):
        if len(taken) < limit and (found := next((r for r in stable if test(r) and r not in taken), None)):
            taken.append(found)

    for i in (1, 2):
        for v in sorted({r[i] or "" for r in rows}):
            take(lambda r, i=i, v=v: (r[i] or "") == v)
    for e in edges:
        take(e)
    strata = {}
    for r in stable:
        strata.setdefault(f"{r[1]}|{r[2] or ''}", []).append(r)
    for depth in range(300):
        for s in sorted(strata):
            if depth < len(strata[s]) and strata[s][depth] not in taken and len(taken) < limit:
                taken.append(strata[s][depth])
    got = selection.coverage_first(d, "k", ["p", "q"], limit, [F.col("v") > 0.99, (F.col("p") == "a") & (F.col("v") < 0.05)])
    assert [r.k for r in got.orderBy("place").collect()] == [r[0] for r in taken]


def test_nothing_is_selected_where_no_candidate_passes(spark):
    d = spark.createDataFrame([("a", 0.2, 1, None, False), ("b", 0.1, 2, None, False)], "k string, x double, level int, non_inferior boolean, on_frontier boolean")
    d = selection.gated(d, [("X", F.col("x"), "min", 0.5), ("NONE", F.lit(None).cast("double"), "max", 1.0)])
    assert {r.failed_gates for r in d.collect()} == {"X|NONE"}
    r = selection.decision(d, "k", "level", [F.desc("x")], [F.asc("x")], []).first()
    assert (r.status, r.selected, r.reference, r.lowest_risk, r.passing) == ("NO_CANDIDATE_PASSED_HARD_GATES", None, None, "b", 0)


def test_only_eligible_and_complete_options_are_scored(spark):
    """Worked by hand: the ineligible option has the extremes, and they change no score."""
    long = decisions.long_criteria(spark.createDataFrame([("a", 10.0, 1.0), ("b", 20.0, 3.0), ("c", 15.0, None), ("d", 1000.0, -5.0), ("e", 10.0, 1.0)], "option_id string, q double, cost double"), ["q", "cost"])
    rules = spark.createDataFrame([("s", "q", None, 100.0, 1)], "scenario_id string, criterion_id string, minimum_value double, maximum_value double, criterion_order int")
    weights = spark.createDataFrame([("s", "q", "max", 0.75), ("s", "cost", "min", 0.25)], "scenario_id string, criterion_id string, direction string, weight double")
    state = decisions.constraints(long, rules)
    u = {r.option_id: r for r in decisions.utility(long, weights, state).collect()}
    assert {k: r.utility for k, r in u.items()} == {"a": 0.25, "b": 0.75, "c": None, "d": None, "e": 0.25}
    assert {k for k, r in u.items() if not r.eligible} == {"d"} and {k for k, r in u.items() if r.score_available} == {"a", "b", "e"}
    f = {r.option_id: (r.dominated_by, r.dominates, r.on_frontier) for r in decisions.frontier(long, weights, state).collect()}
    assert f == {"a": (0, 0, True), "b": (0, 0, True), "c": (0, 0, False), "d": (0, 0, False), "e": (0, 0, True)}


def test_levels_differ_in_what_they_carry(spark):
    rows = [("p", f"f{i}", v, c) for i, (v, c) in enumerate([(5.0, "x"), (-4.0, "x"), (3.0, "y"), (2.0, None), (1.0, "z"), (0.5, "z")])]
    d = evidence.ranked_local(spark.createDataFrame(rows, "k string, feature_id string, shap_value double, concept string"), "k")
    got = {r.evidence_level: r for r in evidence.packages(d, "k").collect()}
    assert set(got) == {"S0", "S1", "S2", "S3", "S4", "S5"}
    assert (got["S0"].selected, got["S0"].features, got["S0"].coverage) == (0, "", 0.0)
    assert got["S3"].features == "f0|f1|f2" and got["S3"].target_met and got["S3"].entropy is None and got["S3"].concept_groups is None
    assert (got["S4"].selected, got["S4"].concept_groups, got["S4"].mixed_concepts, got["S4"].skeleton) == (5, 5, 1, None)
    assert got["S5"].skeleton == "f0|f1|f2|f3|f4" and got["S4"].entropy == got["S5"].entropy > 0.5
