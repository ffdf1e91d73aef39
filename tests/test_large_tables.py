"""What only larger tables show: keys with more digits, what is shuffled, and how."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallowmere import catalog
from tallowmere.operators import claims, decisions, preparation, resampling, suites
from tallowmere.plans import finalization, inference

from test_queries import cell


@pytest.fixture
def long_keys(tmp_path):
    """Orders whose parts have keys of seven digits, some alike in the first six."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE lineitem AS SELECT 1 + i // 6 AS l_orderkey, (1000000 + i * 7 % 20)::BIGINT AS l_partkey, (i % 9)::BIGINT AS l_suppkey, (1 + i % 6)::INT AS l_linenumber, (1 + i % 50)::DOUBLE AS l_quantity,
        (1000 + i * 37 % 500)::DOUBLE AS l_extendedprice, 0.05::DOUBLE AS l_discount, 0.01::DOUBLE AS l_tax, ['A', 'N', 'R'][i % 3 + 1] AS l_returnflag, ['F', 'O'][i % 2 + 1] AS l_linestatus FROM range(60) r(i)""")
    con.execute("CREATE TABLE part AS SELECT (1000000 + i)::BIGINT AS p_partkey, 'Brand#' || i % 5 AS p_brand FROM range(20) r(i)")
    for n in ("lineitem", "part"):
        con.execute(f"COPY {n} TO '{tmp_path}/{n}.parquet'")
    return con, str(tmp_path)


@pytest.mark.parametrize("name", ["adaptive_coverage", "concept_summary", "evidence_nesting", "normalized_entropy", "topk_coverage", "evidence_packages", "concept_grouping", "contribution_tiers"])
def test_parts_with_one_name_are_one_feature(spark, long_keys, name):
    con, at = long_keys
    df = catalog.QUERIES[name](spark, at)
    names = sorted(df.columns)
    r = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    key = lambda x: tuple(map(str, x))
    got = sorted((tuple(map(cell, x)) for x in df.select(*names).collect()), key=key)
    assert got == sorted((tuple(map(cell, x)) for x in r), key=key)


@pytest.mark.parametrize(("name", "most"), [("claim_validation", 4), ("claim_type_counts", 4), ("claim_group_summary", 5), ("claim_type_profile", 7), ("validator_sensitivity", 6)])
def test_claims_and_evidence_are_dealt_once(spark, small, name, most):
    """Lines as items, lines as claims, packages and what they allow: one deal each, and what few rows of results need."""
    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= most


def test_mutants_are_never_dealt(spark, small):
    """Lines are dealt by order as they are; claims, and mutants of the supported ones, are made where these have met their package, and only counts leave."""
    plan = catalog.QUERIES["validator_sensitivity"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Join LeftOuter, (package_id")
    assert plan.index("AS package_id") < plan.index("RepartitionByExpression") and "collect_list" not in plan[: plan.index("Join LeftOuter, (package_id")]
    lines = next(x for x in plan[plan.index("RepartitionByExpression") :].split("\n")[1:] if "Project" in x)
    assert "AS" not in lines and "l_quantity" in lines


def test_what_a_package_shows_is_collected_once(spark):
    """Its concepts are made within its row: items, dealt before, are neither grouped again nor sorted for ranks; texts of claims are searched where a rule asks."""
    items = spark.createDataFrame([("p", "a", "k", "increases_risk", 2.0, 1, "weak"), ("p", "b", "k", "decrease_risk", 3.0, 2, "strong"), ("p", "c", None, "neutral", 9.0, 3, None), ("p", "d", "m", None, None, 4, "weak"), ("q", "a", "n", "neutral", 1.0, 1, "weak")], "package_id string, feature_id string, concept_id string, direction string, abs_shap_value double, rank int, strength string")
    got = claims.shown(items)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Window" not in plan
    rows = {r.package_id: r for r in got.collect()}
    assert (rows["p"].p_features, rows["p"].p_n_concepts, rows["p"].p_mixed, rows["q"].p_mixed) == (4, 2, True, False)
    assert sorted(map(tuple, rows["p"].p_concepts)) == [("k", "mixed", 5.0, 2, "strong"), ("m", "unknown", None, 1, "weak")]
    view = claims.concept_view(items).collect()
    seen = {(r.package_id, r.concept_id, r.c_direction, r.c_mass, r.c_features, r.c_strength) for r in view}
    assert seen == {(k, *c) for k, r in rows.items() for c in map(tuple, r.p_concepts)}


def test_scores_read_the_split_that_the_model_was_fitted_on(spark, small):
    """The hashes that split the lines are made once, not again for each reader."""
    assert "md5(" not in catalog.QUERIES["model_scores"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_final_claims_are_dealt_once(spark, small):
    """Claims and the sections that state counts, by generation; numbers, facts, models, duplicates and places need no deal of their own."""
    plan = catalog.QUERIES["claims_finalized"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 2


def test_what_final_claims_are_made_of_is_made_once(spark, small):
    """Lines are dealt as they are; no list is made a second time to see whether it is empty, and no digest only to order rows."""
    plan = catalog.QUERIES["claims_finalized"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan.split("RepartitionByExpression")[1:]
    assert len(dealt) == 2 and not any(" AS source_text" in d.split("Relation")[0] for d in dealt)
    assert plan.count("sha2(") == 1 and not any("Filter" in x and "lambda" in x for x in plan.split("\n"))


def test_tasks_of_final_claims_have_few_lines(spark, small, monkeypatch):
    """Tasks follow from the number of lines: by the bytes dealt they would sort more than fits their memory."""
    monkeypatch.setattr(finalization, "_LINES", 100)
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    plan = catalog.QUERIES["claims_finalized"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {-(-lines // 100)}), REPARTITION_BY_NUM") == 2


def test_rows_with_a_weight_are_not_dealt_by_their_class(spark):
    """Two classes would be two tasks; the weights go to the rows instead, even where Spark broadcasts nothing by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.range(1000).selectExpr("id", "cast(id % 10 = 0 as int) as label")
        got = preparation.with_balanced_weight(d, "label")
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r.label, round(r.weight, 9), r["count"]) for r in got.groupBy("label", "weight").count().collect()} == {(0, round(1000 / 1800, 9), 900), (1, 5.0, 100)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ranks_read_the_lines_once(spark, small, monkeypatch):
    """Utility and frontier share the options: these are made from the lines, which are the whole input, once."""
    made, own = [], inference._options
    monkeypatch.setattr(inference, "_options", lambda *a: made.append(a) or own(*a))
    plan = catalog.QUERIES["scenario_rank"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 1 and "l_suppkey" not in plan


def test_a_point_meets_few_of_the_edges(spark, monkeypatch):
    """Edges grow in number with the points, so a point must neither go through all of its group's nor make them anew."""
    seen, own = [], decisions.staged
    monkeypatch.setattr(decisions, "staged", lambda d: seen.append(d._jdf.queryExecution().optimizedPlan().toString()) or own(d))
    d = spark.range(600).selectExpr("id", "1 AS g", "id * 7919 % 601 / 1.0D AS x", "id * 104729 % 601 / 1.0D AS y")
    assert decisions.pareto(d, "g", "id", ["x", "y"], block=16).agg(F.sum("dominates") - F.sum("dominated_by")).first()[0] == 0
    placed = [p for p in seen if "AS __p__v0" in p]
    assert len(placed) == 2 and not any("array_distinct(" in p or "filter(__" in p for p in placed)


@pytest.mark.parametrize(("name", "column"), [("sensitivity_suites", "l_returnflag"), ("sensitivity_conclusions", "l_returnflag")])
def test_claims_are_added_up_once_for_all_scenarios(spark, small, name, column):
    """Ranks, the primary scenario and the best options come from stored sums; the claims aren't read again for each."""
    assert column not in catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_a_unit_is_one_row_whatever_the_scenarios(spark, monkeypatch):
    """What is added up by unit has a row for each unit, not for each unit and scenario."""
    seen, own = [], suites.staged
    monkeypatch.setattr(suites, "staged", lambda d: seen.append(d._jdf.queryExecution().optimizedPlan().toString()) or own(d))
    d = spark.createDataFrame([(1, "a", "t1", 1), (1, "a", "t2", 0), (2, "a", "t2", None)], "u int, o string, k string, ok int")
    many = [suites.Scenario("P", f"s{i}", "ALL", "share", ("t2",) * (i % 2)) for i in range(6)]
    got = suites.evaluated(d, "u", "o", "k", {"ALL": F.lit(True)}, {"ok": F.col("ok"), "n": F.lit(1)}, {"share": F.col("ok") / F.col("n")}, many).collect()
    assert {(r.scenario, r.units, r.claims, r.value) for r in got} == {(f"s{i}", 1, 1, 1.0) if i % 2 else (f"s{i}", 1, 3, 0.5) for i in range(6)}
    assert seen[0].count("Generate") == 1 and seen[0].index("Generate") < seen[0].rindex("Aggregate")


def test_a_case_is_drawn_once_for_all_of_its_groups(spark):
    """The hash of a draw is made once by case and iteration, not for each group and number of draws."""
    d = spark.createDataFrame([(i, "s", g, 1.0) for i in range(5) for g in "abc"], "c long, s string, g string, v double")
    got = resampling.resampled_means(d, ["g"], "s", "c", "v", 10, "x")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.index("md5(") < plan.index("collect_list")
    assert got.count() == 30
