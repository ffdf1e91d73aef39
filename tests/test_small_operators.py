"""Operators that no query reaches, each with a case by hand."""

import pytest
from pyspark.sql import functions as F

from tallowmere import catalog
from tallowmere.operators import checks, claims, evidence, generations, metrics, preparation, summaries
from tallowmere.sources import readers


def test_causal_claims_without_causal_words_are_demoted(spark):
    d = spark.createDataFrame([(1, "causal", "it causes", "f", None), (2, "causal", "it goes with", "f", None), (3, "causal", None, None, "c"), (4, "causal", "x", None, None), (5, "numeric", "x", "f", None)], "id int, claim_type string, source_text string, feature_id string, concept_id string")
    assert {r.id: r.claim_type for r in claims.demoted_causal(d, "(?i)causes?").collect()} == {1: "causal", 2: "feature_direction", 3: "concept_direction", 4: "causal", 5: "numeric"}


def test_presence_is_added_once_for_each_subject(spark):
    schema = "generation_id int, claim_id string, claim_type string, claim_subtype string, feature_id string, concept_id string, direction string, magnitude string"
    rows = [(1, "a", "feature_direction", "x", "f", None, "up", None), (1, "b", "magnitude", "x", "f", None, None, "weak"), (1, "c", "concept_direction", "x", None, "k", "up", None), (1, "d", "concept_presence", "x", None, "k", None, None), (2, "e", "numeric", "x", "f", None, None, None)]
    out = claims.with_presence(spark.createDataFrame(rows, schema)).collect()
    made = [r for r in out if r.claim_subtype == "DERIVED_PRESENCE"]
    assert len(out) == 6 and [(r.claim_type, r.feature_id, r.direction, r.magnitude) for r in made] == [("feature_presence", "f", None, None)]


def test_pairs_that_are_allowed(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x")], "claim_type string, claim_subtype string")
    assert sorted((r.claim_type or "", r.claim_subtype, r.compatible) for r in claims.compatibility(d, [("a", "x")]).collect()) == [("", "x", False), ("a", "x", True), ("a", "y", False)]


def test_rows_whose_columns_differ(spark):
    d = spark.createDataFrame([(1, 1, None, None), (2, 1, "a", "a"), (3, 3, None, "b")], "a int, b int, c string, d string")
    assert sorted(r.a for r in checks.mismatches(d, [("a", "b"), ("c", "d")]).collect()) == [2, 3]


def test_forbidden_names_in_nested_schemas(spark):
    d = spark.createDataFrame([], "a int, s struct<Token:string,l:array<struct<secret:int>>>, m map<string,struct<token:int>>")
    assert sorted(checks.forbidden_fields(d, ["token", "secret"])) == ["m.token", "s.Token", "s.l.secret"]


def test_summary_of_claims(spark):
    rows = [("g", s) for s in ["SUPPORTED"] * 3 + ["UNSUPPORTED", "CONTRADICTED", "NOT_VERIFIABLE", "NOT_APPLICABLE", None]] + [("h", "NOT_VERIFIABLE")]
    out = {r.g: r for r in spark.createDataFrame(rows, "g string, status string").groupBy("g").agg(*[c.alias(n) for n, c in summaries.claim_summary().items()]).collect()}
    assert (out["g"].claims, out["g"].faithfulness, out["g"].verifiability, out["g"].conservative) == (8, 0.6, pytest.approx(5 / 6), 0.5)
    assert (out["h"].faithfulness, out["h"].verifiability, out["h"].conservative) == (None, 0.0, 0.0)


def test_local_rows_and_balanced_cases(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c"], [0.5, -2.0, 0.0])], "k int, features array<string>, values array<double>")
    got = {r.feature_id: (r.abs_shap_value, r["rank"]) for r in evidence.local_rows(d, "k").collect()}
    assert got == {"b": (2.0, 1), "a": (0.5, 2), "c": (0.0, 3)}
    cases = spark.createDataFrame([(f"c{i:02d}", "s" if i < 9 else "t", float(i)) for i in range(12)], "k string, stratum string, d double")
    assert {r.stratum: r["count"] for r in evidence.balanced_subset(cases, "stratum", "d", "k", 1).groupBy("stratum").count().collect()} == {"s": 3, "t": 3}


def test_metrics_are_described(spark):
    d = metrics.dictionary(spark)
    assert d.count() == d.select("metric").distinct().count() >= 5


def test_names_that_speak_of_the_target():
    assert preparation.suspicious_columns(["id", "TARGET", "my_label", "Secret", "outcome_date"], ["secret", "target"]) == [("TARGET", "forbidden"), ("Secret", "forbidden"), ("my_label", "suspicious"), ("outcome_date", "suspicious")]


@pytest.mark.parametrize(("text", "rate"), [("One. Two! one? ", 1 / 3), ("Same. same. SAME", 2 / 3), ("", 0.0), (None, 0.0), ("Only one", 0.0)])
def test_sentences_that_repeat(spark, text, rate):
    got = spark.createDataFrame([(text,)], "t string").select(F.coalesce(generations.duplicate_sentence_rate(F.col("t")), F.lit(0.0)).alias("r")).first().r
    assert got == pytest.approx(rate)


def test_every_issue_occurs(spark, small):
    rows = catalog.QUERIES["contract_issues"](spark, small).select(F.explode(F.split("issues", r"\|")).alias("i")).distinct().collect()
    assert {r.i for r in rows} - {""} == {"MISSING_SUMMARY", "MISSING_NOTE", "DUPLICATE_FACTOR", "FACTOR_NOT_ALLOWED", "FACTOR_COUNT", "FACTOR_ORDER", "LANGUAGE"}


def test_a_table_of_an_sql_store_is_read_in_ranges(spark):
    url, driver = "jdbc:derby:memory:tallowmere;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("id", "id * 2 AS v").write.jdbc(url, "numbers", mode="overwrite", properties={"driver": driver})
    d = readers.jdbc(spark, url, "numbers", "id", 0, 100, 4, driver=driver)
    assert d.rdd.getNumPartitions() == 4 and d.agg(F.sum("v")).first()[0] == 9900


def test_settings_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("a: [1, 2]\nb:\n  c: x\n")
    assert readers.yaml_document(f"{tmp_path}/a.yaml") == {"a": [1, 2], "b": {"c": "x"}}
