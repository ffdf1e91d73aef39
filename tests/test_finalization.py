"""Claims made final, their rules, and payloads: cases by hand, and a second run that changes nothing."""

import json

import pytest
from pyspark.sql import functions as F

from tallowmere import catalog
from tallowmere.operators import finalization as fin
from tallowmere.operators import payloads
from tallowmere.plans import finalization as plan

SCHEMA = (
    "generation_id string, claim_id string, local_claim_index long, source_section string, source_factor_id string, source_text string, source_span_start long, source_span_end long, claim_type string, "
    "subject_type string, feature_id string, concept_id string, direction string, magnitude string, causal_strength string, numeric_value double, numeric_unit string, numeric_role string, claim_origin string, target string"
)


def claim(index, text, start=0, kind="prediction", value=None, gen="g", section="prediction_summary", factor=None, **more):
    row = dict.fromkeys(fin.CLAIM)
    row |= {"generation_id": gen, "claim_id": f"{gen}{index}", "local_claim_index": index, "source_section": section, "source_factor_id": factor, "source_text": text, "source_span_start": start}
    row |= {"source_span_end": start + len(text), "claim_type": kind, "subject_type": "prediction", "direction": "unknown", "causal_strength": "none", "numeric_value": value, "claim_origin": "model"} | more
    return tuple(row[k] for k in fin.CLAIM)


@pytest.mark.parametrize(
    ("text", "value"),
    [("1,234.5", 1234.5), ("1.234,5", 1234.5), ("12,5 %", 12.5), ("-3", -3.0), ("1,234,567", 1234567.0), ("0,123", 0.123), ("1.2.3", None), ("12.345", 12345.0), ("0.345", 0.345)],
)
def test_numbers_as_they_are_written(spark, text, value):
    assert spark.createDataFrame([(text,)], "x string").select(fin.number(F.col("x"))).first()[0] == value


def test_a_number_is_split_off_at_its_place(spark):
    rows = [claim(1, "from 3 to 15 and 5 %", 100, value=5.0), claim(2, "it is 1,250.5 now", 200, "numeric", 1250.5), claim(3, "no number", 300, value=7.0), claim(4, "plain", 400, "ranking")]
    got = {(r.claim_id, r.claim_type): r for r in fin.split_numbers(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 6
    r = got["g1", "numeric"]
    assert (r.source_text, r.source_span_start, r.source_span_end, r.numeric_role, r.rules) == ("5 %", 117, 120, "prediction_score", ["DERIVED_NUMERIC"])
    assert got["g1", "prediction"].numeric_value is None and got["g1", "prediction"].rules == ["NUMBER_SPLIT_OFF"]
    assert (got["g2", "numeric"].source_text, got["g2", "numeric"].source_span_start, got["g2", "numeric"].rules) == ("1,250.5", 206, ["MINIMIZE_NUMERIC_SOURCE"])
    assert got["g3", "numeric"].source_text == "no number"
    assert got["g4", "ranking"].rules == []


def test_facts_have_targets_and_first_places(spark):
    text = "Có 5 yếu tố và 2 nhóm khái niệm; 5 factors, 1 nhóm hỗn hợp. 12 apples"
    sections = spark.createDataFrame([("g", "prediction_summary", None, 10, text), ("g", "factor_explanation", "f1", 200, "3 signals."), ("h", "safe_summary", None, 0, None)], "generation_id string, source_section string, source_factor_id string, start long, text string")
    got = {(r.target, r.value): (r.start, r.end, r.source_text) for r in fin.count_facts(sections).collect()}
    at = lambda x: 10 + text.index(x)
    assert got == {
        ("selected_evidence_count", 5.0): (at("5 y"), at("5 y") + 1, "5"), ("concept_group_count", 2.0): (at("2 n"), at("2 n") + 1, "2"),
        ("mixed_concept_group_count", 1.0): (at("1 n"), at("1 n") + 1, "1"), ("factor_member_count:f1", 3.0): (200, 201, "3"),
    }


def test_texts_at_one_place_have_their_own_counts(spark):
    """What lies before a count is of its own text, even where another text of the section begins at the same place."""
    sections = spark.createDataFrame([("g", "prediction_summary", None, 0, "5 factors"), ("g", "prediction_summary", None, 0, "see\n7  signals, 15 signals")], "generation_id string, source_section string, source_factor_id string, start long, text string")
    assert {r.value: (r.start, r.end) for r in fin.count_facts(sections).collect()} == {5.0: (0, 1), 7.0: (4, 5), 15.0: (16, 18)}


def test_finalizing_twice_changes_nothing(spark):
    text = "5 factors in 2 groups, at 12 %"
    rows = [claim(1, text, 0, value=12.0), claim(2, text, 0, value=5.0, kind="distributed_evidence", subject_type="evidence"), claim(3, "more", 50, "feature_presence", feature_id="x"), claim(4, "again", 60, "feature_presence", feature_id="x"), claim(1, "alone", gen="other")]
    sections = spark.createDataFrame([("g", "prediction_summary", None, 0, text), ("none", "safe_summary", None, 0, "9 groups")], "generation_id string, source_section string, source_factor_id string, start long, text string")
    once = fin.finalized(spark.createDataFrame(rows, SCHEMA), sections)
    kept = {r.claim_id: r for r in once.collect()}
    assert [r.local_claim_index for r in sorted(kept.values(), key=lambda r: (r.generation_id, r.local_claim_index))] == [1, 2, 3, 4, 5, 6, 1]
    stated = {r.target: (r.numeric_value, r.source_span_start) for r in kept.values() if r.target}
    assert stated == {"selected_evidence_count": (5.0, 0), "concept_group_count": (2.0, 13)}
    assert fin.incomplete_counts(once, fin.count_facts(sections.where("generation_id = 'g'"))).count() == 0
    assert fin.incomplete_counts(once.where("target is null"), fin.count_facts(sections)).count() == 3
    again = {r.claim_id: r for r in fin.finalized(once, sections).collect()}
    bare = lambda rs: {k: r.asDict() | {"rules": None} for k, r in rs.items()}
    assert bare(again) == bare(kept)
    assert {x for r in again.values() for x in r.rules} <= {"COUNT_FACT_CANONICALIZATION"}


def test_each_rule_can_be_met(spark):
    """A claim made for each rule meets it, or one before it of the same outcome."""
    rows = []
    for i, (kind, need, words, *_) in enumerate(plan.RULES, 1):
        text = "" if words is None else "45 % " if isinstance(words, str) else words[-1]
        more = {"feature": {"feature_id": "f"}, "concept": {"concept_id": "c"}, "mixed": {"direction": "mixed"}, "role_score": {"numeric_role": "prediction_score"}, "role_threshold": {"numeric_role": "decision_threshold"},
                "role_rank": {"numeric_role": "rank"}, "role_value": {"numeric_role": "feature_value"}, "role_value_of_concept": {"numeric_role": "feature_value", "concept_id": "c"}, "role_count": {"numeric_role": "other", "numeric_unit": "count"}}.get(need, {})
        rows.append(claim(i, text + ("rủi ro CAO" if need == "says_label" else ""), kind=kind, **more))
    rows.append(claim(99, "?", kind="of no known type"))
    got = {r.local_claim_index: r for r in fin.classified(spark.createDataFrame(rows, SCHEMA), plan.RULES, plan.needs()).collect()}
    for i, (*_, final, sub) in enumerate(plan.RULES, 1):
        assert (got[i].final_type, got[i].claim_subtype) == (final, sub) and got[i].rule_id <= i
    assert got[99].rule_id is None and got[99].claim_subtype is None


def test_what_a_meaning_does_not_allow(spark):
    c = fin.classified(spark.createDataFrame([claim(1, "x", kind="feature_presence", section="safe_summary", subject_type="feature", feature_id="f"), claim(2, "x", kind="feature_presence", value=1.0, concept_id="c", feature_id=""), claim(3, "x", kind="numeric", value=1.0)], SCHEMA), plan.RULES, plan.needs())
    got = sorted((r.claim_id, r.code, r.field) for r in fin.incompatible(c, plan.ALLOWED, ("claim_subtype", "feature_id", "concept_id", "numeric_value")).collect())
    assert got == [("g2", "FORBIDDEN", "concept_id"), ("g2", "FORBIDDEN", "numeric_value"), ("g2", "REQUIRED", "feature_id"), ("g2", "SECTION", "source_section"), ("g2", "SUBJECT", "subject_type"), ("g3", "NO_RULE", "claim_subtype")]
    with pytest.raises(ValueError, match="several"):
        fin.incompatible(c, (plan.ALLOWED[0], plan.ALLOWED[0]), ("direction",))


FIELDS = (payloads.Field("a", ("integer",), least=0, most=9), payloads.Field("b", ("string", "null"), values=("x", "y")), payloads.Field("c", ("number",), required=False), payloads.Field("d", ("list",), required=False))


def test_every_fault_of_a_payload(spark):
    good = {"a": 3, "b": "x"}
    texts = [None, "{", "[1]", '{"other": 1}', '{"items": 5}', json.dumps({"items": []})]
    texts += [json.dumps({"items": [good, {"a": "3", "b": None}, {"a": 10, "b": "z", "c": 1}, {"b": "y", "c": 1.5, "d": [1], "e": 0}, 7, {"a": 1, "b": "x", "c": True, "d": {}}]})]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    got = sorted((r.id, r.path, r.code) for r in payloads.violations(d, "id", "payload", "items", FIELDS).collect())
    at = "$.items[{}]{}".format
    assert got == sorted([
        (0, "$", "NOT_JSON"), (1, "$", "NOT_JSON"), (2, "$", "NOT_AN_OBJECT"), (3, "$.items", "NOT_A_LIST"), (4, "$.items", "NOT_A_LIST"), (6, at(1, ".a"), "WRONG_KIND"), (6, at(2, ".a"), "OUT_OF_RANGE"),
        (6, at(2, ".b"), "UNKNOWN_VALUE"), (6, at(3, ".a"), "MISSING"), (6, at(3, ".e"), "UNEXPECTED_FIELD"), (6, at(4, ""), "NOT_AN_OBJECT"), (6, at(5, ".c"), "WRONG_KIND"), (6, at(5, ".d"), "WRONG_KIND"),
    ])
    items = {r.place: (r.faults, r.accepted) for r in payloads.judged(d, "id", "payload", "items", FIELDS).collect()}
    assert items == {0: (0, True), 1: (1, False), 2: (2, False), 3: (2, False), 4: (1, False), 5: (2, False)}


def test_every_code_occurs_in_the_query(spark, medium):
    codes = {r.code for r in catalog.QUERIES["payload_violations"](spark, medium).select("code").distinct().collect()}
    assert codes == {"NOT_JSON", "NOT_AN_OBJECT", "NOT_A_LIST", "MISSING", "WRONG_KIND", "UNKNOWN_VALUE", "OUT_OF_RANGE", "UNEXPECTED_FIELD"}


def test_rules_and_payloads_are_taken_apart_once(spark, small):
    """An item's keys are made once for all fields, a rule's words are lists before they meet the claims."""
    at = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(at)
    spark.conf.set(at, "10000")
    try:
        assert payloads._item_faults(F.col("x"), F.lit("$"), FIELDS)._jc.toString().count("json_object_keys") == 1
        plan = catalog.QUERIES["incompatible_claims"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "source_section" in plan and "split(" not in plan
    finally:
        spark.conf.set(at, before)
