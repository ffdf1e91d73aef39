"""Claims made final: numbers and counts in their own rows, meanings by a table of rules, identities from content.

A claim is a row: generation_id, claim_id, local_claim_index, source_section, source_factor_id, source_text, source_span_start,
source_span_end, claim_type, subject_type, feature_id, concept_id, direction, magnitude, causal_strength,
numeric_value, numeric_unit, numeric_role, claim_origin, target.  Spans count characters of the generation's text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import digest
from .ranking import preferred

CLAIM = (
    "generation_id", "claim_id", "local_claim_index", "source_section", "source_factor_id", "source_text", "source_span_start", "source_span_end", "claim_type", "subject_type",
    "feature_id", "concept_id", "direction", "magnitude", "causal_strength", "numeric_value", "numeric_unit", "numeric_role", "claim_origin", "target",
)
#: How a number is written, and what is counted.
NUMBER = r"[+-]?\d+(?:[.,]\d+)*(?:\s*%)?"
COUNTED = r"features?|factors?|signals?|mixed\s+concept\s+groups?|concept\s+groups?|groups?|đặc\s+trưng|yếu\s+tố|tín\s+hiệu|nhóm\s+khái\s+niệm|nhóm\s+hỗn\s+hợp|nhóm\s+yếu\s+tố|nhóm"
COUNT_TARGETS = (
    (r"mixed concept group|nhom hon hop", "mixed_concept_group_count"),
    (r"nhom khai niem|nhom concept|concept group|nhom yeu to|^nhom$|^groups?$", "concept_group_count"),
)
_FROM, _TO = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ", "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd"


def plain(text: Column) -> Column:
    """Lower-cased, composed Vietnamese letters without their marks, blanks as one space."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"\s+", " ")


def bare_number(raw: Column) -> Column:
    """``raw`` without blanks and per cent sign."""
    return F.translate(raw, "% \t\n\x0b\f\r\u00a0\u202f", "")


def number(raw: Column, bare: bool = False) -> Column:
    """The number that a text of :data:`NUMBER` writes, in English or continental grouping; NULL where it is neither.

    ``bare``: ``raw`` comes from :func:`bare_number`.
    """
    c = raw if bare else bare_number(raw)
    english, continental = c.rlike(r"^[+-]?[1-9]\d{0,2}(,\d{3})+(\.\d+)?$"), c.rlike(r"^[+-]?[1-9]\d{0,2}(\.\d{3})+(,\d+)?$")
    normal = (
        F.when(c.rlike(r"^[+-]?\d+$"), c)  # most are, and no other form is meant then
        .when(english, F.replace(c, F.lit(","), F.lit("")))
        .when(continental, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(c.rlike(r"^[+-]?\d+,\d+$"), F.replace(c, F.lit(","), F.lit(".")))
        .when(c.rlike(r"^[+-]?\d+(\.\d+)?$"), c)
    )
    return normal.try_cast("double")


def with_number_place(claims: DataFrame, text: str = "source_text", value: str = "numeric_value") -> DataFrame:
    """``__at_start`` and ``__at_text`` of the first number in ``text`` that equals ``value``; NULL where none does.

    Each step is a column, made once and only for claims with a value; the first number is tried before the others.
    """
    found, hit, between = F.col("__found"), F.col("__hit"), F.col("__between")
    alike = lambda x, bare=False: F.coalesce(F.abs(number(x, bare) - F.col(value)) <= 1e-9, F.lit(False))
    length = lambda parts, n: F.length(F.array_join(F.slice(parts, 1, n), ""))
    c = claims.withColumn("__found", F.when(F.col(value).isNotNull(), F.regexp_extract_all(text, F.lit(NUMBER), 0)))
    c = c.withColumn("__bare", bare_number(F.get(found, F.lit(0))))
    others = F.array_position(F.transform(found, lambda x: alike(x)), True).cast("int")
    c = c.withColumn("__hit", F.when(alike(F.col("__bare"), True), 1).when(F.size(found) > 1, F.nullif(others, F.lit(0))))
    # what lies before each number
    c = c.withColumn("__between", F.when(hit.isNotNull(), F.regexp_extract_all(text, F.lit(rf"(?s)(.*?)(?:{NUMBER})"), 1)))
    start = length(between, hit) + F.when(hit > 1, length(found, hit - 1)).otherwise(0)
    c = c.withColumns({"__at_start": F.when(hit.isNotNull(), start), "__at_text": F.get(found, hit - 1)})
    return c.drop("__found", "__bare", "__hit", "__between")


def split_numbers(claims: DataFrame) -> DataFrame:
    """A claim of another type that carries a number becomes two: itself without it, and a numeric one.

    A numeric claim's source is the number alone, where its text has it.  The role of a derived one is its own, or follows from
    its type and subject.  ``rules`` notes what was done; running it again does nothing.
    """
    c = with_number_place(claims)
    numeric = F.coalesce(F.col("claim_type") == "numeric", F.lit(False))
    carried = (F.col("claim_type") != "numeric") & F.col("numeric_value").isNotNull()
    # only which of its rows it is comes twice; what it says follows from that. No list is empty, and explode would have Spark make it once more to see
    c = c.withColumn("__row", F.explode_outer(F.when(carried, F.array(F.lit("bare"), F.lit("derived"))).otherwise(F.array(F.lit("own")))))
    bare, derived = F.col("__row") == "bare", F.col("__row") == "derived"
    there = F.col("__at_text").isNotNull() & (derived | (~bare & numeric))
    role = F.when(F.col("claim_type") == "ranking", "rank").when(F.col("subject_type") == "prediction", "prediction_score").when(F.col("subject_type") == "feature", "feature_value").otherwise("other")
    start = F.col("source_span_start") + F.col("__at_start")
    own = {
        "source_text": (there, F.col("__at_text")), "source_span_start": (there, start), "source_span_end": (there, start + F.length("__at_text")),
        "claim_type": (derived, F.lit("numeric")), "direction": (derived, F.lit("unknown")), "magnitude": (derived, F.lit(None)), "causal_strength": (derived, F.lit("none")), "claim_origin": (derived, F.lit("derived_numeric")),
        "local_claim_index": (derived, F.lit(0)), "numeric_value": (bare, F.lit(None)), "numeric_unit": (bare, F.lit(None)), "numeric_role": (bare | derived, F.when(derived, F.coalesce("numeric_role", role))),
    }
    names = [k for k in claims.columns if k not in CLAIM and k != "rules"]

    def field(k: str) -> Column:
        return (F.when(own[k][0], own[k][1].cast(claims.schema[k].dataType)).otherwise(F.col(k)) if k in own else F.col(k)).alias(k)

    moved = ~bare & ~derived & there & ((F.col("__at_text") != F.col("source_text")) | (F.col("__at_start") != 0))
    none = F.array().cast("array<string>")
    rule = F.when(bare, F.array(F.lit("NUMBER_SPLIT_OFF"))).when(derived, F.array(F.lit("DERIVED_NUMERIC"))).when(moved, F.array(F.lit("MINIMIZE_NUMERIC_SOURCE"))).otherwise(none)
    if "rules" in claims.columns:
        rule = F.array_compact(F.array_union(F.coalesce("rules", none), rule))
    return c.select("generation_id", *[field(k) for k in (*CLAIM[1:], *names)], rule.alias("rules"))  # a generation's rows stay where they lie


def count_facts(sections: DataFrame, dealt: bool = False) -> DataFrame:
    """Counts that texts state: ``generation_id, target, value, source_section, source_factor_id, source_text, start, end``.

    ``sections(generation_id, source_section, source_factor_id, start, text)``.  Of one target and value the first place counts.  Places come
    from the lengths of what lies before them.  Sections that state a count are dealt once, by generation (``dealt``: they lie so), and sorted once.
    """
    pattern = rf"(\d+)\s+({COUNTED})(?=\s|[.,;:)]|$)"
    s = sections.select("generation_id", "source_section", "source_factor_id", "start", "text").where(F.col("text").rlike(f"(?i){pattern}"))
    s = s if dealt else s.repartition("generation_id")
    # counts, and texts from the end of one count to that of the next
    s = s.select("generation_id", "source_section", "source_factor_id", "start", F.regexp_extract_all("text", F.lit(f"(?i){pattern}"), 0).alias("__whole"), F.regexp_extract_all("text", F.lit(f"(?is).*?{pattern}"), 0).alias("__upto"))
    e = s.select("generation_id", "source_section", "source_factor_id", "start", "__upto", F.posexplode_outer("__whole").alias("place", "whole"))
    e = e.select("generation_id", "source_section", "source_factor_id", F.regexp_extract("whole", r"^\d+", 0).alias("source_text"), plain(F.regexp_extract("whole", r"(?s)^\d+\s+(.*)$", 1)).alias("__noun"),
        (F.col("start") + F.length(F.array_join(F.slice("__upto", 1, F.col("place") + 1), "")) - F.length("whole")).alias("start"))
    target = F.when((F.col("source_section") == "factor_explanation") & F.col("source_factor_id").isNotNull(), F.concat(F.lit("factor_member_count:"), "source_factor_id")).otherwise("selected_evidence_count")
    for words, name in reversed(COUNT_TARGETS):
        target = F.when(F.col("__noun").rlike(words), name).otherwise(target)
    f = e.select("generation_id", target.alias("target"), F.col("source_text").try_cast("double").alias("value"), "source_section", "source_factor_id", "source_text", "start", (F.col("start") + F.length("source_text")).alias("end"))
    return preferred(f.where(F.col("value") <= 2**53 - 1), ["generation_id", "target", "value"], ["start", "source_section", "source_factor_id", "source_text", "end"])


def _as_count(fact: dict[str, Column]) -> dict[str, Column]:
    """The fields of a claim that states a count."""
    return {
        "source_section": fact["source_section"], "source_factor_id": fact["source_factor_id"], "source_text": fact["source_text"], "source_span_start": fact["start"], "source_span_end": fact["end"],
        "claim_type": F.lit("numeric"), "subject_type": F.lit("evidence"), "feature_id": F.lit(None), "concept_id": F.lit(None), "direction": F.lit("unknown"), "magnitude": F.lit(None),
        "causal_strength": F.lit("none"), "numeric_value": fact["value"], "numeric_unit": F.lit("count"), "numeric_role": F.lit("other"), "claim_origin": F.lit("derived_numeric"),
        "target": fact["target"], "local_claim_index": F.lit(0),
    }


def with_counts(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """``claims`` in which every fact of :func:`count_facts` is stated by a numeric claim.

    A fact belongs to the numeric claims with its value at its place, if there are none to those with its value and target; these take its form.
    Else a claim is added after the model of the least claim around its place, in its section, or of its generation.
    A generation without claims gets none.  A generation's facts are one row, which meets its claims where they lie; all else is windows over
    generations, so claims are dealt once.
    """
    g = W.partitionBy("generation_id")
    names = ("start", "target", "value", "source_section", "source_factor_id", "source_text", "end")
    # facts that were sorted to find the first of each need no other order
    f = facts.select("generation_id", F.collect_list(F.struct(*names)).over(g).alias("__facts"), F.row_number().over(g.orderBy("target", "value")).alias("__n")).where("__n = 1").drop("__n")
    c = claims.join(f, "generation_id", "left")
    numeric = F.coalesce(F.col("claim_type") == "numeric", F.lit(False))
    here = lambda x: (F.col("source_span_start") == x["start"]) & (F.col("source_span_end") == x["end"])
    same = lambda x: F.coalesce(F.col("numeric_value") == x["value"], F.lit(False))
    some = lambda c: F.when(F.size(c) > 0, c)
    # facts have one target and value, so they are told apart by their place in the list; only numeric claims can state one
    at = lambda test: F.when(numeric & F.col("__facts").isNotNull(), some(F.filter(F.transform("__facts", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())))
    c = c.withColumns({"__here": at(lambda x: same(x) & F.coalesce(here(x), F.lit(False))), "__alike": at(lambda x: same(x) & F.coalesce(F.col("target") == x["target"], F.lit(False)))})
    place = F.struct("source_span_start", "local_claim_index")
    c = c.withColumns({"__met": F.flatten(F.collect_list("__here").over(g)), "__named": F.flatten(F.collect_list("__alike").over(g)), "__first": F.min(place).over(g)})
    none = F.array().cast("array<int>")
    mine = F.array_union(F.coalesce("__here", none), F.array_except(F.coalesce("__alike", none), "__met"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__facts") - 1), F.concat("__met", "__named"))
    c = c.withColumns({"__mine": F.when(F.col("__here").isNotNull() | F.col("__alike").isNotNull(), mine), "__left": F.when(F.col("__facts").isNotNull(), left)})
    # beyond its section a fact takes the first claim of all, so no other one competes there
    around = lambda x: F.coalesce(F.col("source_section") == x["source_section"], F.lit(False)) & F.col("source_factor_id").eqNullSafe(x["source_factor_id"])
    within = lambda x: F.coalesce((F.col("source_span_start") <= x["start"]) & (F.col("source_span_end") >= x["end"]), F.lit(False))
    tier = lambda x: F.when(around(x), F.when(within(x), 0).otherwise(1)).when(F.col("__is_first"), 2)
    # a fact's place and its tier as one number: a row of each claim, and one of each fact that it may be the model of
    added = F.filter(F.transform("__left", lambda i: i * 3 + tier(F.get("__facts", i))), lambda x: x.isNotNull())
    c = c.withColumn("__is_first", place.eqNullSafe(F.col("__first")))
    c = c.withColumn("__rows", F.when(F.size("__left") > 0, F.concat(F.array(F.lit(-1)), added)).otherwise(F.array(F.lit(-1))))
    least = F.when(F.size("__mine") == 1, F.get("__facts", F.get("__mine", F.lit(0)))).when(F.size("__mine") > 1, F.array_min(F.transform("__mine", lambda i: F.get("__facts", i))))
    kind, whole_row = claims.schema, [F.col(x) for x in claims.columns]
    c = c.withColumn("__one", least).select(*whole_row, "__facts", "__one", F.explode_outer("__rows").alias("__v"))
    i = F.when(F.col("__v") >= 0, (F.col("__v") / 3).cast("int"))
    c = c.select(*whole_row, F.coalesce(F.get("__facts", i), "__one").alias("__fact"), i.alias("__i"), (F.col("__v") % 3).alias("__tier"))
    # rows that are alike in all of this say the same
    order = W.partitionBy("generation_id", "__i").orderBy("__tier", "source_span_start", "local_claim_index", *[x for x in claims.columns if x not in ("generation_id", "source_span_start", "local_claim_index")])
    c = c.withColumn("__place", F.row_number().over(order)).where("__i is null or __place = 1")
    fact = {x: F.col("__fact")[x] for x in names}
    as_count, stated = _as_count(fact), F.col("__fact").isNotNull()
    rule = F.when(F.col("__i").isNotNull(), "COUNT_FACT_ADDED").otherwise("COUNT_FACT_CANONICALIZATION")
    whole = {x: F.when(stated, as_count[x].cast(kind[x].dataType)).otherwise(F.col(x)).alias(x) for x in as_count}
    return c.select(*[whole.get(x, F.col(x)) for x in claims.columns if x != "rules"], F.when(stated, F.array_union("rules", F.array(rule))).otherwise(F.col("rules")).alias("rules"))


def signature() -> Column:
    """What a claim says, without where: claims that share it say the same."""
    part = lambda x: F.coalesce(F.lower(F.trim(x)), F.lit("none"))
    kind = F.col("claim_type")
    subject = F.concat(F.lit("feature:"), part("feature_id"), F.lit("|concept:"), part("concept_id"))
    tail = (
        F.when(kind == "numeric", F.concat_ws("|", F.concat(F.lit("role:"), part("numeric_role")), F.concat(F.lit("value:"), F.coalesce(F.col("numeric_value").cast("decimal(30,6)").cast("string"), F.lit("none"))), F.concat(F.lit("unit:"), part("numeric_unit")), F.concat(F.lit("target:"), part("target"))))
        .when(kind.isin("feature_direction", "concept_direction", "prediction"), F.concat(F.lit("direction:"), part("direction")))
        .when(kind == "magnitude", F.concat(F.lit("magnitude:"), part("magnitude")))
        .when(kind == "causal", F.concat(F.lit("causal:"), part("causal_strength")))
        .when(kind.isin("feature_presence", "concept_presence", "ranking"), F.lit("-"))
        .otherwise(F.concat(F.lit("text:"), plain(F.trim("source_text"))))
    )
    return F.concat_ws("|", kind, subject, tail)


def finalized(claims: DataFrame, sections: DataFrame, dealt: bool = False) -> DataFrame:
    """Final claims: numbers split off, counts stated, duplicates gone, ids from content, indices from 1 by place.

    Adds ``semantic_signature`` and ``rules`` (what was done to a claim).  ``claim_id`` is the digest of generation and signature, so running
    it on its own result changes no row but empties ``rules``.  Claims are dealt once, by generation, whose claims come in one task's order; ``dealt``:
    claims and sections lie so already.
    """
    base = claims.select(*CLAIM)
    base = base if dealt else base.repartition("generation_id")
    c = with_counts(split_numbers(base), count_facts(sections, dealt)).withColumn("semantic_signature", signature())
    order = ["source_span_start", "source_span_end", "local_claim_index", "claim_id"]
    by = ["generation_id", "semantic_signature"]
    c = preferred(c, by, order + [x for x in c.columns if x not in order + by])
    number_ = F.row_number().over(W.partitionBy("generation_id").orderBy("source_span_start", "source_span_end", "semantic_signature"))
    c = c.withColumns({"claim_id": digest(F.col("generation_id"), F.col("semantic_signature")), "local_claim_index": number_.cast("long")})
    return c.select(*CLAIM, "semantic_signature", F.sort_array("rules").alias("rules"))


def incomplete_counts(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that not exactly one claim states: ``generation_id, target, value, claims``."""
    c = claims.where("claim_type = 'numeric' and subject_type = 'evidence' and numeric_unit = 'count' and numeric_role = 'other' and claim_origin = 'derived_numeric'")
    c = c.select("generation_id", "target", F.col("numeric_value").alias("value"), "source_text", F.col("source_span_start").alias("start"), F.col("source_span_end").alias("end"), F.lit(1).alias("__one"))
    n = facts.join(c, ["generation_id", "target", "value", "source_text", "start", "end"], "left").groupBy("generation_id", "target", "value").agg(F.count("__one").alias("claims"))
    return n.where("claims <> 1")


def classified(claims: DataFrame, rules: Sequence[tuple], needs: dict[str, Column]) -> DataFrame:
    """``claims`` with ``rule_id``, ``final_type`` and ``claim_subtype``: the first rule that fits.

    ``rules``: (claim_type, need, wordings, final_type, subtype) in their order; ``need`` names a condition of ``needs`` (None: none), ``wordings`` are
    tried on the plain text: a tuple of phrases, one of which it holds, an expression that it matches, or None.
    A rule's id is its place from 1.  All rules are one expression, in which a claim only meets those of its type; one that fits none has NULLs.
    """
    text = F.col("__text")

    def fits(need: str | None, words) -> Column:
        tests = [F.lit(True)]
        if need:
            tests.append(F.coalesce(needs[need], F.lit(False)))
        if words:
            tests.append(text.rlike(words if isinstance(words, str) else "|".join(map(re.escape, words))))
        return reduce(Column.__and__, tests)

    by_type: dict[str, Column] = {}
    for i, (kind, need, words, *_) in reversed(list(enumerate(rules, 1))):
        by_type[kind] = F.when(fits(need, words), i).otherwise(by_type.get(kind, F.lit(None).cast("int")))
    hit = F.lit(None).cast("int")
    for kind, found in by_type.items():
        hit = F.when(F.col("claim_type") == kind, found).otherwise(hit)
    names = F.create_map(*[x for i, r in enumerate(rules, 1) for x in (F.lit(i), F.struct(F.lit(r[3]).alias("final_type"), F.lit(r[4]).alias("claim_subtype")))])
    c = claims.withColumn("__text", plain(F.coalesce("source_text", F.lit("")))).withColumn("rule_id", hit).drop("__text")
    return c.withColumn("__n", F.try_element_at(names, "rule_id")).select("*", "__n.final_type", "__n.claim_subtype").drop("__n")


def incompatible(claims: DataFrame, table: Sequence[tuple], fields: Sequence[str], key: str = "claim_id") -> DataFrame:
    """``(key, code, field)``: what a claim's type and subtype don't allow.

    ``table``: (type, subtype, sections, required fields, forbidden fields, subject types), each list as words.  Codes: NO_RULE, SECTION, SUBJECT, REQUIRED,
    FORBIDDEN; an empty text counts as missing.  A pair that is there twice fails.
    """
    if len({r[:2] for r in table}) < len(table):
        raise ValueError("a type and subtype have several rules")
    lists = [(*r[:2], *[x.split() for x in r[2:]]) for r in table]
    t = claims.sparkSession.createDataFrame(lists, "final_type string, claim_subtype string, __sections array<string>, __required array<string>, __forbidden array<string>, __subjects array<string>")
    c = claims.join(F.broadcast(t), ["final_type", "claim_subtype"], "left")  # a table of rules, given as a list
    named = lambda k: sorted({x for r in lists for x in r[k]})
    there = lambda x: F.nullif(F.col(x).cast("string"), F.lit("")).isNotNull() if x in fields else F.lit(False)
    fault = lambda code, field, bad: F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    single = lambda code, name, field: fault(code, field, ~F.array_contains(f"__{name}", F.coalesce(F.col(field), F.lit("-"))))
    every = F.array(
        fault("NO_RULE", "claim_subtype", F.col("__sections").isNull()), single("SECTION", "sections", "source_section"), single("SUBJECT", "subjects", "subject_type"),
        *[fault("REQUIRED", x, F.array_contains("__required", x) & ~there(x)) for x in named(3)], *[fault("FORBIDDEN", x, F.array_contains("__forbidden", x) & there(x)) for x in named(4)],
    )
    return c.select(key, F.explode(F.array_compact(every)).alias("x")).select(key, "x.code", "x.field")
