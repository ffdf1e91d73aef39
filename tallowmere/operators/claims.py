"""Claims of an explanation, checked against the evidence that its author was shown.

A claim is a row of a wide struct with a type; its evidence is joined once and every type's rule is one
branch of a column expression that ends in a reason.  What a reason means is data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import digest
from ..functions.numeric import count_where

#: Reason, family and the status that it gives a claim (None: the check itself failed).
REASONS = (
    ("EXACT_MATCH", "MATCH", "SUPPORTED"), ("NORMALIZED_MATCH", "MATCH", "SUPPORTED"), ("TOLERANCE_MATCH", "MATCH", "SUPPORTED"), ("MAGNITUDE_MATCH", "MATCH", "SUPPORTED"),
    ("PREDICTION_LABEL_MISMATCH", "PREDICTION", "CONTRADICTED"), ("PREDICTION_PROBABILITY_MISMATCH", "PREDICTION", "CONTRADICTED"), ("PREDICTION_THRESHOLD_MISMATCH", "PREDICTION", "CONTRADICTED"), ("PREDICTION_VALUE_UNAVAILABLE", "PREDICTION", "NOT_VERIFIABLE"),
    ("FEATURE_NOT_EXPOSED", "EXPOSURE", "UNSUPPORTED"), ("CONCEPT_NOT_EXPOSED", "EXPOSURE", "UNSUPPORTED"), ("DIRECTION_NOT_EXPOSED", "EXPOSURE", "UNSUPPORTED"), ("MAGNITUDE_NOT_EXPOSED", "EXPOSURE", "UNSUPPORTED"), ("RANKING_NOT_EXPOSED", "EXPOSURE", "UNSUPPORTED"),
    ("FEATURE_NOT_FOUND_IN_EVIDENCE", "FEATURE", "UNSUPPORTED"), ("FEATURE_ALIAS_UNRESOLVED", "FEATURE", "NOT_VERIFIABLE"), ("CONCEPT_NOT_FOUND_IN_EVIDENCE", "CONCEPT", "UNSUPPORTED"),
    ("DIRECTION_REVERSED", "DIRECTION", "CONTRADICTED"), ("DIRECTION_NEUTRAL", "DIRECTION", "CONTRADICTED"), ("DIRECTION_MIXED_OR_UNKNOWN", "DIRECTION", "NOT_VERIFIABLE"), ("DIRECTION_SOURCE_MISSING", "DIRECTION", "NOT_VERIFIABLE"),
    ("NUMERIC_EXACT_MISMATCH", "NUMERIC", "CONTRADICTED"), ("NUMERIC_OUTSIDE_TOLERANCE", "NUMERIC", "CONTRADICTED"), ("NUMERIC_ROLE_UNSUPPORTED", "NUMERIC", "NOT_VERIFIABLE"), ("NUMERIC_SOURCE_MISSING", "NUMERIC", "NOT_VERIFIABLE"),
    ("RANKING_UNSUPPORTED", "RANKING", "UNSUPPORTED"), ("RANK_TIE_AMBIGUOUS", "RANKING", "NOT_VERIFIABLE"), ("RANK_SOURCE_MISSING", "RANKING", "NOT_VERIFIABLE"),
    ("MAGNITUDE_UNSUPPORTED", "MAGNITUDE", "UNSUPPORTED"), ("MAGNITUDE_OVERSTATED", "MAGNITUDE", "CONTRADICTED"), ("MAGNITUDE_UNDERSTATED", "MAGNITUDE", "CONTRADICTED"), ("MAGNITUDE_SOURCE_MISSING", "MAGNITUDE", "NOT_VERIFIABLE"), ("MAGNITUDE_SEMANTICS_UNSUPPORTED", "MAGNITUDE", "NOT_VERIFIABLE"),
    ("SEMANTIC_SOURCE_UNFROZEN", "POLICY", "NOT_VERIFIABLE"), ("SEMANTIC_SUBTYPE_UNRESOLVED", "POLICY", "NOT_VERIFIABLE"), ("CERTAINTY_OVERCLAIM", "UNCERTAINTY", "CONTRADICTED"), ("UNCERTAINTY_NOT_GROUNDED", "UNCERTAINTY", "UNSUPPORTED"),
    ("CAUSAL_OVERCLAIM", "POLICY", "CONTRADICTED"), ("GUARANTEE_OVERCLAIM", "POLICY", "CONTRADICTED"), ("POLICY_RULE_NOT_APPLICABLE", "POLICY", "NOT_APPLICABLE"),
    ("EVIDENCE_JOIN_FAILED", "SYSTEM", None), ("UNSUPPORTED_CLAIM_TYPE", "SYSTEM", None),
)
TYPES = ("prediction", "feature_presence", "feature_direction", "concept_presence", "concept_direction", "numeric", "ranking", "magnitude", "uncertainty", "distributed_evidence", "recommendation", "causal", "limitation")
#: Role, unit, divisor of the claimed number, tolerance (None: no comparison is defined).
NUMERIC_RULES = (
    ("prediction_score", "percent", 100.0, 5e-05), ("prediction_score", "probability", 1.0, 5e-05),
    ("decision_threshold", "percent", 100.0, 5e-05), ("decision_threshold", "probability", 1.0, 5e-05),
    ("rank", "rank", 1.0, 0.0), ("other", "count", 1.0, 0.0),
)
STRENGTHS = ("weak", "moderate", "strong")


def unit(c: Column) -> Column:
    """The unit under its usual name; unitless for none."""
    u = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(u.isin("%", "percent", "percentage"), "percent").when(u.isin("probability", "probability_0_to_1", "rate_0_to_1"), "probability").when(u.isin("count", "counts", "integer"), "count").when(u.isin("rank", "ordinal"), "rank").when(u == "", "unitless").otherwise(u)


def _reason(*branches: tuple[Column, str], otherwise: str | Column) -> Column:
    out = F
    for c, r in branches:
        out = out.when(F.coalesce(c, F.lit(False)), r)
    return out.otherwise(otherwise)


def _compared(claimed: Column, shown: Column, normalised: Column) -> Column:
    return _reason(
        (claimed.isin("mixed", "unknown") | claimed.isNull(), "DIRECTION_MIXED_OR_UNKNOWN"),
        (shown.isNull(), "DIRECTION_SOURCE_MISSING"),
        (shown.isin("mixed", "unknown"), "DIRECTION_MIXED_OR_UNKNOWN"),
        (shown == "neutral", "DIRECTION_NEUTRAL"),
        (claimed != shown, "DIRECTION_REVERSED"),
        (normalised, "NORMALIZED_MATCH"),
        otherwise="EXACT_MATCH",
    )


def singular(c: Column) -> Column:
    """``increases_risk`` as ``increase_risk``."""
    return F.regexp_replace(c, "^(increase|decrease)s_", "$1_")


def concept_view(items: DataFrame) -> DataFrame:
    """``(package_id, concept_id, c_direction, c_mass, c_features, c_strength, c_rank, c_tied)`` of ``items``.

    Directions of a concept's features are one, or mixed; the strongest feature gives its strength.
    """
    from pyspark.sql import Window as W

    d = singular(F.col("direction"))
    # counts and extremes instead of distinct counts, for each of which Spark would repeat the rows
    several = (count_where(d == "increase_risk") > 0) & (count_where(d == "decrease_risk") > 0)
    mixed = several | (count_where(d == "mixed") > 0)
    g = items.where("concept_id is not null").groupBy("package_id", "concept_id").agg(
        F.when(mixed, "mixed").when(F.min(d) == F.max(d), F.min(d)).otherwise("unknown").alias("c_direction"),
        F.sum("abs_shap_value").alias("c_mass"), F.count("*").alias("c_features"), F.max_by("strength", F.struct("abs_shap_value", "feature_id")).alias("c_strength"),
    )
    return g.withColumn("c_rank", F.rank().over(W.partitionBy("package_id").orderBy(F.desc("c_mass")))).withColumn("c_tied", F.count("*").over(W.partitionBy("package_id", "c_mass")) > 1)


def shown(items: DataFrame) -> DataFrame:
    """``(package_id, p_features, p_items, p_concepts, p_n_concepts, p_mixed)``: what a package shows, its features and its concepts, in one row.

    Items are dealt and collected by package once; its concepts, as in :func:`concept_view` with ``mass`` instead of ranks, are made
    within the row.  A package is what an author was shown, so it fits a row.
    """
    i = items.withColumn("__d", singular(F.col("direction")))
    item = F.struct("feature_id", "concept_id", F.col("abs_shap_value").cast("double").alias("abs_shap_value"), F.col("__d").alias("direction"), (F.col("direction") != F.col("__d")).alias("normalised"), "rank", "strength")
    g = i.groupBy("package_id").agg(F.collect_list(item).alias("p_items"))
    names = F.array_distinct(F.filter(F.col("p_items")["concept_id"], lambda k: k.isNotNull()))
    own = F.transform(names, lambda k: F.struct(k.alias("concept_id"), F.filter("p_items", lambda x: x["concept_id"] == k).alias("own")))
    own = F.transform(own, lambda c: F.struct(c["concept_id"].alias("concept_id"), c["own"].alias("own"), F.array_distinct(F.filter(c["own"]["direction"], lambda d: d.isNotNull())).alias("ways")))

    def concept(c: Column) -> Column:
        has = lambda d: F.array_contains(c["ways"], d)
        direction = F.when((has("increase_risk") & has("decrease_risk")) | has("mixed"), "mixed").when(F.size(c["ways"]) == 1, F.get(c["ways"], 0)).otherwise("unknown")
        mass = F.aggregate(c["own"]["abs_shap_value"], F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x, a, x))
        strongest = F.array_max(F.transform(c["own"], lambda x: F.struct(x["abs_shap_value"], x["feature_id"], x["strength"].alias("strength"))))
        return F.struct(c["concept_id"].alias("concept_id"), direction.alias("direction"), mass.alias("mass"), F.size(c["own"]).cast("long").alias("features"), strongest["strength"].alias("strength"))

    g = g.withColumn("p_concepts", F.transform(own, concept))
    return g.select("package_id", F.size("p_items").cast("long").alias("p_features"), "p_items", "p_concepts", F.size("p_concepts").alias("p_n_concepts"), F.array_contains(F.col("p_concepts")["direction"], "mixed").alias("p_mixed"))


def heard(claims: DataFrame) -> DataFrame:
    """``claims`` with what the rules take from texts: ``__said``, a probability, and ``__over``, whether too much is claimed."""
    over, guarded = r"(?i)\b(will certainly|guarantees?( that)?|absolutely accurate)\b", r"(?i)\b(not|cannot|can't|no)\b[^.]{0,40}\b(guarantee|certain|accurate)"
    # only where a rule asks for it: texts are searched for each claim, and a text without number is no number
    sure = F.col("certainty") == "deterministic"
    number = F.nullif(F.regexp_extract("source_text", r"(\d+(?:[.,]\d+)?)\s*%", 1), F.lit(""))
    c = claims.withColumn("__said", F.when((F.col("claim_type") == "prediction") & (F.col("claim_subtype") == "OVERALL_PROBABILITY"), F.replace(number, F.lit(","), F.lit(".")).try_cast("double") / 100))
    return c.withColumn("__over", F.when(sure & F.col("claim_type").isin("uncertainty", "recommendation"), F.col("source_text").rlike(over) & ~F.col("source_text").rlike(guarded)))


def met(claims: DataFrame, packages: DataFrame, items: DataFrame) -> DataFrame:
    """``claims`` with their package and what it shows, in one deal by package; for the tables see :func:`validated`."""
    own = [x for x in packages.columns if x != "package_id" and x in claims.columns]
    p = packages.drop(*own).withColumn("p_known", F.lit(True))
    return claims.join(p, "package_id", "left").join(shown(items), "package_id", "left")


def validated(claims: DataFrame, packages: DataFrame, items: DataFrame) -> DataFrame:
    """``claims`` with exposure_state, reason_code, reason_family, validation_status and execution_status.

    ``claims(claim_id, package_id, claim_type, claim_subtype, feature_id, concept_id, direction, magnitude, certainty,
    causal_strength, numeric_value, numeric_unit, numeric_role, source_text, ...)``; ``packages(package_id,
    evidence_level, predicted_label, positive_label, probability, threshold, is_above_threshold,
    allow_causal_claim, allow_financial_advice, selected_evidence_count, allowed_feature_ids,
    allowed_concept_ids)``; ``items(package_id, feature_id, concept_id, direction, abs_shap_value, rank,
    strength)``, what the package shows.  Each claim joins its package, where at most one feature and one
    concept are its own; a claim without package gets the status of a failed check, and no claim is lost.
    """
    # what the rules take from texts goes along instead of these, and packages and what they show meet the claims in one deal of these
    out = judged(met(heard(claims), packages, items))
    return out.select(*claims.columns, "exposure_state", "reason_code", "reason_family", "validation_status", "execution_status")


def judged(j: DataFrame) -> DataFrame:
    """Claims that were :func:`heard` and have :func:`met` their package, with the columns that :func:`validated` adds; each is judged in its row."""
    # one feature and one concept at most
    found = lambda name, rows: F.when(F.col(name).isNotNull(), F.get(F.col(rows), (F.array_position(F.col(rows)[name], F.col(name)) - 1).cast("int")))
    columns, sure = j.columns, F.col("certainty") == "deterministic"
    j = j.withColumns({"__f": found("feature_id", "p_items"), "__c": found("concept_id", "p_concepts")})
    # within the rules, not columns: what a package shows would be copied with the claim for each step, and searched for claims whose rule doesn't ask.
    # Searches also keep the rules out of one generated method, which would be too long for Java to compile
    alike = lambda rows, x, y: F.size(F.filter(rows, lambda r: r[y].eqNullSafe(F.col(x)[y])))
    own = F.col("__c")["mass"]
    ahead = F.size(F.filter("p_concepts", lambda r: F.coalesce(r["mass"] > own, r["mass"].isNotNull() & own.isNull())))
    made = {f"f_{n}": F.col("__f")[n] for n in ("direction", "normalised", "rank", "strength")} | {f"c_{n}": F.col("__c")[n] for n in ("direction", "features", "strength")}
    made |= {"f_shown": F.when(F.col("__f").isNotNull(), True), "c_shown": F.when(F.col("__c").isNotNull(), True), "p_alias": F.exists("p_items", lambda x: F.lower(x["feature_id"]) == F.lower("feature_id"))}
    made |= {"f_tied": alike("p_items", "__f", "abs_shap_value") > 1, "c_tied": alike("p_concepts", "__c", "mass") > 1, "c_rank": ahead + 1}
    col = lambda n: made.get(n, F.col(n))
    s0 = col("evidence_level") == "S0"
    feature = col("feature_id").isNotNull()
    claimed_label = F.when(col("direction") == "increase_risk", True).when(col("direction") == "decrease_risk", False)
    label = _reason((col("predicted_label").isNull() | claimed_label.isNull(), "PREDICTION_VALUE_UNAVAILABLE"), (claimed_label != (col("predicted_label") == col("positive_label")), "PREDICTION_LABEL_MISMATCH"), otherwise="EXACT_MATCH")
    said = col("__said")
    off = F.abs(said - col("probability"))
    score = _reason((said.isNull(), "SEMANTIC_SOURCE_UNFROZEN"), (off > 5e-05, "PREDICTION_PROBABILITY_MISMATCH"), (off == 0, "NORMALIZED_MATCH"), otherwise="TOLERANCE_MATCH")
    threshold = _reason((claimed_label.isNull(), "PREDICTION_VALUE_UNAVAILABLE"), (claimed_label != col("is_above_threshold"), "PREDICTION_THRESHOLD_MISMATCH"), otherwise="EXACT_MATCH")
    prediction = F.when(col("claim_subtype") == "OVERALL_PROBABILITY", score).when(col("claim_subtype") == "THRESHOLD_COMPARISON", threshold).otherwise(label)
    feature_presence = _reason((s0, "FEATURE_NOT_EXPOSED"), (col("f_shown"), "EXACT_MATCH"), (col("p_alias"), "FEATURE_ALIAS_UNRESOLVED"), otherwise="FEATURE_NOT_FOUND_IN_EVIDENCE")
    feature_direction = _reason((s0, "DIRECTION_NOT_EXPOSED"), (col("f_shown").isNull(), "FEATURE_NOT_FOUND_IN_EVIDENCE"), otherwise=_compared(col("direction"), col("f_direction"), col("f_normalised")))
    concept_presence = _reason((s0, "CONCEPT_NOT_EXPOSED"), (col("c_shown"), "EXACT_MATCH"), otherwise="CONCEPT_NOT_FOUND_IN_EVIDENCE")
    concept_direction = _reason((s0, "DIRECTION_NOT_EXPOSED"), (col("c_shown").isNull(), "CONCEPT_NOT_FOUND_IN_EVIDENCE"), otherwise=_compared(col("direction"), col("c_direction"), F.lit(False)))
    divisor, tolerance = F.lit(None).cast("double"), F.lit(None).cast("double")
    for role, u, d, t in NUMERIC_RULES:
        hit = (col("numeric_role") == role) & (unit(col("numeric_unit")) == u)
        divisor, tolerance = F.when(hit, d).otherwise(divisor), F.when(hit, t).otherwise(tolerance)
    source = F.when(col("numeric_role") == "prediction_score", col("probability")).when(col("numeric_role") == "decision_threshold", col("threshold")).when(col("numeric_role") == "rank", col("f_rank").cast("double")).when(col("numeric_role") == "other", F.coalesce(F.when(col("concept_id").isNotNull(), col("c_features")), col("selected_evidence_count")).cast("double"))
    delta = F.abs(col("numeric_value") / divisor - source)
    numeric = _reason(
        (col("numeric_value").isNull() | col("numeric_role").isNull(), "NUMERIC_SOURCE_MISSING"), (tolerance.isNull(), "NUMERIC_ROLE_UNSUPPORTED"), (source.isNull(), "NUMERIC_SOURCE_MISSING"),
        ((tolerance == 0) & (delta == 0), "EXACT_MATCH"), (tolerance == 0, "NUMERIC_EXACT_MISMATCH"), (delta > tolerance, "NUMERIC_OUTSIDE_TOLERANCE"), (delta != 0, "TOLERANCE_MATCH"), (divisor != 1, "NORMALIZED_MATCH"), otherwise="EXACT_MATCH",
    )
    place = lambda shown, tied, rank: _reason((shown.isNull(), "RANKING_UNSUPPORTED"), (tied, "RANK_TIE_AMBIGUOUS"), (rank == 1, "EXACT_MATCH"), otherwise="RANKING_UNSUPPORTED")
    ranking = _reason((s0, "RANKING_NOT_EXPOSED"), (~feature & col("concept_id").isNull(), "RANK_SOURCE_MISSING"), otherwise=F.when(feature, place(col("f_shown"), col("f_tied"), col("f_rank"))).otherwise(place(col("c_shown"), col("c_tied"), col("c_rank"))))
    level = lambda c: F.array_position(F.array(*map(F.lit, STRENGTHS)), c)
    shown_strength = F.when(feature, col("f_strength")).otherwise(col("c_strength"))
    seen = F.when(feature, col("f_shown")).otherwise(col("c_shown"))
    more = F.when(level(col("magnitude")) > 0, level(col("magnitude")) - level(shown_strength)).otherwise(0)
    magnitude = _reason(
        (s0, "MAGNITUDE_NOT_EXPOSED"), (col("claim_subtype").isin("COMPARATIVE_STRENGTH", "OVERALL_BALANCE"), "MAGNITUDE_SEMANTICS_UNSUPPORTED"), (seen.isNull(), "MAGNITUDE_UNSUPPORTED"),
        (~F.coalesce(shown_strength.isin(*STRENGTHS), F.lit(False)), "MAGNITUDE_SOURCE_MISSING"), (more > 0, "MAGNITUDE_OVERSTATED"), (more < 0, "MAGNITUDE_UNDERSTATED"), otherwise="MAGNITUDE_MATCH",
    )
    overclaim = col("__over")
    uncertainty = _reason((sure & overclaim, "CERTAINTY_OVERCLAIM"), (col("claim_subtype") == "CONFIDENCE_STRENGTH", "SEMANTIC_SOURCE_UNFROZEN"), ((col("claim_subtype") == "EVIDENCE_SCOPE_UNCERTAINTY") & ~s0, "UNCERTAINTY_NOT_GROUNDED"), ((col("claim_subtype") == "PROBABILITY_HEDGE") & (col("certainty") == "probabilistic"), "NORMALIZED_MATCH"), ((col("claim_subtype") == "PROBABILITY_HEDGE") & (col("certainty") != "hedged"), "UNCERTAINTY_NOT_GROUNDED"), otherwise="EXACT_MATCH")
    grounded = F.when(col("claim_subtype") == "MULTIPLE_FEATURES", col("p_features") > 1).when(col("claim_subtype") == "MULTIPLE_CONCEPTS", col("p_n_concepts") > 1).when(col("claim_subtype") == "MIXED_DIRECTIONS", F.coalesce("p_mixed", F.lit(False)))
    distributed = _reason((grounded, "EXACT_MATCH"), (~grounded, "POLICY_RULE_NOT_APPLICABLE"), otherwise="SEMANTIC_SOURCE_UNFROZEN")
    recommendation = _reason((sure & overclaim, "GUARANTEE_OVERCLAIM"), otherwise="SEMANTIC_SOURCE_UNFROZEN")
    allowed = F.coalesce("allow_causal_claim", F.lit(False))
    causal = _reason(((col("causal_strength") == "causal") & ~allowed, "CAUSAL_OVERCLAIM"), (allowed, "EXACT_MATCH"), otherwise="POLICY_RULE_NOT_APPLICABLE")
    limitation = _reason(((col("claim_subtype") == "NO_CAUSALITY") & ~allowed, "EXACT_MATCH"), ((col("claim_subtype") == "NO_ADVICE") & ~F.coalesce("allow_financial_advice", F.lit(False)), "EXACT_MATCH"), otherwise="POLICY_RULE_NOT_APPLICABLE")
    by_type = dict(zip(TYPES, (prediction, feature_presence, feature_direction, concept_presence, concept_direction, numeric, ranking, magnitude, uncertainty, distributed, recommendation, causal, limitation), strict=True))
    reason = F.when(col("p_known").isNull(), "EVIDENCE_JOIN_FAILED").when(F.startswith("claim_subtype", F.lit("UNRESOLVED_")), "SEMANTIC_SUBTYPE_UNRESOLVED")
    for t, r in by_type.items():
        reason = reason.when(col("claim_type") == t, r)
    reason = reason.otherwise("UNSUPPORTED_CLAIM_TYPE")
    feature_state = _reason((~feature, "SOURCE_MISSING"), (col("f_shown").isNull(), "NOT_EXPOSED"), (F.array_contains("allowed_feature_ids", col("feature_id")), "EXPOSED_ALLOWED"), otherwise="EXPOSED_FORBIDDEN")
    concept_state = _reason((col("concept_id").isNull(), "SOURCE_MISSING"), (col("c_shown").isNull(), "NOT_EXPOSED"), (F.array_contains("allowed_concept_ids", col("concept_id")), "EXPOSED_ALLOWED"), otherwise="EXPOSED_FORBIDDEN")
    t = col("claim_type")
    state = F.when(t.isin("feature_presence", "feature_direction"), feature_state).when(t.isin("concept_presence", "concept_direction"), concept_state).when(t.isin("ranking", "magnitude"), F.when(feature, feature_state).otherwise(concept_state)).when((t == "numeric") & feature, feature_state).when((t == "numeric") & col("concept_id").isNotNull(), concept_state).otherwise("NOT_APPLICABLE")
    # the reasons are a table of fixed size; a join also keeps the long expression from being planned several times
    table = j.sparkSession.createDataFrame(list(REASONS), "reason_code string, reason_family string, validation_status string")
    out = j.withColumn("exposure_state", state).withColumn("reason_code", reason).select(*columns, "exposure_state", "reason_code")
    out = out.join(F.broadcast(table), "reason_code", "left")
    return out.withColumn("execution_status", F.when(col("validation_status").isNull(), "ERROR").otherwise("SUCCESS"))


def signature() -> Column:
    """A key that two claims share if they say the same: type, subtype, subject and what their type compares."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("-"))
    tail = F.when(F.col("claim_type").isin("feature_direction", "concept_direction", "prediction"), c("direction")).when(F.col("claim_type") == "magnitude", c("magnitude")).when(F.col("claim_type") == "numeric", F.concat_ws("|", c("numeric_role"), c("numeric_value"), c("numeric_unit"))).when(F.col("claim_type") == "causal", c("causal_strength")).otherwise(F.lit("-"))
    return F.concat_ws("|", c("claim_type"), c("claim_subtype"), c("feature_id"), c("concept_id"), tail)


def deduplicated(claims: DataFrame) -> DataFrame:
    """Of a generation's claims with one signature the first by local_claim_index, then claim_id; indices are made anew."""
    from .ranking import least_row
    from pyspark.sql import Window as W

    d = claims.withColumn("semantic_signature", signature())
    d = least_row(d, ["generation_id", "semantic_signature"], ["local_claim_index", "claim_id"])
    return d.withColumn("local_claim_index", F.row_number().over(W.partitionBy("generation_id").orderBy("local_claim_index", "claim_id")))


def demoted_causal(claims: DataFrame, causal_words: str) -> DataFrame:
    """A claim typed causal whose text has no causal wording becomes a direction claim of its subject."""
    weak = (F.col("claim_type") == "causal") & ~F.coalesce(F.col("source_text").rlike(causal_words), F.lit(False))
    kind = F.when(weak & F.col("feature_id").isNotNull(), "feature_direction").when(weak & F.col("concept_id").isNotNull(), "concept_direction").otherwise(F.col("claim_type"))
    return claims.withColumn("claim_type", kind)


def with_presence(claims: DataFrame) -> DataFrame:
    """A presence claim added for each subject that a direction or magnitude claim names, unless there is one."""
    subject = claims.where(F.col("claim_type").isin("feature_direction", "concept_direction", "magnitude") & (F.col("feature_id").isNotNull() | F.col("concept_id").isNotNull()))
    made = subject.withColumn("claim_type", F.when(F.col("feature_id").isNotNull(), "feature_presence").otherwise("concept_presence")).withColumn("claim_subtype", F.lit("DERIVED_PRESENCE"))
    made = made.withColumn("concept_id", F.when(F.col("claim_type") == "concept_presence", F.col("concept_id"))).dropDuplicates(["generation_id", "claim_type", "feature_id", "concept_id"])
    has = claims.where(F.col("claim_type").isin("feature_presence", "concept_presence")).select("generation_id", F.col("claim_type").alias("__t"), F.col("feature_id").alias("__f"), F.col("concept_id").alias("__c"))
    made = made.withColumn("claim_id", digest(F.col("claim_id"), F.lit("presence"))).withColumn("direction", F.lit(None).cast("string")).withColumn("magnitude", F.lit(None).cast("string"))
    on = (made["generation_id"] == has["generation_id"]) & (made["claim_type"] == has["__t"]) & made["feature_id"].eqNullSafe(has["__f"]) & made["concept_id"].eqNullSafe(has["__c"])
    return claims.unionByName(made.join(has, on, "left_anti"))


def compatibility(claims: DataFrame, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """``compatible``: the claim's type and subtype are a pair of the table."""
    spark = claims.sparkSession
    t = spark.createDataFrame(list(allowed), "claim_type string, claim_subtype string").withColumn("__ok", F.lit(True))
    return claims.join(F.broadcast(t), ["claim_type", "claim_subtype"], "left").withColumn("compatible", F.coalesce("__ok", F.lit(False))).drop("__ok")


def change_log(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``(key, change, changed)``: added, removed, changed (with the fields, joined by ``|``) or same, by full outer join."""
    a = before.select(key, *[F.col(f).alias(f"__a_{f}") for f in fields]).withColumn("__a", F.lit(True))
    b = after.select(key, *[F.col(f).alias(f"__b_{f}") for f in fields]).withColumn("__b", F.lit(True))
    j = a.join(b, key, "full_outer")
    diff = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"__a_{f}").eqNullSafe(F.col(f"__b_{f}")), F.lit(f)) for f in fields])), "|")
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(diff == "", "same").otherwise("changed")
    return j.select(key, kind.alias("change"), F.when(kind == "changed", diff).otherwise("").alias("changed"))


def reconciled(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claims without exactly one result, and results without claim: key, results, problem."""
    n = results.groupBy("claim_id").agg(F.count("*").alias("results"))
    j = claims.select("claim_id").distinct().withColumn("__c", F.lit(True)).join(n, "claim_id", "full_outer")
    problem = F.when(F.col("__c").isNull(), "unexpected").when(F.col("results").isNull(), "missing").when(F.col("results") > 1, "duplicate")
    return j.withColumn("problem", problem).where("problem is not null").select("claim_id", F.coalesce("results", F.lit(0)).alias("results"), "problem")
