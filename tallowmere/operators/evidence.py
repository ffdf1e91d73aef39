"""Evidence: attributions ranked, summed by concept, selected by coverage, and packed by level."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import count_where, direction, entropy_term
from .ranking import slices, until_share

NO_CONCEPT = "unknown_feature_group"


@dataclass(frozen=True)
class Level:
    """How a level selects: none, the top k, or the least coverage between two numbers of features."""

    name: str
    mode: str
    k: int = 0
    share: float = 0.0
    least: int = 0
    most: int = 0
    groups: bool = False
    skeleton: bool = False


#: The six levels.
LEVELS = (
    Level("S0", "none"),
    Level("S1", "top", k=10),
    Level("S2", "top", k=10),
    Level("S3", "adaptive", share=0.60, least=3, most=10),
    Level("S4", "adaptive", share=0.70, least=5, most=20, groups=True),
    Level("S5", "adaptive", share=0.70, least=5, most=20, groups=True, skeleton=True),
)
#: Factors of the first and second tier.
PRIMARY, SUPPORTING = 8, 12


#: From these sizes on an attribution is strong, or moderate.
STRONG, MODERATE = 0.10, 0.03


def strength(size: Column) -> Column:
    """strong, moderate or weak by the size of an attribution; a missing one is weak."""
    return F.when(size >= STRONG, "strong").when(size >= MODERATE, "moderate").otherwise("weak")


def local_rows(cases: DataFrame, key: str, features: str = "features", values: str = "values") -> DataFrame:
    """``(key, feature_id, shap_value, abs_shap_value, rank, direction)`` from two arrays of one length."""
    d = cases.select(key, F.explode(F.arrays_zip(features, values)).alias("z")).select(key, F.col(f"z.{features}").alias("feature_id"), F.col(f"z.{values}").alias("shap_value"))
    return ranked_local(d, key)


def ranked_local(local: DataFrame, key: str) -> DataFrame:
    """abs_shap_value, rank (1 is the strongest, ties by feature_id) and direction added."""
    d = local.withColumn("abs_shap_value", F.abs("shap_value"))
    order = W.partitionBy(key).orderBy(F.desc("abs_shap_value"), "feature_id")
    return d.withColumn("rank", F.row_number().over(order)).withColumn("direction", direction(F.col("shap_value")))


def top_coverage(local: DataFrame, key: str, ks: Sequence[int] = (3, 5, 10, 20)) -> DataFrame:
    """The share of a case's mass that its k strongest features hold, for each k; 0 without mass."""
    m, total = F.col("abs_shap_value"), F.sum("abs_shap_value")
    share = lambda k: F.when(total > 0, F.sum(F.when(F.col("rank") <= k, m).otherwise(0.0)) / total).otherwise(0.0)
    return local.groupBy(key).agg(F.count("*").alias("features"), total.alias("mass"), *[share(k).alias(f"top{k}_coverage") for k in ks])


def adaptive(local: DataFrame, key: str, share: float, least: int, most: int) -> DataFrame:
    return until_share(local, key, F.col("abs_shap_value"), [F.desc("abs_shap_value"), F.asc("feature_id")], share, least, most)


def normalized_entropy(local: DataFrame, key: str) -> DataFrame:
    """entropy of a case's shares over the log of their number, and its level; 0 for one feature or none with mass."""
    whole = F.sum("abs_shap_value").over(W.partitionBy(key))
    d = local.withColumn("__p", F.when(whole > 0, F.col("abs_shap_value") / whole))
    n = F.count("*")
    e = F.when(n > 1, F.coalesce(F.sum(entropy_term(F.col("__p"))), F.lit(0.0)) / F.ln(F.greatest(n, F.lit(2)))).otherwise(0.0)
    g = d.groupBy(key).agg(n.alias("features"), e.alias("entropy"))
    return g.withColumn("level", F.when(F.col("entropy") < 0.5, "concentrated").when(F.col("entropy") < 0.8, "moderate").otherwise("distributed"))


def concept_summary(local: DataFrame, key: str) -> DataFrame:
    """By case and concept: features, net, mass, positive, negative and neutral counts, mixed, top_features (three strongest), representative."""
    d = local.withColumn("concept", F.coalesce("concept", F.lit(NO_CONCEPT)))
    pos, neg = count_where(F.col("direction") == "increases"), count_where(F.col("direction") == "decreases")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("abs_shap_value")).alias("m"), "feature_id")))
    return d.groupBy(key, "concept").agg(
        F.count("*").alias("features"), F.sum("shap_value").alias("net"), F.sum("abs_shap_value").alias("mass"), pos.alias("positive"), neg.alias("negative"),
        count_where(F.col("direction") == "neutral").alias("neutral"), ((pos > 0) & (neg > 0)).alias("mixed"),
        F.array_join(F.slice(ordered["feature_id"], 1, 3), "|").alias("top_features"), ordered[0]["feature_id"].alias("representative"),
    )


def concept_groups(local: DataFrame, key: str) -> DataFrame:
    """By case, concept and direction: members (strongest first), representative, mass; ``mixed_concept`` where a concept has several directions."""
    d = local.withColumn("concept", F.coalesce("concept", F.lit(NO_CONCEPT)))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("abs_shap_value")).alias("m"), "feature_id")))
    g = d.groupBy(key, "concept", "direction").agg(F.count("*").alias("features"), F.sum("abs_shap_value").alias("mass"), F.array_join(ordered["feature_id"], "|").alias("members"), ordered[0]["feature_id"].alias("representative"))
    return g.withColumn("mixed_concept", F.count("*").over(W.partitionBy(key, "concept")) > 1)


def accounting(local: DataFrame, key: str) -> DataFrame:
    """tier (primary, supporting, background), the tier's mass and its share of the case's, in rank order."""
    d = local.withColumn("tier", F.when(F.col("rank") <= PRIMARY, "primary").when(F.col("rank") <= PRIMARY + SUPPORTING, "supporting").otherwise("background"))
    g = d.groupBy(key, "tier").agg(F.count("*").alias("features"), F.sum("abs_shap_value").alias("mass"))
    whole = F.sum("mass").over(W.partitionBy(key))
    return g.withColumn("share", F.when(whole > 0, F.col("mass") / whole).otherwise(0.0))


def packages(local: DataFrame, key: str, levels: Sequence[Level] = LEVELS) -> DataFrame:
    """What each level selects of a case; S0 selects nothing.

    ``(key, evidence_level, selected, coverage, features, target_met, entropy, concept_groups, mixed_concepts,
    skeleton)``: ``target_met`` where a level aims at a share of the mass; the normalised entropy of all of the case's
    features, the number of groups of concept and direction among the selected ones, and how many concepts have several
    directions, for levels with groups; for levels with a skeleton the strongest feature of each group, the
    five strongest of these, joined by ``|`` in their order.  ``local`` is ranked (see :func:`ranked_local`), with
    ``concept``.  Ranks and running mass are made once, each row goes to the levels that select it, and all
    sums stay in the partitions of the cases.
    """
    w = W.partitionBy(key)
    m = F.col("abs_shap_value")
    whole, n = F.sum(m).over(w), F.count("*").over(w)
    d = local.withColumn("__w", whole).withColumn("__n", n).withColumn("__c", F.sum(m).over(w.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    spread = F.sum(entropy_term(F.when(F.col("__w") > 0, m / F.col("__w")))).over(w)
    d = d.withColumn("__e", F.when(F.col("__n") > 1, F.coalesce(spread, F.lit(0.0)) / F.ln(F.greatest("__n", F.lit(2)))).otherwise(0.0))
    chosen = []
    for lv in levels:
        if lv.mode == "none":
            hit = F.col("rank") == 1  # so that the case has a row, which counts for nothing
        elif lv.mode == "top":
            hit = F.col("rank") <= lv.k
        else:
            hit = ((F.col("__c") - m < lv.share * F.col("__w")) | (F.col("rank") <= lv.least)) & (F.col("rank") <= lv.most)
        chosen.append(F.when(hit, F.lit(lv.name)))
    rows = d.withColumn("evidence_level", F.explode(F.array_compact(F.array(*chosen)))).withColumn("concept", F.coalesce("concept", F.lit(NO_CONCEPT)))
    place = F.struct("rank", "feature_id")
    case = [F.max(f"__{c}").alias(f"__{c}") for c in "we"]
    g = rows.groupBy(key, "evidence_level", "concept", "direction").agg(F.count("*").alias("n"), F.sum(m).alias("m"), F.min(place).alias("first"), F.collect_list(place).alias("all"), *case)
    g = g.groupBy(key, "evidence_level", "concept").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("ways"), F.collect_list("first").alias("firsts"), F.flatten(F.collect_list("all")).alias("all"), *case)
    g = g.groupBy(key, "evidence_level").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("ways").alias("groups"), count_where(F.col("ways") > 1).alias("mixed"),
        F.array_sort(F.flatten(F.collect_list("firsts"))).alias("firsts"), F.array_sort(F.flatten(F.collect_list("all"))).alias("all"), *case,
    )
    named = lambda cond: F.col("evidence_level").isin(*[lv.name for lv in levels if cond(lv)])
    some, grouped = ~named(lambda lv: lv.mode == "none"), named(lambda lv: lv.groups)
    share = F.when(some & (F.col("__w") > 0), F.col("m") / F.col("__w")).otherwise(0.0)
    aim = F.coalesce(*[F.when(F.col("evidence_level") == lv.name, lv.share) for lv in levels if lv.mode == "adaptive"], F.lit(None).cast("double"))
    return g.select(
        key, "evidence_level", F.when(some, F.col("n")).otherwise(0).alias("selected"), share.alias("coverage"), F.when(some, F.array_join("all.feature_id", "|")).otherwise("").alias("features"),
        (share >= aim).alias("target_met"), F.when(grouped, F.col("__e")).alias("entropy"), F.when(grouped, F.col("groups")).alias("concept_groups"), F.when(grouped, F.col("mixed")).alias("mixed_concepts"),
        F.when(named(lambda lv: lv.skeleton), F.array_join(F.slice(F.col("firsts.feature_id"), 1, 5), "|")).alias("skeleton"),
    )


def readiness(probability: Column, features: Column, additivity_error: Column, missing_concepts: Column) -> Column:
    """ready, ready_with_warnings or not_ready for explanation."""
    bad = probability.isNull() | (features == 0) | (F.abs(additivity_error) > 1e-3)
    return F.when(F.coalesce(bad, F.lit(True)), "not_ready").when((missing_concepts > 0) | (features < 5), "ready_with_warnings").otherwise("ready")


def difficulty(distance: Column, entropy: Column, mixed_share: Column, features_for_share: Column) -> Column:
    """A weighted sum of capped terms, 0 to 1: near the threshold, spread out, of mixed concepts, with many features for the share."""
    near = 1 - F.least(F.abs(distance) / 0.25, F.lit(1.0))
    return 0.35 * near + 0.30 * F.least(entropy, F.lit(1.0)) + 0.20 * F.least(mixed_share, F.lit(1.0)) + 0.15 * F.least(features_for_share / 20.0, F.lit(1.0))


def balanced_subset(cases: DataFrame, stratum: str, difficulty_column: str, key: str, n: int = 2) -> DataFrame:
    """Of each stratum the n easiest, n in the middle and n hardest cases."""
    return slices(cases, stratum, [F.asc(difficulty_column), F.asc(key)], n)


def truth_conditions(rules: Sequence[tuple[str, str, str, object]], facts: DataFrame) -> DataFrame:
    """``allowed`` claims of each row of ``facts``: rules are (claim, field, operator, value) with =, !=, >=, <= or in."""
    ops = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "in": lambda c, v: c.isin(*v)}
    allowed = F.array_compact(F.array(*[F.when(F.coalesce(ops[op](F.col(f), v), F.lit(False)), F.lit(claim)) for claim, f, op, v in rules]))
    forbidden = F.array_compact(F.array(*[F.when(~F.coalesce(ops[op](F.col(f), v), F.lit(False)), F.lit(claim)) for claim, f, op, v in rules]))
    return facts.withColumn("allowed_claims", allowed).withColumn("forbidden_claims", forbidden)
