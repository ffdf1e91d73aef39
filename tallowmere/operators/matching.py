"""Matching phrases with claims: candidates by key, the best pair of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where
from ..functions.texts import coverage, match_priority, pair_match, tokens
from ..session import staged


def candidates(claims: DataFrame, phrases: DataFrame) -> DataFrame:
    """Pairs of one package with one feature or one concept (missing ones never match), as a union of two equi-joins.

    ``claims(claim_id, package_id, feature_id, concept_id, text)``, ``phrases(item_id, package_id, feature_id,
    concept_id, item_order, text)``, with normalised texts.  A pair that matches by both counts once, by feature.
    """
    p = phrases.select(F.col("package_id").alias("__p"), F.col("feature_id").alias("__f"), F.col("concept_id").alias("__c"), "item_id", "item_order", F.col("text").alias("phrase"))
    keep = lambda d, by: d.select("claim_id", "text", "item_id", "item_order", "phrase", F.lit(by).alias("matched_by"))
    feature = keep(claims.join(p, (F.col("package_id") == F.col("__p")) & (F.col("feature_id") == F.col("__f"))), "feature")
    both = F.coalesce(F.col("feature_id") == F.col("__f"), F.lit(False))
    concept = keep(claims.join(p, (F.col("package_id") == F.col("__p")) & (F.col("concept_id") == F.col("__c"))).where(~both), "concept")
    return feature.unionByName(concept)


def best_matches(pairs: DataFrame) -> DataFrame:
    """For each claim the best phrase: EXACT before CONTAINED before HIGH_OVERLAP, then by coverage, order and id; ``NONE`` if none matches."""
    cov = coverage(tokens(F.col("text")), tokens(F.col("phrase")))
    d = pairs.withColumn("match_type", pair_match(F.col("text"), F.col("phrase"))).withColumn("coverage", cov)
    best = F.min(F.struct(match_priority(F.col("match_type")).alias("priority"), (-F.col("coverage")).alias("less"), "item_order", "item_id", "match_type"))
    g = d.groupBy("claim_id").agg(best.alias("b"), F.count("*").alias("candidates"))
    return g.select("claim_id", "candidates", F.col("b.match_type").alias("match_type"), F.col("b.item_id").alias("item_id"), (-F.col("b.less")).alias("coverage"))


def narrative_matches(parts: DataFrame) -> DataFrame:
    """By narrative: the largest coverage of its parts and whether any matches exactly or is contained."""
    return parts.groupBy("narrative_id").agg(F.max("coverage").alias("max_coverage"), F.bool_or(F.col("match_type") == "EXACT").alias("any_exact"), F.bool_or(F.col("match_type") == "CONTAINED").alias("any_contained"), F.count("*").alias("parts"))


def repeat_similarity(sets: DataFrame, group: str, repeat: str, items: str) -> DataFrame:
    """By group the pairs of repeats and their mean Jaccard similarity; a group's repeats are a handful."""
    from ..functions.numeric import jaccard

    a = sets.select(group, F.col(repeat).alias("__i"), F.col(items).alias("__a"))
    b = sets.select(group, F.col(repeat).alias("__j"), F.col(items).alias("__b"))
    j = a.join(b, group).where(F.col("__i") < F.col("__j"))
    return j.groupBy(group).agg(F.count("*").alias("pairs"), F.avg(jaccard(F.col("__a"), F.col("__b"))).alias("mean_jaccard"))


def evidence_mentions(outputs: DataFrame, items: DataFrame, ranks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Which of its package's evidence each output mentions: counts and rates of features and concepts, rates of the first ``ranks`` features, and valid and invalid declarations.

    ``outputs(output_id, package_id, text, declared_features, declared_concepts)``: ``text`` normalised, null where there is no output, which mentions
    and declares nothing.  ``items(package_id, item_order, feature_id, aliases, concept_id, concept_aliases)``: a package's items are a few dozen and
    become one row; aliases are normalised, those under three characters don't count.  A feature or concept is mentioned if the output
    declares it or contains an alias.  Rates of nothing are missing; an output without a package has counts of 0.
    The packages are stored first, so that Spark knows their size: small ones go to where the outputs lie, and for large ones it splits a package with very many outputs.
    """
    item = F.struct("item_order", "feature_id", "aliases", "concept_id", "concept_aliases")
    p = staged(items.groupBy("package_id").agg(F.array_sort(F.collect_list(item)).alias("__items")))
    o = outputs.join(p, "package_id", "left").withColumn("__items", F.coalesce("__items", F.array().cast(p.schema["__items"].dataType)))
    some = lambda c: F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False))))
    spoken = F.col("text").isNotNull()
    o = o.withColumns({c: F.when(spoken, some(F.col(c))).otherwise(F.array().cast("array<string>")) for c in ("declared_features", "declared_concepts")})
    stands = lambda xs: F.exists(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.coalesce((F.length(x) >= 3) & F.col("text").contains(x), F.lit(False)))
    has = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    o = o.withColumn("__seen", F.transform("__items", lambda x: spoken & (has(F.col("declared_features"), x["feature_id"]) | stands(x["aliases"]))))
    concepts = some(F.transform("__items", lambda x: x["concept_id"]))
    o = o.withColumn("__concepts", concepts)
    spells = lambda k: F.exists("__items", lambda x: (x["concept_id"] == k) & stands(x["concept_aliases"]))
    o = o.withColumn("__known", F.filter("__concepts", lambda k: spoken & (has(F.col("declared_concepts"), k) | F.coalesce(spells(k), F.lit(False)))))
    n, k = F.size("__items"), F.size("__concepts")
    hits = lambda xs: F.size(F.filter(xs, lambda b: b))
    rate = lambda a, b: F.when(b > 0, a / b)
    out = {"selected_features": n, "mentioned_features": hits(F.col("__seen")), "feature_mention_rate": rate(hits(F.col("__seen")), n)}
    out |= {f"top{r}_mention_rate": rate(hits(F.slice("__seen", 1, r)), F.least(n, F.lit(r))) for r in ranks}
    out |= {"exposed_concepts": k, "mentioned_concepts": F.size("__known"), "concept_mention_rate": rate(F.size("__known"), k)}
    allowed = {"features": some(F.transform("__items", lambda x: x["feature_id"])), "concepts": F.col("__concepts")}
    for what, ids in allowed.items():
        declared = F.col(f"declared_{what}")
        valid = F.size(F.array_intersect(declared, ids))
        out |= {f"n_declared_{what}": F.size(declared), f"valid_{what}": valid, f"invalid_{what}": F.size(declared) - valid}
    return o.select("output_id", "package_id", *[c.alias(name) for name, c in out.items()])


def repeat_stability(repeats: DataFrame, by: Sequence[str], repeat: str) -> DataFrame:
    """By group: repeats, usable ones, share with a valid schema, deviation (n) of the usable ones' lengths and factor counts, and the mean Jaccard similarity of
    the features and concepts of all pairs of usable repeats.

    ``repeats`` has ``usable``, ``schema_valid``, ``length``, ``factors``, ``features`` and ``concepts`` (arrays); a group's repeats are a handful.
    Without a usable repeat the deviations are missing, with one the similarities.
    """
    ok = F.coalesce(F.col("usable"), F.lit(False))
    g = repeats.groupBy(*by).agg(
        F.count("*").alias("repeats"), count_where(ok).alias("usable_repeats"), (count_where(F.col("schema_valid")) / F.count("*")).alias("schema_stability_rate"),
        F.stddev_pop(F.when(ok, F.col("length"))).alias("length_sd"), F.stddev_pop(F.when(ok, F.col("factors"))).alias("factors_sd"),
    )
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    usable, g = repeats.where(ok).withColumn("__g", key), g.withColumn("__g", key)
    for what in ("features", "concepts"):
        g = g.join(repeat_similarity(usable, "__g", repeat, what).select("__g", F.col("mean_jaccard").alias(f"{what}_jaccard")), "__g", "left")
    return g.drop("__g")
