"""Grouped summaries in long form, pivots, modes and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, ratio
from .quantiles import with_quantiles


def numeric_summary(value: str) -> dict[str, Column]:
    """planned, observed, missing, mean, sd (n - 1), minimum and maximum; :data:`QUARTILES` go with them."""
    v = F.col(value)
    return {"planned": F.count("*"), "observed": F.count(v), "missing": F.count("*") - F.count(v), "mean": F.avg(v), "sd": F.stddev_samp(v), "minimum": F.min(v), "maximum": F.max(v)}


#: Linear quantiles of a summary.
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def grouping_sets(df: DataFrame, sets: dict[str, Sequence[str]], measures: dict[str, Column], value: str | None = None, shares: dict[str, float] = QUARTILES) -> DataFrame:
    """The measures for several groupings in one pass: ``group_type`` names the set, columns that a set lacks are NULL.

    ``sets`` maps a name to its columns; a null in the data is a group of its own in the sets that use the
    column.  With a ``value`` its quantiles for ``shares`` are added, from a row of each set for each distinct row.
    """
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    bits = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): n for n, s in sets.items()}
    g = df.groupingSets([[F.col(c) for c in s] for s in sets.values()], *[F.col(c) for c in columns])
    named = F.create_map(*[x for b, n in bits.items() for x in (F.lit(b).cast("long"), F.lit(n))])
    out = g.agg(F.grouping_id().alias("__g"), *[m.alias(n) for n, m in measures.items()])
    out = out.withColumn("group_type", named[F.col("__g")]).drop("__g")
    if value is None:
        return out
    kind = dict(df.select(*columns).dtypes)
    each = [F.struct(F.lit(n).alias("group_type"), *[(F.col(c) if c in s else F.lit(None).cast(kind[c])).alias(c) for c in columns]) for n, s in sets.items()]
    # equal rows are counted before each count becomes one of every set
    counts = df.where(F.col(value).isNotNull()).groupBy(*columns, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    rows = counts.select(F.explode(F.array(*each)).alias("__s"), "__value", "__n").select("__s.*", "__value", "__n")
    return with_quantiles(out, rows, ["group_type", *columns], "__value", shares, times="__n")


def pivot_counts(df: DataFrame, by: Sequence[str], column: str, values: Sequence[str], prefix: str = "") -> DataFrame:
    """Rows of each value as columns, 0 where there is none; values not listed are left out."""
    return df.groupBy(*by).agg(*[count_where(F.col(column) == v).alias(f"{prefix}{v}") for v in values])


def mode(df: DataFrame, by: Sequence[str], value: str, name: str = "dominant") -> DataFrame:
    """The most frequent value of each group (of equally frequent ones the least) and its count; nulls don't count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    best = n.groupBy(*by).agg(F.min(F.struct(-F.col("__n"), F.col(value))).alias("__b"))
    return best.select(*by, F.col("__b")[value].alias(name), (-F.col("__b").getField("col1")).alias("count"))


def counts_by(df: DataFrame, column: str, others: str = "none") -> DataFrame:
    """value and count, a null counted as ``others``."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(others)).alias("value")).agg(F.count("*").alias("count"))


def claim_summary(status: str = "status") -> dict[str, Column]:
    """Counts of the five statuses and the ratios of supported claims to resolved, to applicable and to all."""
    is_ = lambda s: count_where(F.col(status) == s)
    s, u, c, v, n = is_("SUPPORTED"), is_("UNSUPPORTED"), is_("CONTRADICTED"), is_("NOT_VERIFIABLE"), is_("NOT_APPLICABLE")
    return {
        "claims": F.count("*"), "supported": s, "unsupported": u, "contradicted": c, "not_verifiable": v, "not_applicable": n,
        "faithfulness": ratio(s, s + u + c), "verifiability": ratio(s + u + c, s + u + c + v), "conservative": ratio(s, s + u + c + v),
    }


def validation_summary(generations: DataFrame, results: DataFrame) -> DataFrame:
    """Every generation with the counts of its claims' results; unusable ones stay, without claims, with their reasons.

    ``generations(generation_id, ..., usable, unusable_reasons)``; ``results(generation_id, validation_status, execution_status, reason_family, hard_safety)``.
    ``families`` counts the results by reason family, as a map in the order of names.
    """
    is_ = lambda s: count_where(F.col("validation_status") == s)
    names = ("SUPPORTED", "UNSUPPORTED", "CONTRADICTED", "NOT_VERIFIABLE", "NOT_APPLICABLE")
    by = results.groupBy("generation_id", F.coalesce("reason_family", F.lit("NONE")).alias("family")).agg(
        F.count("*").alias("total_claims"), *[is_(s).alias(f"{s.lower()}_count") for s in names], count_where(F.col("execution_status") == "ERROR").alias("execution_error_count"), count_where(F.col("hard_safety")).alias("hard_safety_count"),
    )
    counts = [c for c in by.columns if c not in ("generation_id", "family")]
    g = by.groupBy("generation_id").agg(*[F.sum(c).alias(c) for c in counts], F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "total_claims")))).alias("families"))
    j = generations.join(g, "generation_id", "left")
    own = [F.when(F.col("usable"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).alias(c) for c in counts]
    kept = [c for c in generations.columns if c != "unusable_reasons"]
    reason = F.when(~F.col("usable"), F.array_join("unusable_reasons", "|"))
    return j.select(*kept, *own, F.when(F.col("usable"), F.coalesce("families", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))).alias("families"), reason.alias("failure_reason"))


def design_summary(packages: DataFrame, items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Evidence packages as they were designed: by package counts of items, features, concepts, allowed ones and those outside the contract, then means by group.

    ``items(package_id, item_type, feature_id, concept_id, allowed, out_of_contract, abs_shap_value)``; distinct ids are counted from (package, id) rows.
    A package without items counts with zeros.
    """
    i = items.groupBy("package_id").agg(
        F.count("*").alias("items"), count_where(F.col("item_type") == "feature").alias("feature_items"), count_where(F.col("item_type") == "concept").alias("concept_items"),
        count_where(F.col("allowed")).alias("allowed_items"), count_where(F.col("out_of_contract")).alias("out_of_contract_items"), F.sum("abs_shap_value").alias("shap_sum"), F.max("abs_shap_value").alias("shap_max"),
    )
    ids = items.select("package_id", F.explode(F.array(F.struct(F.lit("f").alias("k"), F.col("feature_id").cast("string").alias("v")), F.struct(F.lit("c").alias("k"), F.col("concept_id").cast("string").alias("v")))).alias("x")).where("x.v is not null").groupBy("package_id", "x").agg(F.lit(1).alias("one"))
    d = ids.groupBy("package_id").agg(count_where(F.col("x.k") == "f").alias("distinct_features"), count_where(F.col("x.k") == "c").alias("distinct_concepts"))
    j = packages.join(i, "package_id", "left").join(d, "package_id", "left")
    counts = ["items", "feature_items", "concept_items", "allowed_items", "out_of_contract_items", "distinct_features", "distinct_concepts"]
    j = j.fillna(0, counts)
    return j.groupBy(*by).agg(F.count("*").alias("packages"), *[F.avg(c).alias(f"mean_{c}") for c in counts], F.avg("shap_sum").alias("mean_shap_sum"), F.max("shap_max").alias("max_shap"))


def claim_group_summary(status: str, match: str, eligible: Column, exposed: Column) -> dict[str, Column]:
    """Counts and rates of a group of claims: by status, and by the best match of those claims that could match a phrase."""
    is_ = lambda s: count_where(F.col(status) == s)
    s, u, c, v, n = is_("SUPPORTED"), is_("UNSUPPORTED"), is_("CONTRADICTED"), is_("NOT_VERIFIABLE"), is_("NOT_APPLICABLE")
    resolved, applicable, could = s + u + c, s + u + c + v, count_where(eligible)
    out = {
        "claims": F.count("*"), "applicable": applicable, "resolved": resolved, "supported": s, "not_verifiable": v, "unsupported": u, "contradicted": c, "not_applicable": n,
        "resolved_faithfulness": ratio(s, resolved), "verifiability": ratio(resolved, applicable), "conservative_faithfulness": ratio(s, applicable),
        "not_verifiable_rate": ratio(v, applicable), "unsupported_rate": ratio(u, applicable), "contradiction_rate": ratio(c, applicable), "resolved_error_rate": ratio(u + c, resolved),
        "exposed": count_where(exposed), "eligible": could, "matched_rate": ratio(count_where(eligible & (F.col(match) != "NONE")), could),
    }
    for kind in ("EXACT", "CONTAINED", "HIGH_OVERLAP", "NONE"):
        k = count_where(eligible & (F.coalesce(F.col(match), F.lit("NONE")) == kind))
        out |= {f"best_{kind.lower()}": k, f"best_{kind.lower()}_rate": ratio(k, could)}
    return out


def generation_group_summary(losses: Sequence[str] = ("yield_share", "pipeline_loss", "not_verifiable_loss", "unsupported_loss", "contradiction_loss")) -> dict[str, Column]:
    """Of a group of planned generations: how many, how many usable, and the means of the losses, of resolved errors and of all losses."""
    usable = count_where(F.col("usable"))
    out = {"planned": F.count("*"), "usable": usable, "unusable": F.count("*") - usable, "usability_rate": ratio(usable, F.count("*"))}
    out |= {f"mean_{c}": F.avg(c) for c in losses}
    error = F.col("unsupported_loss") + F.col("contradiction_loss")
    return out | {"mean_resolved_error_loss": F.avg(error), "mean_claim_quality_loss": F.avg(error + F.col("not_verifiable_loss")), "mean_total_loss": F.avg(1 - F.col("yield_share")), "mean_claims": F.avg("claim_count")}


def macro_micro(df: DataFrame, by: Sequence[str], top: str, bottom: str) -> DataFrame:
    """macro: the mean of the rows' ratios; micro: the ratio of their sums; p10: the rows' tenth percentile."""
    r = ratio(F.col(top), F.col(bottom))
    d = df.withColumn("__r", r)
    g = d.groupBy(*by).agg(F.avg("__r").alias("macro"), ratio(F.sum(top), F.sum(bottom)).alias("micro"), F.count("*").alias("rows"))
    return with_quantiles(g, d, by, "__r", {"p10": 0.1})


def latency_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """By group the mean and the nearest-rank percentiles p50, p95 and p99."""
    return with_quantiles(df.groupBy(*by).agg(F.avg(value).alias("mean")), df, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, discrete=True)
