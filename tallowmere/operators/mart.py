"""A star of facts and dimensions: enrichment with indicators, claims by generation, facts flattened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where
from .checks import unique_key

STATUSES = ("SUPPORTED", "UNSUPPORTED", "CONTRADICTED", "NOT_VERIFIABLE", "NOT_APPLICABLE")


def enriched(facts: DataFrame, dimensions: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """``facts`` with the columns of each dimension and ``<name>_found``, whether there was a row for the fact.

    ``dimensions`` are (name, rows, key); the key is a column of both sides and unique in the dimension, else the
    result is an error when computed.  No fact is lost or repeated.
    """
    for name, d, key in dimensions:
        d = unique_key(d, [key], f"the key of {name}").withColumn(f"{name}_found", F.lit(True))
        facts = facts.join(d, key, "left").withColumn(f"{name}_found", F.coalesce(f"{name}_found", F.lit(False)))
    return facts


def claim_flags(status: Column, reason: Column | None = None) -> dict[str, Column]:
    """0/1 flags of a claim: a flag for each status, resolved, applicable, and with a reason semantic_unresolved and policy_violation."""
    is_ = lambda *s: F.coalesce(status.isin(*s), F.lit(False)).cast("int")
    out = {f"is_{s.lower()}": is_(s) for s in STATUSES}
    out |= {"is_resolved": is_(*STATUSES[:3]), "is_applicable": is_(*STATUSES[:4])}
    if reason is not None:
        out["is_semantic_unresolved"] = F.coalesce(reason.isin("SEMANTIC_SOURCE_UNFROZEN", "SEMANTIC_SUBTYPE_UNRESOLVED"), F.lit(False)).cast("int")
        out["is_policy_violation"] = F.coalesce(reason.isin("CAUSAL_OVERCLAIM", "GUARANTEE_OVERCLAIM", "CERTAINTY_OVERCLAIM"), F.lit(False)).cast("int")
    return out


def claim_counts(claims: DataFrame, by: str, types: Sequence[str], status: str = "validation_status", reason: str = "reason_code") -> DataFrame:
    """By generation the number of claims, of each flag of :func:`claim_flags`, of types, and of claims of each type."""
    flags = claim_flags(F.col(status), F.col(reason))
    # types are few and known: their number is that of the counts above 0, without a distinct count
    each = {k: count_where(F.col("claim_type") == k) for k in types}
    some = [F.when(c > 0, 1).otherwise(0) for c in each.values()]
    total = some[0]
    for s in some[1:]:
        total = total + s
    named = {k.removeprefix("is_") + "_count": F.sum(v) for k, v in flags.items()}
    return claims.groupBy(by).agg(F.count("*").alias("claim_count"), *[v.alias(k) for k, v in named.items()], total.alias("claim_type_count"), *[c.alias(f"{k}_claim_count") for k, c in each.items()])


def flattened(results: DataFrame, structs: Sequence[str] = ("expected", "observed")) -> DataFrame:
    """Each field of the structs as a column ``<struct>_<field>``, in the place of the struct."""
    out = []
    for f in results.schema.fields:
        if f.name in structs:
            out += [F.col(f.name)[x.name].alias(f"{f.name}_{x.name}") for x in f.dataType.fields]
        else:
            out.append(F.col(f.name))
    return results.select(*out)
