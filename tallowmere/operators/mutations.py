"""How sensitive a validator is: claims changed in a known way must change their verdict.

Mutations are data. A claim is validated as it is, where it is supported once more for each mutation that applies to it, and
the verdicts of a claim's mutants are compared with its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mutation:
    """``when`` (an SQL condition) says to which claims it applies, ``changes`` what becomes of their fields (SQL), ``caught`` which verdicts mean that it was noticed."""

    name: str
    when: str
    changes: Mapping[str, str] = field(default_factory=dict)
    caught: tuple[str, ...] = ("CONTRADICTED", "UNSUPPORTED")


def mutated(claims: DataFrame, mutations: Sequence[Mutation], key: str = "claim_id", own: bool = True) -> DataFrame:
    """``claims`` (unless not ``own``) and their mutants: ``mutation`` names what was changed (NULL: nothing), ``__of`` the claim that it comes from; keys stay unique.

    Only the key and what some mutation changes come once for each mutant; all else stays the claim's.
    """
    moved = [c for c in claims.columns if c != key and any(c in m.changes for m in mutations)]

    def row(m: Mutation | None) -> F.Column:
        changes = m.changes if m else {}
        fields = [F.expr(changes[c]).cast(claims.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in moved]
        name = F.concat(F.col(key).cast("string"), F.lit(f"#{m.name}" if m else ""))
        return F.struct(F.lit(m.name if m else None).cast("string").alias("mutation"), F.col(key).cast("string").alias("__of"), name.alias(key), *fields)

    each = [row(None)] * own + [F.when(F.expr(m.when), row(m)) for m in mutations]
    rest = [c for c in claims.columns if c != key and c not in moved]
    return claims.select(F.explode(F.array_compact(F.array(*each))).alias("__r"), *rest).select("__r.*", *rest)


def sensitivity(claims: DataFrame, mutations: Sequence[Mutation], validate: Callable[[DataFrame], DataFrame], status: str = "validation_status", key: str = "claim_id") -> DataFrame:
    """``(mutation, mutants, caught, changed, rate)``: how many supported claims were changed, how many of these were caught, and how many verdicts changed.

    ``validate`` adds ``status`` to claims, row by row, and keeps their columns.  Only mutants of claims that were SUPPORTED count, so only these are changed, each in its
    row; a mutation that no such claim has gets zeros and no rate.  ``validate`` is applied to the claims and again to the mutants: let claims
    meet what they are judged by before, so that they are dealt as they are and no mutant ever is.
    """
    as_it_is = claims.withColumns({"mutation": F.lit(None).cast("string"), "__of": F.col(key).cast("string")})
    supported = validate(as_it_is).where(F.col(status) == "SUPPORTED").select(*claims.columns)
    v = validate(mutated(supported, mutations, key, own=False)).select("mutation", F.col(status).alias("verdict"))
    seen = v.groupBy("mutation", "verdict").agg(F.count("*").alias("n"))  # a few rows; mutations would be so many tasks
    table = claims.sparkSession.createDataFrame([(x.name, list(x.caught)) for x in mutations], "mutation string, __caught array<string>")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    hit = F.array_contains("__caught", F.col("verdict"))
    out = table.join(seen, "mutation", "left").groupBy("mutation").agg(n(F.col("verdict").isNotNull()).alias("mutants"), n(hit).alias("caught"), n(F.col("verdict") != "SUPPORTED").alias("changed"))
    return out.withColumn("rate", F.when(F.col("mutants") > 0, F.col("caught") / F.col("mutants")))
