"""Raw columns under a policy, and feature matrices joined with guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean
from .checks import unique_key


@dataclass(frozen=True)
class Policy:
    """What a raw column may hold: ``kind`` is numeric, binary, categorical or categorical_regex."""

    kind: str
    missing: tuple[str, ...] = ()
    least: float | None = None
    above: float | None = None
    most: float | None = None
    mapping: Mapping[str, int] = field(default_factory=dict)
    allowed: tuple[str, ...] = ()
    pattern: str = ""


def violations(raw: Column, p: Policy) -> Column:
    """Why a raw value breaks its policy; NULL if it does not."""
    v = F.trim(raw.cast("string"))
    there = v.isNotNull() & ~F.coalesce(v.isin(*p.missing), F.lit(False)) if p.missing else v.isNotNull()
    if p.kind == "numeric":
        x = v.try_cast("double")
        why = F.when(x.isNull() | F.isnan(x), "not a number")
        for bound, bad, name in ((p.least, lambda b: x < b, "below the minimum"), (p.above, lambda b: x <= b, "at or below the exclusive minimum"), (p.most, lambda b: x > b, "above the maximum")):
            if bound is not None:
                why = why.when(bad(bound), name)
    elif p.kind == "binary":
        why = F.when(~v.isin(*p.mapping), "not in the mapping")
    elif p.kind == "categorical":
        why = F.when(~v.isin(*p.allowed), "not allowed")
    elif p.kind == "categorical_regex":
        why = F.when(~v.rlike(f"^(?:{p.pattern})\\z"), "not of the pattern")
    else:
        raise ValueError(f"unsupported kind {p.kind!r}")
    return F.when(there, why)


def normalised(raw: Column, name: str, p: Policy) -> Column:
    """The value under its policy: missing tokens are missing, numbers and mapped values doubles, categories trimmed texts.

    It fails closed: a value outside of the policy raises an error when it is computed.
    """
    why = violations(raw, p)
    v = F.trim(raw.cast("string"))
    there = ~F.coalesce(v.isin(*p.missing), F.lit(False)) if p.missing else F.lit(True)
    if p.kind == "numeric":
        out = v.try_cast("double")
    elif p.kind == "binary":
        out = F.create_map(*[F.lit(x) for k, n in p.mapping.items() for x in (k, float(n))])[v]
    else:
        out = v
    return F.when(why.isNotNull(), F.raise_error(F.concat(F.lit(f"{name}: "), why, F.lit(": "), v)).cast("double" if p.kind in ("numeric", "binary") else "string")).when(there, out)


def feature_matrix(spine: DataFrame, key: str, groups: Mapping[str, DataFrame]) -> DataFrame:
    """``spine`` with the columns of every group of features, joined by ``key``; infinite and NaN numbers are missing.

    Two groups with a column of one name are an error at once; a key that a group or the spine has twice, by which rows
    would multiply, is an error when the matrix is computed.
    """
    used, out = set(spine.columns), unique_key(spine, [key], "the spine's key")
    for name, g in groups.items():
        new = [c for c in g.columns if c != key]
        if both := sorted(used & set(new)):
            raise ValueError(f"columns of {name} that an earlier group has: {both}")
        used |= set(new)
        real = {f.name for f in g.schema.fields if f.dataType.typeName() in ("double", "float")}
        g = g.select(key, *[clean(F.col(c)).alias(c) if c in real else F.col(c) for c in new])
        out = out.join(unique_key(g, [key], f"the key of {name}"), key, "left")
    return out


def aligned(x: DataFrame, y: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``x`` and ``y`` side by side; a row that only one side has, or a key that repeats, is an error when computed."""
    a = unique_key(x, keys, "the key of the features").withColumn("__x", F.lit(True))
    b = unique_key(y, keys, "the key of the target").withColumn("__y", F.lit(True))
    j = a.join(b, list(keys), "full_outer")
    ok = F.when(F.col("__x") & F.col("__y"), F.lit(True)).otherwise(F.raise_error(F.lit("features and target have different rows")).cast("boolean"))
    return j.where(ok).drop("__x", "__y")
