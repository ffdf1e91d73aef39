"""Checks that are data: duplicates, orphans, mismatches, and tables of named results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that several rows have, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def unique_key(df: DataFrame, keys: Sequence[str], name: str = "key") -> DataFrame:
    """``df`` unchanged, failing when it is computed if two rows share a key.

    A window over the key would keep no partial counts; the count of each key is joined back instead.
    """
    n = df.groupBy(*keys).agg(F.count("*").alias("__rows"))
    joined = df.join(n.withColumnsRenamed({k: f"__{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    ok = F.when(F.col("__rows") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{name} is not unique")).cast("boolean"))
    return joined.where(ok).select(df.columns)


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``child`` whose key ``parent`` lacks; a null key is one."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def complete_cases(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """The rows of keys of which every row satisfies ``condition``."""
    whole = df.groupBy(key).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("__all")).where("__all").select(key)
    return df.join(whole, key, "left_semi")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A full outer join on the keys with ``merge``: both, left_only or right_only."""
    a = left.withColumn("__l", F.lit(True))
    b = right.withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, list(keys), "full_outer").withColumn("merge", side).drop("__l", "__r")


def mismatches(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows in which a pair of columns differs, nulls being alike."""
    bad = F.lit(False)
    for a, b in pairs:
        bad = bad | ~F.col(a).eqNullSafe(F.col(b))
    return df.where(bad)


def inconsistent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose rows have several values, a null being one."""
    n = F.count_distinct(value) + F.max(F.when(F.col(value).isNull(), 1).otherwise(0))
    return df.groupBy(key).agg(n.alias("values")).where("values > 1")


#: Rows of a dimension of a design, but for the first, at most.
DIMENSION = 10_000


def expected_cells(*dims: DataFrame) -> DataFrame:
    """Every combination of the rows of small dimensions: the cells that a design plans.

    The dimensions after the first are lists of a design (models, levels, repeats), never data; one of more than :data:`DIMENSION` rows fails.
    """
    out = dims[0]
    for d in dims[1:]:
        if d.limit(DIMENSION + 1).count() > DIMENSION:
            raise ValueError(f"a dimension of a design has more than {DIMENSION} rows")
        out = out.join(F.broadcast(d), F.lit(True))
    return out


def holes(planned: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``missing`` and ``unexpected`` cells by key."""
    p, a = planned.select(*keys).distinct(), actual.select(*keys).distinct()
    return p.join(a, list(keys), "left_anti").withColumn("state", F.lit("missing")).unionByName(a.join(p, list(keys), "left_anti").withColumn("state", F.lit("unexpected")))


def check_table(df: DataFrame, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """One row a check: check_name, expected, observed (as text) and passed, from one pass over ``df``.

    Each check is (name, expected value, observed aggregate).
    """
    one = df.agg(*[e.cast("string").alias(f"e{i}") for i, (_, e, _) in enumerate(checks)], *[o.cast("string").alias(f"o{i}") for i, (_, _, o) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"e{i}").alias("expected"), F.col(f"o{i}").alias("observed")) for i, (n, _, _) in enumerate(checks)])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("passed", F.col("expected").eqNullSafe(F.col("observed")))


def filtered(df: DataFrame, where: dict[str, object], none_means_null: bool) -> DataFrame:
    """Equality filters by column.  A None is either no filter, or IS NULL; in the latter kind other values than booleans compare as text."""
    for k, v in where.items():
        if v is None:
            df = df.where(F.col(k).isNull()) if none_means_null else df
        elif none_means_null and not isinstance(v, bool):
            df = df.where(F.col(k).cast("string") == F.lit(str(v)))
        else:
            df = df.where(F.col(k) == F.lit(v))
    return df


def forbidden_fields(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Paths of the schema, nested ones too, that end in a forbidden name."""
    found = []

    def walk(kind, path):
        if hasattr(kind, "fields"):
            for f in kind.fields:
                here = f"{path}.{f.name}".lstrip(".")
                if f.name.lower() in {n.lower() for n in names}:
                    found.append(here)
                walk(f.dataType, here)
        elif hasattr(kind, "elementType"):
            walk(kind.elementType, path)
        elif hasattr(kind, "valueType"):
            walk(kind.valueType, path)

    walk(df.schema, "")
    return found
