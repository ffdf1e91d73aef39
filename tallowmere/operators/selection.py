"""Gates on configurations, the choice among those that pass, subsets that cover, attempts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gated(rows: DataFrame, gates: Sequence[tuple[str, Column, str, float]], tolerance: float = 0.0) -> DataFrame:
    """``failed_gates`` (names joined by ``|`` in their order) and ``gates_pass``.

    A gate is (name, value, ``min`` or ``max``, bound); a missing value fails it.
    """
    bad = []
    for name, v, kind, bound in gates:
        out = v + tolerance < bound if kind == "min" else v - tolerance > bound
        bad.append(F.when(F.coalesce(out, F.lit(True)), F.lit(name)))
    failed = F.array_compact(F.array(*bad))
    return rows.withColumn("failed_gates", F.array_join(failed, "|")).withColumn("gates_pass", F.size(failed) == 0)


def decision(candidates: DataFrame, key: str, level: str, best: Sequence[Column], risk: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """One row: status, selected, reference, lowest_risk and passing.

    ``candidates`` have gates_pass, non_inferior (against the reference) and on_frontier.  The reference is the first by
    ``best`` among those that pass; the selected one is the first by ``level`` and ``order`` among those that pass, are
    not inferior and on the frontier.  Where none passes nothing is selected, and the first by ``risk`` is named.
    """
    first = lambda where, o: candidates.where(where).orderBy(*o, F.col(key)).limit(1).select(F.col(key).alias("k"))
    ok = F.col("gates_pass")
    picks = {
        "selected": first(ok & F.coalesce("non_inferior", F.lit(False)) & F.col("on_frontier"), [F.col(level), *order]),
        "reference": first(ok, best),
        "lowest_risk": first(F.lit(True), risk),
    }
    out = candidates.agg(F.count(F.when(ok, 1)).alias("passing"))
    for name, p in picks.items():
        out = out.join(p.agg(F.max("k").alias(name)), F.lit(True))  # one row each
    none = F.col("passing") == 0
    return out.select(
        F.when(none, "NO_CANDIDATE_PASSED_HARD_GATES").otherwise("SELECTED").alias("status"), "selected", "reference", F.when(none, F.col("lowest_risk")).alias("lowest_risk"), "passing",
    )


def coverage_first(rows: DataFrame, key: str, dimensions: Sequence[str], limit: int, boundaries: Sequence[Column] = (), seed: str = "subset") -> DataFrame:
    """``limit`` rows that first cover every value of each dimension, then each boundary predicate, then all strata in turn; ``place`` is the order.

    Rows are ordered by a hash of the key.  A value or predicate takes the first row that has it and is not taken
    yet.  Before the greedy part, which looks at a bounded number of rows, each stratum and each predicate is cut to
    its first ``limit`` rows: no other row can be taken.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}\n"), F.col(key).cast("string")), 256)
    d = rows.withColumn("__h", h)
    within = W.partitionBy(*dimensions).orderBy("__h", key)
    d = d.withColumn("__depth", F.row_number().over(within))
    wanted = F.col("__depth") <= limit
    marks = {f"__b{i}": F.coalesce(b, F.lit(False)) for i, b in enumerate(boundaries)}
    d = d.withColumns(marks)
    tops = [d.where(wanted)]
    for b in marks:
        tops.append(d.where(F.col(b)).orderBy("__h", key).limit(limit))
    near = reduce(lambda a, b: a.unionByName(b), tops).dropDuplicates([key])
    kept = near.select(key, "__h", "__depth", *dimensions, *marks).orderBy("__h", key).collect()  # strata and predicates times the limit
    taken: dict[object, int] = {}

    def take(rows_) -> None:
        if len(taken) < limit and (found := next((r for r in rows_ if r[key] not in taken), None)):
            taken[found[key]] = len(taken) + 1

    text = lambda v: "" if v is None else str(v)
    for dim in dimensions:
        for value in sorted({text(r[dim]) for r in kept}):
            take(r for r in kept if text(r[dim]) == value)
    for b in marks:
        take(r for r in kept if r[b])
    for r in sorted(kept, key=lambda r: (r["__depth"], "|".join(text(r[c]) for c in dimensions))):
        if len(taken) < limit and r[key] not in taken:
            taken[r[key]] = len(taken) + 1
    kind = rows.schema[key].dataType.simpleString()
    places = rows.sparkSession.createDataFrame(list(taken.items()) or [], f"{key} {kind}, place int")
    return rows.join(F.broadcast(places), key)  # limit rows


def next_attempts(attempts: DataFrame, key: str, attempt: str) -> DataFrame:
    """The number of each key's next attempt: one more than the greatest so far, 1 at least."""
    return attempts.groupBy(key).agg(F.greatest(F.lit(1), F.coalesce(F.max(attempt), F.lit(0)) + 1).alias("next_attempt"))


def role(level: Column, controls: Sequence[str], primary: Sequence[str]) -> Column:
    return F.when(level.isin(*controls), "CONTROL").when(level.isin(*primary), "PRIMARY_CANDIDATE").otherwise("FALLBACK_ONLY")


def agreement(results: DataFrame, by: Sequence[str], state: str, passed: Column) -> DataFrame:
    """By conclusion whether all repetitions (seeds, populations) reach one state, and whether all pass; ``states`` lists them."""
    return results.groupBy(*by).agg(
        F.count("*").alias("repetitions"), F.array_join(F.array_sort(F.collect_set(state)), "|").alias("states"),
        (F.min(state) == F.max(state)).alias("agreed"), F.bool_and(F.coalesce(passed, F.lit(False))).alias("all_pass"),
    )

