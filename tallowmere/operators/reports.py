"""Reports that join what other operators made: profiles, differences, registries of features, reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import with_quantiles


def profile(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by``, the value (a null is one), rows and their share of the group, from partial counts."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("rows"))
    whole = n.groupBy(*by).agg(F.sum("rows").alias("__all")).withColumnsRenamed({c: f"__{c}" for c in by})
    j = n.join(whole, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return j.select(*by, value, "rows", (F.col("rows") / F.col("__all")).alias("share"))


def deltas(rows: DataFrame, option: str, dataset: str, first: str, second: str, measures: Sequence[str]) -> DataFrame:
    """By option the mean of each measure in two datasets, and second minus first; missing where one of them has no row."""
    side = lambda n, m: F.avg(F.when(F.col(dataset) == n, F.col(m)))
    cols = []
    for m in measures:
        a, b = side(first, m), side(second, m)
        cols += [a.alias(f"{m}_first"), b.alias(f"{m}_second"), (b - a).alias(f"{m}_delta")]
    return rows.where(F.col(dataset).isin(first, second)).groupBy(option).agg(*cols)


def paired_with_baseline(rows: DataFrame, key: str, source: str, system: str, baseline: str, value: str) -> DataFrame:
    """``key`` and the mean of the value of the system and of the baseline for keys that both have, with difference and winner."""
    side = lambda n: F.avg(F.when(F.col(source) == n, F.col(value)))
    g = rows.groupBy(key).agg(side(system).alias("system"), side(baseline).alias("baseline")).where("system is not null and baseline is not null")
    d = F.col("system") - F.col("baseline")
    return g.withColumn("difference", d).withColumn("winner", F.when(d > 0, "system").when(d < 0, "baseline").otherwise("tie"))


def stable_conclusions(primary: DataFrame, other: DataFrame, keys: Sequence[str], effect: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Conclusions of two populations side by side: significance and sign in each, and whether they are the same."""
    say = lambda e, q: F.when(q >= alpha, "NOT_SIGNIFICANT").when(e > 0, "POSITIVE").when(e < 0, "NEGATIVE").otherwise("NOT_SIGNIFICANT")
    a = primary.select(*keys, say(F.col(effect), F.col(p)).alias("primary"))
    b = other.select(*keys, say(F.col(effect), F.col(p)).alias("other"))
    return a.join(b, list(keys), "left").withColumn("stable", F.coalesce(F.col("primary") == F.col("other"), F.lit(False)))


def registry(features: DataFrame, rules: Sequence[tuple[str, str, str, str]], name: str = "feature") -> DataFrame:
    """concept, unit, kind of each feature by the first rule whose prefix its name has; ``unknown`` without one.

    A rule is (prefix, concept, unit, kind).
    """
    hit = [F.when(F.col(name).startswith(p), F.struct(F.lit(c).alias("concept"), F.lit(u).alias("unit"), F.lit(k).alias("kind"))) for p, c, u, k in rules]
    none = F.struct(F.lit("unknown").alias("concept"), F.lit("unknown").alias("unit"), F.lit("unknown").alias("kind"))
    return features.withColumn("__r", F.coalesce(*hit, none)).select(*features.columns, "__r.*")


def registered(tables: Mapping[str, DataFrame], rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """The columns of several tables with what :func:`registry` knows of them, and what they hold: table, feature, data_type, rows, present, concept, unit, kind, status.

    ``status``: UNKNOWN of a column that no rule names, EMPTY of one without a value, else KNOWN.  Each table is read once.
    """
    from .audits import dictionary

    parts = [dictionary(df).select(F.lit(n).alias("table"), F.col("column_name").alias("feature"), "data_type", "rows", "present") for n, df in tables.items()]
    every = reduce(DataFrame.unionByName, parts)
    status = F.when(F.col("concept") == "unknown", "UNKNOWN").when(F.col("present") == 0, "EMPTY").otherwise("KNOWN")
    return registry(every, rules).withColumn("status", status)


def origins(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``(feature, original, level, rows)``: from which column each preprocessed feature comes, for one-hot ones from which level, and how many rows have it.

    Levels are counted where the rows lie and stay in the cluster.  Two levels whose names become alike are two rows.
    """
    name = F.regexp_replace(F.regexp_replace(F.lower("level"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    pairs = [F.struct(F.lit(c).alias("original"), F.when(F.col(c).isNotNull(), F.lit("")).alias("level"), F.lit(False).alias("coded")) for c in numeric]
    pairs += [F.struct(F.lit(c).alias("original"), F.col(c).cast("string").alias("level"), F.lit(True).alias("coded")) for c in categorical]
    n = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("level is not null").groupBy("original", "level", "coded").agg(F.count("*").alias("rows"))
    feature = F.when(F.col("coded"), F.concat("original", F.lit("__"), name)).otherwise(F.col("original"))
    return n.select(feature.alias("feature"), "original", F.when(F.col("coded"), F.col("level")).alias("level"), "rows")


def coded(options: DataFrame, scenario: str, eligible: Column, high: Mapping[str, str], low: Mapping[str, str], fixed: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """``reasons`` and ``cautions`` of options, joined by ``|``: their values against the medians of the scenario's eligible options.

    ``high`` names a reason for a column that is at or above the median, ``low`` one for a column at or below it and,
    under the name with ``NOT_`` before it, a caution for one above.  ``fixed`` reasons come first.
    """
    columns = list(dict.fromkeys([*high, *low]))
    own = options.where(eligible)
    g = own.groupBy(scenario).agg(F.count("*").alias("__n"))
    for c in columns:
        g = with_quantiles(g, own, [scenario], c, {f"__m_{c}": 0.5})
    g = g.drop("__n").withColumnRenamed(scenario, "__s")
    j = options.join(g, F.col(scenario).eqNullSafe(F.col("__s")), "left")
    when = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), F.lit(n))
    why = [when(c, n) for n, c in fixed] + [when(F.col(c) >= F.col(f"__m_{c}"), n) for c, n in high.items()] + [when(F.col(c) <= F.col(f"__m_{c}"), n) for c, n in low.items()]
    but = [when(F.col(c) > F.col(f"__m_{c}"), f"NOT_{n}") for c, n in low.items()]
    text = lambda xs: F.array_join(F.array_compact(F.array(*xs)), "|")
    return j.withColumn("reasons", text(why)).withColumn("cautions", text(but)).select(*options.columns, "reasons", "cautions")


def nesting(packages: DataFrame, key: str, inner: str, outer: str) -> DataFrame:
    """Cases in which a feature that one evidence level selects is missing from another: key, missing (how many)."""
    of = lambda n: packages.where(F.col("evidence_level") == n)
    parts = lambda d: d.select(F.col(key), F.filter(F.split("features", r"\|"), lambda x: x != "").alias("f"))
    a, b = parts(of(inner)), parts(of(outer)).select(F.col(key).alias("__k"), F.col("f").alias("g"))
    j = a.join(b, F.col(key) == F.col("__k"), "left")
    lacking = F.size(F.array_except("f", F.coalesce("g", F.array().cast("array<string>"))))
    return j.select(key, lacking.alias("missing")).where("missing > 0")


# ---- tables of a release ---------------------------------------------------------------------


def reconciled(table: DataFrame, certified: DataFrame, id_: Column, value: str, tolerance: float = 1e-12) -> DataFrame:
    """``table`` with ``report_number_id``, its rows' number among ``certified(report_number_id, value)``.

    It fails closed: a row whose number is not certified once, or differs from it by more than ``tolerance``, raises an error when it is computed.  Two missing values agree.
    """
    c = certified.groupBy(F.col("report_number_id").alias("__id")).agg(F.count("*").alias("__times"), F.max(F.col("value").cast("double")).alias("__v"))
    j = table.withColumn("report_number_id", id_).join(c, F.col("report_number_id") == F.col("__id"), "left")
    x = F.col(value).cast("double")
    same = F.coalesce(F.abs(x - F.col("__v")) <= tolerance, x.isNull() & F.col("__v").isNull())
    good = (F.coalesce("__times", F.lit(0)) == 1) & same
    error = F.raise_error(F.concat(F.lit("not certified: "), F.coalesce("report_number_id", F.lit("a row without a number"))))
    # the error stands in a column that is returned, so that no plan can leave it out
    return j.withColumn("report_number_id", F.when(good, F.col("report_number_id")).otherwise(error.cast("string"))).select(*table.columns, "report_number_id")


def across(first: DataFrame, second: DataFrame, key: str, columns: Sequence[str], names: tuple[str, str], flag: str | None = None) -> DataFrame:
    """What both studies have by ``key``: the columns under each study's name, and ``both_<flag>`` where a flag is named (an unknown one is false)."""
    side = lambda d, n: d.select(key, *[F.col(c).alias(f"{n}_{c}") for c in columns])
    j = side(first, names[0]).join(side(second, names[1]), key)
    if flag is None:
        return j
    return j.withColumn(f"both_{flag}", F.coalesce(F.col(f"{names[0]}_{flag}") & F.col(f"{names[1]}_{flag}"), F.lit(False)))


def case_index(generations: DataFrame, by: Sequence[str], usable: Column, claims: Column) -> DataFrame:
    """By case: generations, usable ones, claims (0 of none) and whether the case is complete: every generation usable."""
    g = generations.groupBy(*by).agg(F.count("*").alias("generations"), F.count(F.when(usable, 1)).alias("usable_generations"), F.coalesce(F.sum(claims), F.lit(0)).alias("claims"))
    return g.withColumn("complete_case", F.col("usable_generations") == F.col("generations"))


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, column_name, place, data_type)`` of several tables, from their schemas alone."""
    rows = [(n, f.name, i, f.dataType.simpleString()) for n, d in sorted(tables.items()) for i, f in enumerate(d.schema.fields)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table_name string, column_name string, place int, data_type string")
