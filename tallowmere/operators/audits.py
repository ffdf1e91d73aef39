"""Audits of tables: columns, relationships, anomalies, numeric features, categories, drift."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from ..functions.numeric import clean, count_where, drift_band, is_infinite
from ..session import staged
from .quantiles import quantiles

QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def _long(one: DataFrame, columns: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """A single row ``<column>__<measure>`` as a row for each column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{m}").alias(m) for m in measures]) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, data_type, rows, missing, distinct, missing_rate, most_common (a value as text, of equally frequent ones the least) and its count.

    Pairs of column and value are counted where the rows lie; all that follows comes from these counts, in one pass.
    """
    columns = list(columns or df.columns)
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)])).alias("p")
    counts = df.select(pair).groupBy("p.i", "p.v").agg(F.count("*").alias("n"))
    top = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("less"), "v")))
    g = counts.groupBy("i").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("v").alias("distinct"), top.alias("top"))
    named = df.sparkSession.createDataFrame([(i, c, df.schema[c].dataType.simpleString()) for i, c in enumerate(columns)], "i int, column_name string, data_type string")
    out = named.join(g, "i", "left").fillna(0, ["rows", "missing", "distinct"])
    rate = F.when(F.col("rows") > 0, F.col("missing") / F.col("rows"))
    return out.select("column_name", "data_type", "rows", "missing", "distinct", rate.alias("missing_rate"), F.col("top.v").alias("most_common"), (-F.col("top.less")).alias("most_common_count"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat another one in all columns; missing values are equal to each other and to nothing else."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def relationship_profile(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """One row: parents, parents with children, children a parent (mean, maximum), child rows and those without a parent."""
    n = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    p = parent.select(F.col(parent_key).alias("k")).where("k is not null").distinct().withColumn("p", F.lit(1))
    both = p.join(n, "k", "full_outer")
    return both.agg(
        F.count("p").alias("parents"),
        count_where(F.col("p").isNotNull() & F.col("n").isNotNull()).alias("parents_with_children"),
        F.avg(F.when(F.col("p").isNotNull(), F.col("n"))).alias("mean_children"),
        F.max(F.when(F.col("p").isNotNull(), F.col("n"))).alias("max_children"),
        count_where(F.col("p").isNull()).alias("unmatched_keys"),
        F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("n"))), F.lit(0)).alias("unmatched_rows"),
    )


def anomaly_audit(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """column_name, rule, rows, missing, infinite, zero, negative, minimum, maximum, violations of each rule's predicate.

    ``rules`` maps a numeric column to (name, predicate that is true for an anomaly).
    """
    aggs, measures = [], ("rows", "missing", "infinite", "zero", "negative", "minimum", "maximum", "violations")
    for c, (_, bad) in rules.items():
        v = clean(F.col(c).cast("double"))
        for m, a in zip(measures, (F.count("*"), F.count("*") - F.count(c), count_where(is_infinite(F.col(c).cast("double"))), count_where(v == 0), count_where(v < 0), F.min(v), F.max(v), count_where(bad)), strict=True):
            aggs.append(a.alias(f"{c}__{m}"))
    names = F.create_map(*[x for c, (n, _) in rules.items() for x in (F.lit(c), F.lit(n))])
    return _long(df.agg(*aggs), list(rules), measures).withColumn("rule", names[F.col("column_name")])


def melted(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), infinite: bool = False) -> DataFrame:
    """``feature`` and ``value`` (double) in long form, with the columns to keep, and where asked for whether the value was ``infinite``."""
    raw = lambda c: F.col(c).cast("double")
    more = lambda c: [is_infinite(raw(c)).alias("infinite")] if infinite else []
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), clean(raw(c)).alias("value"), *more(c)) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("__p")).select(*keep, "__p.*")


def numeric_stats(long: DataFrame, target: str | None = None) -> DataFrame:
    """By ``feature`` of :func:`melted` rows: counts, moments, quantiles (linear), corrected skewness and kurtosis, rates, outliers.

    The rows are read once, to count equal values of a feature and side of the target; everything else comes from these counts.
    Rates are of all rows, missing ones among them, and missing where no value is present; what compares the sides of the
    target is missing where a feature has fewer than two values.  A constant has no skewness: 0.
    """
    v, y, k = F.col("value"), F.col("__side"), F.col("__n")
    side = [(F.lit(None) if target is None else F.col(target)).cast("double").alias("__side")]
    inf = F.col("infinite") if "infinite" in long.columns else F.lit(False)
    counts = staged(long.groupBy("feature", *side, "value", inf.alias("__inf")).agg(F.count("*").alias("__n")))
    many = lambda c: F.coalesce(F.sum(F.when(c, k)), F.lit(0))
    mean = lambda c: F.sum(F.when(c, v * k)) / F.sum(F.when(c & v.isNotNull(), k))
    every, pair = F.lit(True), y.isNotNull()
    s = counts.groupBy("feature").agg(
        F.sum(k).alias("rows"), many(v.isNotNull()).alias("present"), many(v.isNull()).alias("missing"), many(F.col("__inf")).alias("infinite"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"), mean(every).alias("mean"), mean(y == 1).alias("mean_1"), mean(y == 0).alias("mean_0"),
        *[many(c).alias(f"{n}_count") for n, c in (("zero", v == 0), ("negative", v < 0), ("positive", v > 0))],
        mean(pair).alias("__mv"), (F.sum(F.when(v.isNotNull(), y * k)) / F.sum(F.when(pair & v.isNotNull(), k))).alias("__my"),
    )
    q = quantiles(counts, ["feature"], "value", QUANTILES, times="__n").select("feature", "distinct", "q")
    s = s.join(q, "feature", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    s = s.withColumns({f"q{round(100 * p):02d}": F.col("q")[i] for i, p in enumerate(QUANTILES)}).drop("q")
    width = F.col("q75") - F.col("q25")
    s = staged(s.withColumn("iqr", width).withColumn("value_range", F.col("maximum") - F.col("minimum")))
    own = s.select(F.col("feature").alias("__f"), F.col("present").alias("__k"), *[F.col(c).alias(n) for c, n in (("q25", "__q25"), ("q75", "__q75"), ("iqr", "__w"), ("mean", "__m"))], "__mv", "__my")
    c = counts.where(v.isNotNull()).join(F.broadcast(own), F.col("feature") == F.col("__f"))  # a row a feature: the columns of one table
    d, dv, dy = v - F.col("__m"), F.when(pair, v - F.col("__mv")), y - F.col("__my")
    power = lambda p: F.sum(k * p)
    m = c.groupBy("feature").agg(
        power(d * d).alias("__m2"), power(d * d * d).alias("__m3"), power(d * d * d * d).alias("__m4"), power(dv * dy).alias("__cov"), power(dv * dv).alias("__vv"), power(F.when(pair, dy * dy)).alias("__yy"),
        many((v < F.col("__q25") - 1.5 * F.col("__w")) | (v > F.col("__q75") + 1.5 * F.col("__w"))).alias("iqr_outliers"),
    )
    m = staged(m)
    spread = m.join(own, F.col("feature") == F.col("__f")).select(F.col("feature").alias("__f"), "__m", F.sqrt(F.when(F.col("__k") > 1, F.col("__m2") / (F.col("__k") - 1))).alias("__s"))
    far = counts.where(v.isNotNull()).join(F.broadcast(spread), F.col("feature") == F.col("__f")).groupBy("feature").agg(many((F.col("__s") > 0) & (F.abs(v - F.col("__m")) > 3 * F.col("__s"))).alias("z_outliers"))
    s = s.join(m, "feature", "left").join(far, "feature", "left").fillna(0, ["iqr_outliers", "z_outliers"])
    n = F.col("present").cast("double")
    flat = F.col("__m2") <= 0
    g1 = F.when(flat, 0.0).otherwise(F.col("__m3") / n / F.pow(F.when(~flat, F.col("__m2")) / n, F.lit(1.5)))
    g2 = F.col("__m4") * n / F.pow(F.when(~flat, F.col("__m2")), F.lit(2.0)) - 3
    s = s.withColumns({
        "variance": F.when(n > 1, F.col("__m2") / (n - 1)), "std": F.sqrt(F.when(n > 1, F.col("__m2") / (n - 1))),
        "skewness": F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0))),
        "kurtosis": F.when(n > 3, F.when(flat, 0.0).otherwise((n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0)) * ((n + 1) * g2 + 6))),
        **{f"{r}_rate": F.when(n > 0, F.col(c) / F.col("rows")) for r, c in (("zero", "zero_count"), ("negative", "negative_count"), ("positive", "positive_count"), ("iqr_outliers", "iqr_outliers"), ("z_outliers", "z_outliers"))},
        "missing_rate": F.when(F.col("rows") > 0, F.col("missing") / F.col("rows")),
    })
    g = F.col("skewness")
    s = s.withColumn("skew_direction", F.when(n == 0, "all_missing").when(g.isNull(), "unknown").when(g > 0.5, "right_skewed").when(g < -0.5, "left_skewed").otherwise("approximately_symmetric"))
    corr = F.when((F.col("__vv") > 0) & (F.col("__yy") > 0), F.col("__cov") / F.sqrt(F.col("__vv") * F.col("__yy")))
    hidden = [x for x in s.columns if x.startswith("__")]
    if target is None:
        return s.drop(*hidden, "mean_0", "mean_1")
    sides = quantiles(counts.where(y.isin(0, 1)), ["feature", "__side"], "value", [0.5], times="__n")
    median = lambda x: F.max(F.when(y == x, F.col("q")[0])).alias(f"median_{x}")
    s = s.withColumn("target_corr", corr).join(sides.groupBy("feature").agg(median(1), median(0)), "feature", "left").drop(*hidden)
    s = s.withColumns({x: F.when(F.col("distinct") > 1, F.col(x)) for x in ("mean_1", "mean_0", "median_1", "median_0")})
    return s.withColumn("mean_difference", F.col("mean_1") - F.col("mean_0")).withColumn("median_difference", F.col("median_1") - F.col("median_0"))


def warnings(stats: DataFrame) -> DataFrame:
    """``warnings`` (names joined by ``|``) and their number, by thresholds on missing values, spread, skewness and outliers."""
    w = F.array_compact(F.array(
        F.when(F.col("present") < 0.5 * F.col("rows"), "high_missing"),
        F.when(F.col("distinct") <= 1, "constant"),
        F.when(F.abs("skewness") > 2, "high_skew"),
        F.when(F.col("iqr_outliers") > 0.05 * F.col("present"), "many_outliers"),
        F.when(F.col("zero_rate") > 0.95, "mostly_zero"),
    ))
    return stats.withColumn("warnings", F.array_join(w, "|")).withColumn("n_warnings", F.size(w))


def dataset_audit(stats: DataFrame) -> DataFrame:
    """One row over :func:`numeric_stats`: features, rows, missing cells and their rate, constant and skewed features, features with many outliers."""
    n = F.count("*")
    missing = F.sum(F.col("rows") - F.col("present"))
    return stats.agg(
        n.alias("features"), F.max("rows").alias("rows"), missing.alias("missing_cells"), F.when(F.sum("rows") > 0, missing / F.sum("rows")).alias("missing_rate"),
        count_where(F.col("distinct") <= 1).alias("constant"), count_where(F.abs("skewness") > 2).alias("skewed"), count_where(F.col("iqr_outliers") > 0.05 * F.col("present")).alias("many_outliers"),
        F.avg(F.abs("skewness")).alias("mean_abs_skewness"), F.max(F.abs("skewness")).alias("max_abs_skewness"),
    )


def concept_audit(stats: DataFrame, concepts: DataFrame) -> DataFrame:
    """By concept (a null one is a group) of ``concepts(feature, concept)``: features, mean and largest size of the skewness, largest size of the correlation with the target."""
    j = stats.join(concepts, "feature", "left")
    return j.groupBy("concept").agg(F.count("*").alias("features"), F.avg(F.abs("skewness")).alias("mean_abs_skewness"), F.max(F.abs("skewness")).alias("max_abs_skewness"), F.max(F.abs("target_corr")).alias("max_abs_target_corr"))


def category_frequency(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """feature, category, rows, positives, negatives, rate: null categories are their own, named ``__MISSING__``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias("category")) for c in columns])
    long = df.select(F.col(target).alias("__t"), F.explode(pairs).alias("p")).select("__t", "p.*")
    return long.groupBy("feature", "category").agg(F.count("*").alias("rows"), count_where(F.col("__t") == 1).alias("positives"), count_where(F.col("__t") == 0).alias("negatives")).withColumn("rate", F.when(F.col("positives") + F.col("negatives") > 0, F.col("positives") / (F.col("positives") + F.col("negatives"))))


def psi(df: DataFrame, value: str, is_reference: Column, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """One row: psi and drift (low, medium, high, unknown) of ``value``, the reference rows against the others.

    Edges are the reference's quantiles without repeats, half-open bins with a closed last one; what lies
    outside is dropped; shares below ``eps`` count as it.  With fewer than two edges psi is 0.
    """
    d = df.select(clean(F.col(value).cast("double")).alias("v"), is_reference.alias("r")).where("v is not null")
    steps = [i / bins for i in range(bins + 1)]
    edges = quantiles(d.where("r"), [], "v", steps).agg(F.max("q").alias("q")).select(F.array_distinct("q").alias("e"))
    b = d.join(F.broadcast(edges), F.lit(True))  # one row
    inside = (F.col("v") >= F.element_at("e", 1)) & (F.col("v") <= F.element_at("e", -1)) & (F.size("e") > 1)
    bin_ = F.least(F.size(F.filter("e", lambda x: x <= F.col("v"))), F.size("e") - 1)
    c = b.where(inside).groupBy(bin_.alias("bin")).agg(count_where(F.col("r")).alias("a"), count_where(~F.col("r")).alias("b"))
    every = b.select(F.explode(F.sequence(F.lit(1), F.greatest(F.size("e") - 1, F.lit(1)))).alias("bin")).distinct()
    t = d.agg(count_where(F.col("r")).alias("na"), count_where(~F.col("r")).alias("nb"))
    x = every.join(c, "bin", "left").join(F.broadcast(t), F.lit(True))
    pa = F.greatest(F.coalesce("a", F.lit(0)) / F.greatest("na", F.lit(1)), F.lit(eps))
    pb = F.greatest(F.coalesce("b", F.lit(0)) / F.greatest("nb", F.lit(1)), F.lit(eps))
    out = x.agg(F.sum((pb - pa) * F.ln(pb / pa)).alias("psi"), F.count("*").alias("bins"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    value_ = F.when((F.col("na") == 0) | (F.col("nb") == 0), F.lit(None).cast("double")).when(F.col("bins") < 2, 0.0).otherwise(F.col("psi"))
    return out.select("bins", value_.alias("psi")).withColumn("drift", drift_band(F.col("psi")))


def dictionary(df: DataFrame) -> DataFrame:
    """Of each column its place, name and type, and how many rows have a value; the counts are one pass."""
    cols = df.schema.fields
    one = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"n{i}") for i, f in enumerate(cols)])
    each = [F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col("rows"), F.col(f"n{i}").alias("present")) for i, f in enumerate(cols)]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


#: Parts of names that mark a column of days.
DAYS = ("DAYS", "DATE")


def missing_audit(df: DataFrame, high_missing: float = 40.0, many: int = 50, rare: float = 0.01) -> DataFrame:
    """By column: data_type, rows, missing, missing_percentage, is_high_missing, is_day_column, and of a column that is no number its
    categories: how many (unique_count), whether more than ``many`` (is_high_cardinality), and rare_categories, those below ``rare`` of the values.

    Numbers are counted by one aggregate; only the other columns' values are counted one by one, where the rows lie.  Without rows the percentage is 0.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    texts = [c for c, d in fields.items() if not isinstance(d, NumericType)]
    present = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(fields)])
    each = [F.struct(F.lit(c).alias("column_name"), F.lit(d.simpleString()).alias("data_type"), (F.col("rows") - F.col(f"n{i}")).alias("missing"), F.lit(any(x in c.upper() for x in DAYS)).alias("is_day_column")) for i, (c, d) in enumerate(fields.items())]
    out = present.select("rows", F.explode(F.array(*each)).alias("x")).select("rows", "x.*")
    share = F.when(F.col("rows") > 0, F.round(100 * F.col("missing") / F.col("rows"), 4)).otherwise(0.0)
    out = out.withColumn("missing_percentage", share).withColumn("is_high_missing", F.col("missing_percentage") >= high_missing)
    none = {"unique_count": "bigint", "is_high_cardinality": "boolean", "rare_categories": "bigint"}
    if not texts:
        return out.withColumns({c: (F.lit(False) if d == "boolean" else F.lit(None)).cast(d) for c, d in none.items()})
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in texts])).alias("p")
    counts = df.select(pair).where("p.v is not null").groupBy(F.col("p.c").alias("__c"), "p.v").agg(F.count("*").alias("__k"))
    sizes = F.broadcast(out.select(F.col("column_name").alias("__c"), (F.col("rows") - F.col("missing")).alias("__all")))  # a row a column
    found = counts.join(sizes, "__c").groupBy("__c").agg(F.count("*").alias("__u"), count_where(F.col("__k") < rare * F.col("__all")).alias("__r"))
    is_text = F.col("column_name").isin(texts)
    out = out.join(found, F.col("column_name") == F.col("__c"), "left").withColumns({"unique_count": F.when(is_text, F.coalesce("__u", F.lit(0))), "rare_categories": F.when(is_text, F.coalesce("__r", F.lit(0)))})
    return out.withColumn("is_high_cardinality", F.coalesce(F.col("unique_count") > many, F.lit(False))).drop("__c", "__u", "__r")


def target_audit(df: DataFrame, key: str, target: str) -> DataFrame:
    """One row: rows, target_0, target_1, target_1_ratio (of all rows, 0 without any), target_missing, other_values, repeated_keys (rows whose key
    another row has), keys_with_several_targets (a missing one is a value), imbalance and status.

    ``status`` is target_audit_passed if every row has 0 or 1 and no key two of them, else blocked.  Rows of one key are counted before they meet.
    """
    y = F.col(target).cast("double")
    by = df.groupBy(F.col(key).alias("__k"), y.alias("__y")).agg(F.count("*").alias("__n"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("__n"))), F.lit(0))
    v = F.col("__y")
    keys = by.groupBy("__k").agg(part(F.lit(True)).alias("n"), part(v == 0).alias("n0"), part(v == 1).alias("n1"), part(v.isNull()).alias("nn"), F.count("*").alias("targets"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = keys.agg(
        total("n").alias("rows"), total("n0").alias("target_0"), total("n1").alias("target_1"), total("nn").alias("target_missing"),
        total(F.col("n") - 1).alias("repeated_keys"), count_where(F.col("__k").isNotNull() & (F.col("targets") > 1)).alias("keys_with_several_targets"),
    )
    out = out.withColumn("other_values", F.col("rows") - F.col("target_0") - F.col("target_1") - F.col("target_missing"))
    out = out.withColumn("target_1_ratio", F.when(F.col("rows") > 0, F.round(F.col("target_1") / F.col("rows"), 6)).otherwise(0.0))
    out = out.withColumn("imbalance", F.when(F.col("target_1_ratio") < 0.2, "class_imbalance_expected_and_significant").otherwise("class_imbalance_mild_or_moderate"))
    good = (F.col("target_missing") == 0) & (F.col("other_values") == 0) & (F.col("keys_with_several_targets") == 0)
    return out.withColumn("status", F.when(good, "target_audit_passed").otherwise("blocked"))


def matrix_audit(df: DataFrame, features: Sequence[str], key: str, target: str | None, by: Sequence[str] = ()) -> DataFrame:
    """By ``by`` (splits, pipelines): rows, features, positives, negatives and their rate, missing and infinite cells, and from the
    schema the features that are no numbers, repeated names, and whether key or target are among the features.

    One aggregate over all features; a NaN is a missing cell.  Without a target its counts are missing.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    distinct = list(dict.fromkeys(features))
    other = [c for c in features if not isinstance(types[c], NumericType)]
    times = {c: list(features).count(c) for c in distinct}
    real = [c for c in distinct if isinstance(types[c], (DoubleType, FloatType))]
    gone = lambda c: F.col(c).isNull() | F.isnan(c) if c in real else F.col(c).isNull()
    cells = lambda cs, f: reduce(lambda a, b: a + b, [F.when(f(c), times[c]).otherwise(0) for c in cs], F.lit(0))
    y = F.lit(None) if target is None else F.col(target)
    positive, negative = count_where(y == 1), count_where(y == 0)
    known = lambda c: c if target is not None else F.lit(None).cast("bigint")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = df.groupBy(*by).agg(
        F.count("*").alias("rows"), known(positive).alias("positives"), known(negative).alias("negatives"),
        total(cells(distinct, gone)).alias("missing_cells"), total(cells(real, lambda c: is_infinite(F.col(c).cast("double")))).alias("infinite_cells"),
    )
    return out.withColumns({
        "features": F.lit(len(features)), "positive_rate": F.when(F.col("rows") > 0, F.col("positives") / F.col("rows")), "object_columns": F.lit(len(other)),
        "object_sample": F.lit(", ".join(other[:20])), "repeated_columns": F.lit(len(features) - len(distinct)), "key_in_features": F.lit(key in distinct), "target_in_features": F.lit(target in distinct),
    })
