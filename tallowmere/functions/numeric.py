"""Numbers: missing values, ratios, bands and small statistics of one row.

A missing number is NULL, never NaN.  Comparisons with a missing value are false, a ratio is missing
unless its denominator is positive, and sums over nothing but missing values are 0 where said so.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def is_infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c) == float("inf"), F.lit(False))


def number(c: Column) -> Column:
    """The number that a text spells, NULL if none or not finite."""
    return clean(c.try_cast("double"))


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    """Rows of the group where the condition is true; 0 of none."""
    return F.count(F.when(condition, 1))


def sum0(c: Column) -> Column:
    """The sum, 0 where every value is missing."""
    return F.coalesce(F.sum(c), F.lit(0))


def ratio(top: Column, bottom: Column, otherwise: float | None = None, positive: bool = True) -> Column:
    """``top / bottom`` where the bottom is positive (with ``positive=False``: not 0), else ``otherwise``.

    The three policies in use are missing (None), 0 and infinity.
    """
    ok = bottom > 0 if positive else bottom != 0
    r = F.when(ok, top.cast("double") / bottom)
    return r if otherwise is None else r.otherwise(F.when(bottom.isNotNull(), F.lit(float(otherwise))))


def unless(bad: Column, c: Column) -> Column:
    """``c``, missing where ``bad`` holds or is unknown: the mask of a sentinel value."""
    return F.when(~bad, c)


def positive_part(c: Column) -> Column:
    return F.when(c > 0, c)


def row_stats(columns: Sequence[Column]) -> dict[str, Column]:
    """min, max, mean, std (n - 1) and missing of one row's values; missing ones are skipped."""
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    mean = F.when(n > 0, total / n)
    square = reduce(lambda a, b: a + b, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in columns])
    return {
        "min": F.least(*columns),
        "max": F.greatest(*columns),
        "mean": mean,
        "std": F.when(n > 1, F.sqrt(square / (n - 1))),
        "missing": F.lit(len(columns)) - n,
    }


def band(c: Column, edges: Sequence[float], names: Sequence[str], right: bool = True) -> Column:
    """The name of the interval that holds ``c``: up to each edge inclusively (``right``) or exclusively; NULL for NULL."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for e, n in zip(edges, names, strict=False):
        out = out.when((c <= e) if right else (c < e), n)
    return out.otherwise(names[-1])


def drift_band(psi: Column) -> Column:
    """low below 0.10, medium below 0.25, else high; unknown for NULL."""
    return F.coalesce(band(psi, (0.10, 0.25), ("low", "medium", "high"), right=False), F.lit("unknown"))


def direction(c: Column, eps: float = 1e-12, names: Sequence[str] = ("increases", "decreases", "neutral")) -> Column:
    return F.when(c > eps, names[0]).when(c < -eps, names[1]).when(c.isNotNull(), names[2])


def scaled(c: Column, low: Column, high: Column) -> Column:
    """Where ``c`` lies between ``low`` and ``high``, clipped to 0 and 1; 1 where these are equal."""
    return F.when(c.isNull(), F.lit(None)).when(high - low <= 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - low) / (high - low))))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The score interval of ``k`` of ``n``; missing for n = 0."""
    p = k.cast("double") / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    mid, bottom = p + z * z / (2.0 * n), 1 + z * z / n
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), (mid - half) / bottom)), F.when(some, F.least(F.lit(1.0), (mid + half) / bottom))


def geometric_mean(values: Sequence[tuple[Column, float]]) -> Column:
    """The weighted geometric mean; missing values leave the weights of the rest, a 0 makes it 0."""
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in values])
    logs = reduce(lambda a, b: a + b, [F.coalesce(F.when(c > 0, F.ln(c) * w), F.lit(0.0)) for c, w in values])
    zero = reduce(lambda a, b: a | b, [F.coalesce(c <= 0, F.lit(False)) for c, _ in values])
    return F.when(weight <= 0, F.lit(None)).when(zero, 0.0).otherwise(F.exp(logs / weight))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def entropy_term(p: Column) -> Column:
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Common over all elements of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def outcome(truth: Column, predicted: Column) -> Column:
    """TP, FP, FN or TN; NULL where either is."""
    return F.when((truth == 1) & (predicted == 1), "TP").when((truth == 0) & (predicted == 1), "FP").when((truth == 1) & (predicted == 0), "FN").when((truth == 0) & (predicted == 0), "TN")


def first_failure(flags: Sequence[tuple[str, Column]], none: str = "NONE") -> Column:
    """The name of the first flag that holds: the order is the precedence."""
    return F.coalesce(*[F.when(c, n) for n, c in flags], F.lit(none))


def reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def month_ordinal(period: Column) -> Column:
    """year * 12 + month of a YYYYMM text or number; NULL unless it is one with a month of 1 to 12."""
    p = F.when(period.cast("string").rlike(r"^\d{6}$"), period.cast("string"))
    month = F.substring(p, 5, 2).try_cast("int")
    return F.when(month.between(1, 12), F.substring(p, 1, 4).try_cast("int") * 12 + month)


def payment_index(report: Column, first: Column) -> Column:
    """The number of the month of ``report`` counted from that of ``first``, which is 1."""
    return report - first + 1
