"""A monthly panel folded into one target with censoring reasons for each entity.

Months are numbered from an entity's first one.  Inside the horizon an entity is positive with its first
serious month; else it must have been seen in every month, with known status, or have ended in a clean
way: what misses makes it censored, for a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import month_ordinal, payment_index, sum0


@dataclass(frozen=True)
class Protocol:
    """Fixed values of the target: months, cycles that are serious, and codes by meaning."""

    horizon: int = 12
    serious_cycles: int = 3
    serious_status: tuple[str, ...] = ("RA",)
    unknown_status: tuple[str, ...] = ("XX",)
    serious_codes: tuple[str, ...] = ("02", "03", "09")
    clean_codes: tuple[str, ...] = ("01",)
    censoring_codes: tuple[str, ...] = ("15", "16", "96")


def indexed(panel: DataFrame, anchors: DataFrame, entity: str = "entity") -> DataFrame:
    """The panel's rows with ``idx``, the month's number from the entity's first; entities without an anchor are left out.

    ``panel(entity, period, status, code)`` with periods as YYYYMM, ``anchors(entity, first_period)``.
    """
    a = anchors.select(entity, month_ordinal(F.col("first_period")).alias("__first"))
    return panel.join(a, entity).withColumn("idx", payment_index(month_ordinal(F.col("period")), F.col("__first"))).drop("__first")


def gaps(panel: DataFrame, entity: str, ordinal: str) -> DataFrame:
    """Rows whose month does not follow the previous one's: ``step`` is the distance, 0 for a repeated month."""
    order = W.partitionBy(entity).orderBy(ordinal)
    return panel.withColumn("step", F.col(ordinal) - F.lag(ordinal).over(order)).where("step <> 1")


def fold(rows: DataFrame, event: Column, unknown: Column, code: Column, entity: str = "entity", horizon: int = 12) -> DataFrame:
    """One row an entity: first_idx, last_idx, observed_mask, unknown_mask, event_idx, event, terminal_idx, terminal_code, rows.

    ``rows`` has ``idx``.  ``event`` names what makes a row serious (NULL if nothing does), ``code`` is NULL unless
    the row ends the entity.  The masks have a bit for each month of the horizon; ``or`` and not ``sum`` makes them,
    so a repeated month is harmless here (it is an error to be found by its own check).
    """
    inside = F.col("idx").between(1, horizon)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.greatest(F.lit(1), F.least(F.lit(horizon), F.col("idx"))) - 1).cast("int"))
    mask = lambda c: F.coalesce(F.bit_or(F.when(inside & c, bit)), F.lit(0).cast("long"))
    serious, ends = inside & event.isNotNull(), code.isNotNull()
    return rows.groupBy(entity).agg(
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        mask(F.lit(True)).alias("observed_mask"),
        mask(unknown).alias("unknown_mask"),
        F.min(F.when(serious, F.col("idx"))).alias("event_idx"),
        F.min_by(event, F.when(serious, F.col("idx"))).alias("event"),
        F.min(F.when(ends, F.col("idx"))).alias("terminal_idx"),
        F.min_by(code, F.when(ends, F.col("idx"))).alias("terminal_code"),
        F.count("*").alias("rows"),
    )


def classified(folded: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """``target`` (1, 0 or NULL), ``censor_reason`` (NULL unless censored) and observed_months added to :func:`fold`'s rows.

    An event inside the horizon is positive.  Without one, negative is an entity that was seen from the first
    month on, in each month of the horizon and with known status; or, if it ended in a clean way before the
    horizon, in each month up to then.  The rest is censored, for the first reason that holds.
    """
    h, c = protocol.horizon, F.col
    ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1
    full, upto = ones(F.lit(h)), ones(F.greatest(F.lit(0), F.least(F.lit(h), F.coalesce("terminal_idx", F.lit(h)))))
    started, through = c("first_idx") <= 1, c("last_idx") >= h
    clean = F.coalesce(c("terminal_code").isin(*protocol.clean_codes), F.lit(False))
    whole, known = c("observed_mask") == full, c("unknown_mask") == 0
    paid, paid_known = c("observed_mask").bitwiseAND(upto) == upto, c("unknown_mask").bitwiseAND(upto) == 0
    negative = started & F.when(through, whole & known).otherwise(clean & paid & paid_known)
    reason = (
        F.when(~started, "left_censored_after_payment_month_1")
        .when(through & ~whole, f"missing_month_inside_{h}m_horizon")
        .when(through & whole & ~known, f"unknown_delinquency_inside_{h}m_horizon")
        .when(clean & ~paid, "missing_month_before_voluntary_payoff")
        .when(clean & ~paid_known, "unknown_status_before_voluntary_payoff")
        .when(c("terminal_code").isin(*protocol.censoring_codes), F.concat(F.lit("non_outcome_termination_"), c("terminal_code")))
        .otherwise(f"insufficient_{h}m_observation")
    )
    out = folded.withColumn("target", F.when(c("event_idx").isNotNull(), 1).when(negative, 0))
    return out.withColumn("censor_reason", F.when(c("target").isNull(), reason)).withColumn("observed_months", F.bit_count("observed_mask").cast("long"))


def panel_target(panel: DataFrame, anchors: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    """:func:`classified` rows of ``panel(entity, period, status, code)`` under a protocol.

    A serious code comes before the status that means repossession, and this before the count of cycles; a blank
    or missing status is unknown, a blank code none.
    """
    p = protocol
    r = indexed(panel, anchors)
    code = F.nullif(F.trim(F.coalesce("code", F.lit(""))), F.lit(""))
    status = F.trim(F.coalesce("status", F.lit("")))
    event = F.when(code.isin(*p.serious_codes), F.concat(F.lit("serious_zero_balance_"), code)).when(status.isin(*p.serious_status), "reo_status").when(status.try_cast("int") >= p.serious_cycles, "90plus_delinquency")
    return classified(fold(r, event, (status == "") | status.isin(*p.unknown_status), code, horizon=p.horizon), p)


def reason_counts(targets: DataFrame, by: str) -> DataFrame:
    """Entities, events and censored ones by group and reason."""
    return targets.groupBy(by, F.coalesce("censor_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("entities"), sum0(F.col("target")).alias("events"))
