"""Stored generations: deduplicated, checked against their plan and contract, summed up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, ratio
from ..functions.numeric import reasons as reasons_of
from .checks import holes
from .quantiles import with_quantiles
from .ranking import preferred

KEY = ("model_id", "repeat_id", "case_id", "evidence_level")


def generation_key() -> F:
    """``model::r<repeat>::case::level``."""
    return F.concat_ws("::", F.col("model_id"), F.concat(F.lit("r"), F.col("repeat_id").cast("string")), F.col("case_id"), F.col("evidence_level"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row a key: a success before a failure, then the latest attempt, then the least id."""
    order = [F.when(F.col("runtime_status") == "SUCCESS", 0).otherwise(1), F.desc_nulls_last("attempt"), F.asc("generation_id")]
    return preferred(rows, KEY, order)


def usability(rows: DataFrame) -> DataFrame:
    """``usable`` and the reasons against it, all that hold."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = (
        ("RUNTIME_FAILED", no(F.col("runtime_status") == "SUCCESS")), ("TRUNCATED", F.coalesce("truncated_response", F.lit(False))), ("PARSE_FAILED", no(F.col("json_parse_success"))),
        ("SCHEMA_INVALID", no(F.col("schema_valid"))), ("EMPTY_RESPONSE", F.coalesce(F.length("response_text"), F.lit(0)) == 0),
    )
    return rows.withColumn("unusable_reasons", reasons_of(rules)).withColumn("usable", F.size("unusable_reasons") == 0)


def index(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Cells of the plan without a generation, and generations outside it."""
    return holes(planned, rows, KEY)


def unfair_prompts(rows: DataFrame, cohort: Sequence[str] = ("case_id", "evidence_level")) -> DataFrame:
    """Cohorts whose models saw different prompts: they must share one hash."""
    return rows.groupBy(*cohort).agg(F.count_distinct("prompt_hash").alias("prompts"), F.count("*").alias("generations")).where("prompts <> 1")


def runtime_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rates of success, parsing and valid schemas (of all, and of those that got so far), latency and tokens."""
    ok, parsed, valid = F.col("runtime_status") == "SUCCESS", F.col("json_parse_success"), F.col("schema_valid")
    n, s, p, v = F.count("*"), count_where(ok), count_where(ok & parsed), count_where(ok & parsed & valid)
    g = rows.groupBy(*by).agg(
        n.alias("generations"), ratio(s, n).alias("success_rate"), ratio(p, n).alias("parse_rate"), ratio(v, n).alias("schema_rate"), ratio(p, s).alias("parse_rate_of_successes"), ratio(v, p).alias("schema_rate_of_parsed"),
        F.avg("latency_ms").alias("mean_latency_ms"), F.coalesce(F.sum("total_token_count"), F.lit(0)).alias("tokens"),
    )
    return with_quantiles(g, rows, by, "latency_ms", {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99}, discrete=True)


def contract_issues(rows: DataFrame, sections: Sequence[str]) -> DataFrame:
    """``issues``: what breaks the answer's contract.

    ``rows`` have a text column for each section, ``factor_ids`` (array), ``allowed_ids`` (array), ``required_ids``
    (array, null if no order is asked) and ``language_ok``.
    """
    ids = F.coalesce("factor_ids", F.array().cast("array<string>"))
    rules = [(f"MISSING_{s.upper()}", F.coalesce(F.length(F.trim(s)), F.lit(0)) == 0) for s in sections]
    rules += [
        ("DUPLICATE_FACTOR", F.size(F.array_distinct(ids)) < F.size(ids)),
        ("FACTOR_NOT_ALLOWED", F.size(F.array_except(ids, F.col("allowed_ids"))) > 0),
        ("FACTOR_COUNT", F.col("required_ids").isNotNull() & (F.size("required_ids") != F.size(ids))),
        ("FACTOR_ORDER", F.col("required_ids").isNotNull() & (F.size("required_ids") == F.size(ids)) & (F.col("required_ids") != ids)),
        ("LANGUAGE", ~F.coalesce("language_ok", F.lit(False))),
    ]
    return rows.withColumn("issues", reasons_of(rules))


def duplicate_sentence_rate(text: F) -> F:
    """The share of sentences that repeat an earlier one, normalised; 0 of none."""
    from ..functions.texts import ascii_normal

    parts = F.filter(F.transform(F.split(text, r"[.!?]+(\s|$)"), lambda s: ascii_normal(s)), lambda s: s != "")
    return F.when(F.size(parts) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(parts)) / F.greatest(F.size(parts), F.lit(1)))
