"""Metrics of generated explanations: quality, efficiency, reliability, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import flag, ratio


def _c(name: str) -> Column:
    return F.col(name)


def quality(df: DataFrame) -> DataFrame:
    """Ratios of supported, unsupported, contradicted and unverifiable claims of each generation, and its strict flags.

    Needs supported_count, unsupported_count, contradicted_count, not_verifiable_count and usable.  All ratios
    are missing without a denominator, but the end-to-end yield, which is 0 for an unusable generation.
    """
    s, u, c, v = _c("supported_count"), _c("unsupported_count"), _c("contradicted_count"), _c("not_verifiable_count")
    d = df.withColumn("resolved", s + u + c).withColumn("applicable", s + u + c + v)
    r, a = _c("resolved"), _c("applicable")
    return d.withColumns(
        {
            "resolved_faithfulness": ratio(s, r),
            "verifiability": ratio(r, a),
            "conservative_faithfulness": ratio(s, a),
            "end_to_end_yield": F.when(~_c("usable"), 0.0).otherwise(ratio(s, a)),
            "unsupported_rate": ratio(u, r),
            "contradiction_rate": ratio(c, r),
            "strictly_faithful": flag(_c("usable") & (a > 0) & (s == a)),
            "contradiction_free": flag(_c("usable") & (c == 0)),
        }
    )


def efficiency(df: DataFrame) -> DataFrame:
    """Tokens and claims a second, claims per 1000 tokens, latency of a supported claim."""
    sec = _c("latency_ms") / 1000.0
    return df.withColumns(
        {
            "tokens_per_second": ratio(_c("output_token_count"), sec),
            "claims_per_second": ratio(_c("claim_count"), sec),
            "claims_per_1000_tokens": ratio(_c("claim_count") * 1000.0, _c("total_token_count")),
            "supported_per_1000_tokens": ratio(_c("supported_count") * 1000.0, _c("total_token_count")),
            "latency_per_supported_claim_ms": ratio(_c("latency_ms"), _c("supported_count")),
        }
    )


def reliability(df: DataFrame) -> DataFrame:
    """0/1 flags of success at each step; a missing flag is 0."""
    return df.withColumns(
        {
            "runtime_success": flag(_c("runtime_status") == "SUCCESS"),
            "parse_success": flag(_c("json_parse_success")),
            "schema_success": flag(_c("schema_valid")),
            "first_pass_success": flag(_c("usable") & (_c("retry_count") == 0)),
            "needed_retry": flag(_c("retry_count") > 0),
        }
    )


def losses(df: DataFrame) -> DataFrame:
    """An exact decomposition: 1 = yield + pipeline + not_verifiable + unsupported + contradiction.

    An unusable generation, or one without an applicable claim, is all pipeline loss.
    """
    s, u, c, v = _c("supported_count"), _c("unsupported_count"), _c("contradicted_count"), _c("not_verifiable_count")
    a = s + u + c + v
    ok = _c("usable") & (a > 0)
    part = lambda x: F.when(ok, x / F.greatest(a, F.lit(1))).otherwise(0.0)
    d = df.withColumns({"yield_share": part(s), "pipeline_loss": F.when(ok, 0.0).otherwise(1.0), "not_verifiable_loss": part(v), "unsupported_loss": part(u), "contradiction_loss": part(c)})
    total = _c("yield_share") + _c("pipeline_loss") + _c("not_verifiable_loss") + _c("unsupported_loss") + _c("contradiction_loss")
    return d.withColumn("identity_holds", F.abs(total - 1) < 1e-9)


#: The metrics as data: name, unit, larger is better, definition.
DICTIONARY = (
    ("resolved_faithfulness", "ratio", True, "supported / (supported + unsupported + contradicted)"),
    ("verifiability", "ratio", True, "resolved / applicable"),
    ("conservative_faithfulness", "ratio", True, "supported / applicable"),
    ("end_to_end_yield", "ratio", True, "supported / applicable, 0 if unusable"),
    ("unsupported_rate", "ratio", False, "unsupported / resolved"),
    ("contradiction_rate", "ratio", False, "contradicted / resolved"),
    ("tokens_per_second", "1/s", True, "output tokens / latency"),
    ("latency_per_supported_claim_ms", "ms", False, "latency / supported"),
)


def dictionary(spark) -> DataFrame:
    return spark.createDataFrame(list(DICTIONARY), "metric string, unit string, larger_is_better boolean, definition string")
