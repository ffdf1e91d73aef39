"""Phrases out of nested evidence, and the texts that hold them, by an inverted index on their rarest tokens.

A text that holds a phrase, or 0.8 of its distinct tokens, lacks at most a fifth of them: of the m rarest tokens of a phrase,
m one more than it may lack, the text has one.  So a phrase is listed under these only, the rarest of all texts first, and a
token that is in most texts lists no phrase that has rarer ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import HIGH_OVERLAP, LEAST_TOKENS, ascii_normal, match_priority, tokens


def from_packages(packages: DataFrame, package: str, evidence: str, field: str) -> DataFrame:
    """``(package, place, text)``: the texts of ``field`` in each package's list of structs, in their normal form; empty ones are left out."""
    p = packages.select(package, F.posexplode(evidence).alias("place", "e")).select(package, F.col("place").cast("long").alias("place"), ascii_normal(F.col(f"e.{field}")).alias("text"))
    return p.where("text <> ''")


def _words(df: DataFrame, key: list[str]) -> DataFrame:
    return df.select(*key, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))


def candidates(texts: DataFrame, text_id: str, phrases: DataFrame, key: list[str]) -> DataFrame:
    """``(text_id, key)``: the pairs that can match; ``texts`` and ``phrases`` have normalised ``text``.

    Rarity is counted over all texts.  Tokens that no phrase has are dropped before they are counted.
    """
    p = _words(phrases, key)
    own = _words(texts, [text_id]).join(p.select("token").distinct(), "token", "left_semi")
    df = own.groupBy("token").agg(F.count("*").alias("df"))
    sized = p.join(df, "token", "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("t"))
    n = F.size("t")
    listed = sized.select(*key, F.explode(F.slice("t", 1, (n - F.ceil(n * HIGH_OVERLAP - 1e-9) + 1).cast("int"))["token"]).alias("token"))
    return own.join(listed, "token").select(text_id, *key).distinct()


def matches(texts: DataFrame, text_id: str, phrases: DataFrame, key: list[str]) -> DataFrame:
    """``(text_id, key, match_type, coverage)`` of all pairs that match: EXACT, CONTAINED or HIGH_OVERLAP.

    A phrase's words are looked for in the text as it stands, which is not cut into words for each pair; what shares too few is dropped first.
    """
    said = phrases.select(*key, F.col("text").alias("__phrase"), F.array_distinct(tokens(F.col("text"))).alias("__said"))
    stands = texts.select(text_id, "text", F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("__whole"))
    j = candidates(texts, text_id, phrases, key).join(said, key).join(stands, text_id)
    found = F.filter("__said", lambda w: F.col("__whole").contains(F.concat(F.lit(" "), w, F.lit(" "))))
    j = j.withColumn("coverage", F.size(found) / F.size("__said")).where(F.col("coverage") >= HIGH_OVERLAP)
    whole = F.col("__whole").contains(F.concat(F.lit(" "), F.col("__phrase"), F.lit(" ")))
    long = F.size(tokens(F.col("__phrase"))) >= LEAST_TOKENS
    kind = F.when(F.col("text") == F.col("__phrase"), "EXACT").when(long & whole, "CONTAINED").when(long, "HIGH_OVERLAP").otherwise("NONE")
    return j.select(text_id, *key, kind.alias("match_type"), "coverage").where("match_type <> 'NONE'")


def best(found: DataFrame, text_id: str, key: list[str]) -> DataFrame:
    """Of each text's matches the best: by kind, coverage, then key."""
    one = F.min(F.struct(match_priority(F.col("match_type")).alias("priority"), (-F.col("coverage")).alias("less"), *key, "match_type"))
    g = found.groupBy(text_id).agg(one.alias("b"), F.count("*").alias("matches"))
    return g.select(text_id, "matches", "b.match_type", (-F.col("b.less")).alias("coverage"), *[F.col(f"b.{k}").alias(k) for k in key])
