"""A bounded sample of labelled texts to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, text_of, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[DataFrame, str]:
    """``(text, label, fold)`` of about ``most`` labelled rows at most, and the folder that holds them.

    Only rows that are not held out and whose label is not null count; ``fold`` is crc32 mod 4 (0, 1 or
    3).  Where more are labelled, the ones with the smallest hashes of the id are taken, the same in
    each run.  The sample's ids, not all labels, are broadcast: ``most`` bounds them.  A document with
    several labels has the largest; of several texts under one id the one with the least hash counts, so
    that no id adds more than a row.
    """
    own = labels.where(~held_out() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    own = own.select(F.col("doc_id").alias("__id"), "label")
    share = most / max(1, own.count())
    if share < 1:
        own = own.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("__id"))
    fold = (F.crc32(F.col("__id").cast("string")) % 4).cast("int")
    one = rows.groupBy("__id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return written(one.select("t.text", "label", fold.alias("fold")))
