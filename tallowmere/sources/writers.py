"""Writers, manifests of content, and receipts of stages."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .readers import digests


def parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, replaced as a whole when the job is done; partitioned by ``by``."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def twelve_digits(c: Column) -> Column:
    """The number in at most twelve significant digits, without zeros at the end of the fraction."""
    text = F.format_string("%.12g", c.cast("double"))
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1"))


def csv(df: DataFrame, path: str) -> None:
    """CSV with twelve significant digits for real numbers, alike in every run; as many files as partitions."""
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    df.withColumns({c: twelve_digits(F.col(c)) for c in real}).write.mode("overwrite").options(header="true").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One object a line, its fields in the order of their names, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(name, bytes, sha256)`` of the data files below ``path``, each by its place below it: equal names in two folders are two files."""
    base = re.sub("^[A-Za-z0-9]+:/*", "/", path).rstrip("/")
    d = digests(spark, path).withColumn("name", F.regexp_replace("path", f"^.*?{re.escape(base)}/", ""))
    return d.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]")).select("name", "bytes", "sha256")


def drift(locked: DataFrame, now: DataFrame) -> DataFrame:
    """Files of two manifests that differ: added, removed or changed."""
    j = locked.alias("a").join(now.alias("b"), F.col("a.name") == F.col("b.name"), "full_outer")
    kind = F.when(F.col("a.name").isNull(), "added").when(F.col("b.name").isNull(), "removed").when(F.col("a.sha256") != F.col("b.sha256"), "changed")
    return j.select(F.coalesce("a.name", "b.name").alias("name"), kind.alias("change")).where("change is not null")


def assert_locked(locked: DataFrame, now: DataFrame) -> None:
    """Fail if any locked input has drifted."""
    bad = [f"{r['name']}: {r['change']}" for r in drift(locked, now).limit(20).collect()]
    if bad:
        raise ValueError("inputs have drifted: " + ", ".join(bad))


def receipt(spark: SparkSession, path: str, stage: str, inputs: DataFrame, outputs: DataFrame, rows: int) -> None:
    """One line of JSON: what a stage read and made.  A receipt is never replaced."""
    both = [json.dumps({"stage": stage, "rows": rows, "inputs": _listed(inputs), "outputs": _listed(outputs)}, sort_keys=True)]
    spark.createDataFrame([(x,) for x in both], "value string").coalesce(1).write.mode("error").text(path)


def _listed(m: DataFrame) -> list[dict]:
    """A manifest as it is written into a receipt: its files, not their rows."""
    return [r.asDict() for r in m.orderBy("name").toLocalIterator()]
