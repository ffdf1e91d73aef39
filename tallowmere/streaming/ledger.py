"""Batches of a stream written once each, whatever breaks off: a folder for each batch, and a ledger of attempts.

Spark gives a batch that was not committed to the checkpoint again, with the same number and the same rows.  Its rows go to the folder of that number, which
a second attempt writes anew, and only then does the ledger say that it is whole.  Readers take the batches that the ledger has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "batch long, attempt long, status string, rows long, digest string"


def _read(spark: SparkSession, path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: a row STARTED for each attempt at a batch, a row WRITTEN for each that ended."""
    return _read(spark, f"{path}/ledger")


def written(spark: SparkSession, path: str) -> DataFrame:
    """The last whole attempt of each batch: batch, attempt, rows, digest."""
    return attempts(spark, path).where("status = 'WRITTEN'").groupBy("batch").agg(F.max_by(F.struct("attempt", "rows", "digest"), "attempt").alias("x")).select("batch", "x.*")


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches, with their ``batch``."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(written(spark, path).select("batch"), "batch", "left_semi")


def sink(path: str, digest: Callable[[DataFrame], DataFrame], before_commit: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: writes a batch's rows to ``path`` once, and the ledger.

    ``digest`` gives one row (rows, digest) of a table.  A batch that the ledger already has whole, with the same digest, is not written again; with another digest
    it fails, as a repeated batch must have the rows it had.  ``before_commit`` is called between the rows and the ledger (for tests of what breaks off).
    """

    def run(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            own = digest(rows).first()
            last = {r.batch: r for r in written(spark, path).where(F.col("batch") == number).collect()}
            if number in last:
                if last[number].digest != own.digest:
                    raise ValueError(f"batch {number} came again with other rows")
                return
            attempt = attempts(spark, path).where((F.col("batch") == number) & (F.col("status") == "STARTED")).count() + 1
            note = lambda status: spark.createDataFrame([(number, attempt, status, own.rows, own.digest)], LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")
            note("STARTED")
            rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            if before_commit:
                before_commit(number)
            note("WRITTEN")
        finally:
            rows.unpersist()

    return run
