"""What the operators of this package share: the shared folder, column picking, batch sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: a batch of whole texts must fit beside the others in a Python worker.
ROWS_PER_BATCH, BYTES_PER_BATCH = 500, 32 << 20
#: Words end at these characters: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANKS = r"[^\x20\x09-\x0D]+"
#: Java's regular expression of the same, for Spark's functions.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession, lasting: bool = False) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent and Spark runs in one process, a folder of this machine.  Unless it
    is ``lasting``, the folder is deleted at the latest when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallowmere-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tallowmere-{uuid.uuid4().hex}"
    if not lasting:
        p, fs = _folder(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def written(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, and the folder.

    This cuts the lineage so that it survives lost executors, and computes ``df`` only once.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete folders that :func:`written` made and nothing reads any more."""
    for path in paths:
        p, fs = _folder(spark, path)
        fs.delete(p, True)


class Scratch:
    """The tables that one run of an operator writes on its way.

    ``keep`` writes a table that the operator's lazy result still reads; :func:`released` deletes all
    such, of every operator so far.  Tables of ``write`` go when the block ends.
    """

    _kept: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        removed(self.spark, *self.paths)

    def write(self, df: DataFrame) -> DataFrame:
        df, path = written(df)
        self.paths.append(path)
        return df

    def keep(self, df: DataFrame) -> DataFrame:
        df, path = written(df)
        Scratch._kept.append((self.spark, path))
        return df


def held() -> int:
    """How many tables lazy results of this package's operators read so far."""
    return len(Scratch._kept)


def released(since: int = 0) -> None:
    """Delete the tables that results read, those after the first ``since``; call it once these results are stored."""
    while len(Scratch._kept) > since:
        spark, path = Scratch._kept.pop()
        removed(spark, path)


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings while the block runs, with ``__`` for the dots of their names; afterwards they are as before."""
    before = {}
    for k, v in values.items():
        key = k.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, v)
    try:
        yield
    finally:
        for key, v in before.items():
            spark.conf.unset(key) if v is None else spark.conf.set(key, v)


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH, size: int = BYTES_PER_BATCH) -> None:
    """Lower the session's Arrow batches to ``rows`` and ``size`` bytes where they are larger.

    Results are lazy, so the settings must still hold when they are computed: they stay lowered.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def free(name: str, *tables: DataFrame) -> str:
    """``name``, or with as many underscores behind it as it takes to be no column of the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, which settles ties alike in each run; maps and variants, which have no hash, by their JSON."""
    plain = lambda kind: not any(x in kind for x in ("map<", "variant"))
    cols = [F.col(f"`{c}`") if plain(kind) else F.to_json(F.struct(F.col(f"`{c}`"))) for c, kind in df.dtypes]
    # a null leaves a running hash as it was, so that a value could move to the next column unseen
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())])


#: Rows that one row is made to by a task; more of them are dealt to others first.
CHUNK = 10_000


def repeated(df: DataFrame, times: str, name: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1 in ``name``; no array is longer than its root, and a row of many copies is shared out."""
    few = df.where(F.col(times) <= CHUNK).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    chunk = free("chunk", df)
    many = df.where(F.col(times) > CHUNK).withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK))))
    many = many.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    last = F.least(F.col(times), (F.col(chunk) + 1) * CHUNK)
    many = many.withColumn(name, F.explode(F.sequence(F.col(chunk) * CHUNK + 1, last))).drop(chunk)
    return few.unionByName(many)


def least_of_each(df: DataFrame, by: list[str]) -> DataFrame:
    """Of the rows that agree in ``by`` the one with the least hash of all its columns; a group of any size is reduced where it lies first."""
    whole = df.withColumn(h := free("hash", df), row_hash(df))
    kept = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col(h)).alias("row")
    return whole.groupBy(*by).agg(kept).select("row.*")


def text_of(column: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(column, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2: such rows never teach a classifier.  A null id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(True))
