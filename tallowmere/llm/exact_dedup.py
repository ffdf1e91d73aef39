"""Exact dedup: a persistent index of digests, bucketed and sorted by the digest.

New data meets the index in a sort-merge anti-join on the digest and what is new is appended, so a
run costs its own rows and one pass over the index, which is not shuffled: Spark reads its buckets
as the partitions of the join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANKS, Scratch, free, least_of_each, removed, repeated, setting, shared_dir, text_of, written


def normalised(column: str = "text"):
    """The text with each run of blanks as one space; null counts as empty."""
    return F.regexp_replace(text_of(column), BLANKS, " ")


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, copies)``: rows with one id and one normalised text are counted together."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(), 256)).alias("digest"))
    return d.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))


class DigestIndex:
    """``(digest, keep_id, batch)`` in a bucketed, sorted Parquet table at ``path``.

    Opening an existing ``path`` reads what earlier runs and sessions appended; its number of buckets
    is fixed when it is made and noted beside it.  Use it as a context: when the block ends the session
    forgets the table's name, and the files stay unless ``delete`` is asked for.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, lasting=True)
        self._restore()
        note = self._at("/_buckets")
        fs = note.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(note):
            stream = fs.open(note)
            self.buckets = stream.readInt()
            stream.close()
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            stream = fs.create(note)
            stream.writeInt(self.buckets)
            stream.close()
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self._table(self.name, self.path)

    def _at(self, suffix: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}{suffix}")

    def _restore(self) -> None:
        """What a compaction that broke off has set aside comes back."""
        fs = self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self._at()) and fs.exists(self._at("-old")):
            self._rename(self._at("-old"), self._at())

    def _rename(self, a, b) -> None:
        """A rename that fails where the file system only says so."""
        if not a.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(a, b):
            raise OSError(f"{a} was not renamed to {b}")

    def last(self) -> int:
        """The greatest number of a batch, -1 of an empty index."""
        return self.rows().agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def _table(self, name: str, path: str) -> None:
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, batch INT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame, name: str) -> None:
        """``rows`` appended to the table, a sorted file for each bucket: a task has all rows of a bucket."""
        rows = rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
        rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(name)
        self.spark.catalog.refreshTable(name)

    def add(self, batch: DataFrame, number: int) -> None:
        """Append the digests of ``batch(doc_id, digest)`` that the index lacks, each with its least id (null if none has one).

        The index is read by buckets, which are the partitions of the merge join; while a bucket is one file
        (after the first append, and after :meth:`compact`) it isn't sorted again either.
        """
        # written first: else the anti-join would be planned below the aggregate, and a text's copies shuffled one by one
        own, path = written(batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id")))
        with setting(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
            self._append(self.new(own).withColumn("batch", F.lit(number)), self.name)
        removed(self.spark, path)

    def new(self, own: DataFrame) -> DataFrame:
        """The rows of ``own(digest, ...)`` whose digests the index lacks."""
        return own.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def compact(self) -> None:
        """Merge the files of each bucket into one.

        The whole index is written anew beside the old, then takes its place; the old one is deleted last.  If a rename fails the old
        one stays or comes back, at the latest when the index is opened again.
        """
        beside, path = f"{self.name}_compact", shared_dir(self.spark)
        self._table(beside, path)
        # as plain files: of a bucketed table Spark would leave out the shuffle, and then the buckets too
        self._append(self.spark.read.schema(self.rows().schema).parquet(self.path), beside)
        self.spark.sql(f"DROP TABLE {beside}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = at(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        stream = fs.create(at(f"{path}/_buckets"))  # the new index is whole before the old one moves
        stream.writeInt(self.buckets)
        stream.close()
        self.drop()
        self._rename(self._at(), self._at("-old"))
        try:
            self._rename(at(path), self._at())
        except Exception:
            self._restore()
            self._table(self.name, self.path)
            raise
        removed(self.spark, f"{self.path}-old")
        self._table(self.name, self.path)

    def drop(self, delete: bool = False) -> None:
        """Forget the table's name; the files stay unless they are to be deleted."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if delete:
            removed(self.spark, self.path)


def _ranges(d: DataFrame, batches: int) -> list:
    """Conditions on doc_id that split the rows into ``batches`` consecutive ranges; null ids come last."""
    if batches < 2:
        return [F.lit(True)]
    cuts = sorted(set(d.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.05)))
    found, low = [], None
    for c in [int(c) for c in cuts]:
        found.append((F.col("doc_id") <= c) if low is None else (F.col("doc_id") > low) & (F.col("doc_id") <= c))
        low = c
    found.append(F.lit(True) if low is None else (F.col("doc_id") > low) | F.col("doc_id").isNull())
    return found


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """``(doc_id, digest, copies, keep_id, group_size, new)``: a row for each id and text of ``docs``.

    ``new``: the index had not had the text before this call.  The rows enter the index in ``batches`` runs by ascending id, as a growing corpus would, so of
    equal texts the least id stays.  ``group_size`` counts the rows of ``docs``, repeated ones too;
    against an index with older data ``keep_id`` may be a document of an earlier run.  Without an
    ``index`` one is made, reopened for each run as another session would, and deleted at the end.  A third of all
    rows may share a text: they are counted before any shuffle and both join sides are shuffled,
    so that Spark splits the large partition.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        d = scratch.keep(digests(docs))
        own = None if index else DigestIndex(spark)
        first = (index or own).last() + 1
        for number, rows in enumerate(_ranges(d, batches)):
            if own and number:
                # as the next run would find it
                own.drop()
                own = DigestIndex(spark, own.path)
            (index or own).add(d.where(rows), first + number)
        sizes = d.groupBy("digest").agg(F.sum("copies").alias("group_size"))
        kept = scratch.keep((index or own).rows().select("digest", "keep_id", (F.col("batch") >= first).alias("new")).hint("merge").join(sizes, "digest"))
        if own:
            own.drop(delete=True)
    return d.join(kept, "digest").select("doc_id", "digest", "copies", "keep_id", "group_size", "new")


def exact_dedup_report(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of blanks became one space; null is empty.  Rows that
    repeat id and text each give a row, of which one is kept.  Null ids come last: one of them is
    kept only where no document of the group has an id.  Of a text that an older ``index`` knows no row is kept, and its
    ``keep_id`` is the one of then.  No rows give no rows.
    """
    g = exact_groups(docs, index, batches)
    one = repeated(g, "copies", "copy")
    return one.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """``docs`` without the rows that repeat a text, all columns as they were, whatever their names.

    The row with the least id stays, a null id only where no copy has one; of rows with one id and text the one with the
    least hash of all its columns stays, so reruns agree.  Of a text that an older ``index`` knows no row stays.  Null is the empty text.
    No rows give no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        g = exact_groups(docs, index, batches).where("new and doc_id <=> keep_id").select("doc_id", "digest", "copies")
        g = scratch.keep(g)
    own = free("own", docs)
    k = {c: free(f"kept_{c}", docs) for c in ("doc_id", "digest", "copies")}
    g = g.withColumnsRenamed(k)
    d = docs.withColumn(own, F.unhex(F.sha2(normalised(), 256)))
    on = (d[own] == g[k["digest"]]) & d["doc_id"].cast("long").eqNullSafe(g[k["doc_id"]])
    once = d.join(g.where(F.col(k["copies"]) == 1), on, "left_semi")
    several = g.where(F.col(k["copies"]) > 1)
    if not several.isEmpty():
        once = once.unionByName(least_of_each(d.join(several, on, "left_semi"), [own, "doc_id"]))
    return once.drop(own)
