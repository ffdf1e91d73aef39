"""Mixing sources to target weights by weighted fair queueing, in DataFrames only.

Each source's documents are shuffled by a hash of their id.  A document's virtual finish time is the
source's words so far, its own included, over the source's target; a source that must give more than it
has starts over.  Sorted by ranges of finish time, all sources progress in proportion to their targets,
and the mix is the longest beginning of that order whose words fit the total budget.

Running totals are made in ranges of the order: each range is summed, the sums are totalled level by level in
groups of ``FAN``, and the rows of a range go on from where it starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import NOT_BLANKS, Scratch, free, least_of_each, repeated, row_hash, text_of

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
SALT = "mix"
#: Parts of a running total that are added up at a time.
FAN = 1_000


def words(column: str = "text") -> Column:
    """How many runs of other characters than blanks the text has; null has none."""
    return F.regexp_count(text_of(column), F.lit(NOT_BLANKS)).cast("long")


def shuffle_key(column: str = "doc_id", salt: str = SALT) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(f":{salt}")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, a row for each source.

    The total of all sizes is shared by weight, the weights taken in turn by code point with null
    last.  A target stops at ``repeats`` times the source's size and the excess is reshared by weight
    until no target is above: so there is one level, and each target is the smaller of its cap and
    weight times level.  Sources in order of cap over weight, the level is what the full ones before
    leave, over the weights of the rest, at the first source whose cap isn't below it.  A source
    without words gets 0.  Rows here are sources, not documents.
    """
    n = len(weights)
    turn = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(turn) - 1) % n + 1)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    s = s.withColumn("caps", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.col("caps")) / F.col("rest"))
    s = s.withColumn("level", F.min(F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _starts(sums: DataFrame, group: list[str], bucket: str, buckets: int) -> DataFrame:
    """``sums(group, bucket, __sum)`` with ``__start``, the sum of the group's buckets before; no task totals more than ``FAN`` of them."""
    if buckets <= FAN:
        before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
        return sums.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    upper = f"{bucket}_"
    s = sums.withColumn(upper, F.floor(F.col(bucket) / FAN))
    before = W.partitionBy(*group, upper).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("__within", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    above = _starts(s.groupBy(*group, upper).agg(F.sum("__sum").alias("__sum")), group, upper, -(-buckets // FAN))
    keys = [*group, upper]
    above = above.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("__start").alias("__above"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return s.join(above, on).select(*group, bucket, "__sum", (F.col("__within") + F.col("__above")).alias("__start"))


def _running(rows: DataFrame, group: list[str], bucket: str, buckets: int, order: list[Column], size: str, name: str) -> DataFrame:
    """A running total of ``size`` by ``group`` in the order of ``bucket`` and then ``order``; groups are compared null-safely."""
    keys = [*group, bucket]
    starts = _starts(rows.groupBy(*keys).agg(F.sum(size).alias("__sum")), group, bucket, buckets)
    starts = starts.select(*[F.col(c).alias(f"__{c}") for c in keys], "__start")
    own = F.sum(size).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return rows.withColumn("__own", own).join(starts, on).withColumn(name, F.col("__own") + F.col("__start")).drop("__own", "__start", *[f"__{c}" for c in keys])


def _units(docs: DataFrame) -> DataFrame:
    """Rows alike in all columns once, with their number."""
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"),
        F.xxhash64(text_of()).alias("text_hash"), row_hash(docs).alias("row"), shuffle_key().alias("key"),
    )
    return d.groupBy("doc_id", "source", "size", "text_hash", "row", "key").agg(F.count("*").alias("alike"))


UNIT = ("source", "doc_id", "size", "text_hash", "row", "nth")


def _in_ranges(rows: DataFrame, order: list[Column], columns: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows`` in ranges of the order, ``part`` numbers them as they follow each other; and how many there may be.

    The order ends in what tells rows apart, so rows that share an id, a text or everything are spread over ranges too.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    return scratch.write(ranged.select(*columns, "part")), parts


def _schedule(docs: DataFrame, weights: tuple[float, ...], repeats: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Every row with its source's target and its running total; the copies in the mix, each with its finish time and ``end``, the mix's words up to it; and the budget."""
    u = scratch.write(_units(docs))
    sources = scratch.keep(targets(u.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size")), weights, repeats))
    total = u.agg(F.coalesce(F.sum(F.col("size") * F.col("alike")), F.lit(0))).first()[0]
    named = sources.select(F.col("source").alias("__s"), "source_size", "target")
    own = [F.col("key"), F.col("size"), F.col("text_hash"), F.col("row"), F.col("nth")]
    one, parts = _in_ranges(repeated(u, "alike", "nth"), [F.col("source").asc_nulls_last(), *own], [*UNIT, "key", "alike"], scratch)
    one = _running(one, ["source"], "part", parts, own, "size", "upto")
    one = scratch.keep(one.join(named, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s", "part"))
    times = F.least(F.ceil(F.col("target") / F.col("source_size")), F.lit(repeats)).cast("int")
    offered = one.where("size > 0 and target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), times - 1)))
    offered = offered.withColumn("finish", (F.col("upto") + F.col("pass") * F.col("source_size")) / F.col("target"))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), *own]
    ranged, parts = _in_ranges(offered, order, [*UNIT, "key", "alike", "finish"], scratch)
    chosen = _running(ranged, [], "part", parts, order, "size", "end").where(F.col("end") <= total)
    return one, scratch.keep(chosen.select(*UNIT, "alike", "finish", "end")), total


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """What the mix takes of each row of ``docs``.

    Columns: doc_id, source, size (words), text_hash, source_size, target (its source's), taken (words
    that the mix takes, repeats counted), copies (how often it takes the whole document), finish
    (virtual time of its first copy; null for sources without target).  Documents are taken whole, at
    most ``repeats`` times, so a source ends within a document of its target.  Equal ids of one source
    are ordered by size, a hash of the text and one of the whole row; only rows alike in all columns are interchangeable.
    Documents without words take none.  No rows give no rows; reruns agree.
    """
    with Scratch(docs.sparkSession) as scratch:
        one, chosen, _ = _schedule(docs, weights, repeats, scratch)
    copies = chosen.groupBy(*UNIT).agg(F.count("*").alias("copies")).withColumnsRenamed({k: f"__{k}" for k in UNIT})
    out = one.join(copies, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in UNIT], "left")
    n = F.coalesce("copies", F.lit(0))
    finish = F.col("upto") / F.when(F.col("target") > 0, F.col("target"))
    return out.select("doc_id", "source", "size", "text_hash", "nth", "source_size", "target", (F.col("size") * n).alias("taken"), n.alias("copies"), finish.alias("finish"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix itself, in its order: each row of ``docs`` as often as it is taken, all columns as they were.

    Partitions follow each other in the order of finish times and are sorted within, so that any beginning of
    the written files has the sources in proportion to their targets.  A partition has the same share of
    the words as any other; there are as many as the session has shuffle partitions.  Ties, repeated rows,
    nulls and empty tables are as in :func:`mix`.
    """
    with Scratch(docs.sparkSession) as scratch:
        _, chosen, total = _schedule(docs, weights, repeats, scratch)
    k = {c: free(f"mix_{c}", docs) for c in ("doc_id", "source", "row", "alike", "end")}
    m = chosen.select(*[F.col(c).alias(name) for c, name in k.items()])
    own = free("own", docs)
    d = docs.withColumn(own, row_hash(docs))

    def same(a: DataFrame) -> Column:
        return a["doc_id"].cast("long").eqNullSafe(m[k["doc_id"]]) & a["source"].cast("string").eqNullSafe(m[k["source"]]) & (a[own] == m[k["row"]])

    out = d.join(m.where(F.col(k["alike"]) == 1), same(d))
    several = m.where(F.col(k["alike"]) > 1)
    if not several.isEmpty():
        # rows alike in all columns: one of them is repeated as often as all are taken
        one = least_of_each(d.join(several, same(d), "left_semi"), ["doc_id", "source", own])
        out = out.unionByName(one.join(several, same(one)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.least(F.floor(F.col(k["end"]) * parts / F.lit(max(1, total))), F.lit(parts - 1)).cast("int")
    return out.repartitionById(parts, slot).sortWithinPartitions(k["end"]).select(*[F.col(f"`{c}`") for c in docs.columns])
