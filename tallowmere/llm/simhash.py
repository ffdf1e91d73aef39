"""SimHash near-dedup through Golay-code fuzzy keys.

A fingerprint has 64 bits, split into three segments of 22, 21 and 21.  If two fingerprints differ in
at most two bits, then for one of the ordered pairs (first, second), (second, third), (third, first)
the earlier segment has no error and the later one at most one: the other segments hold the rest.  So
each pair gives keys: the earlier segment as it is with the indices of the codewords near the later
one (see :mod:`golay`), 1 or 6 keys of 34 bits for each pair.  Fingerprints that share a key are joined
and verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .golay import codeword_keys
from .shared import Scratch, free, least_of_each, removed, small_batches, text_of, written

SEED = 42
SHIFTS, WIDTHS = (0, 22, 43), (22, 21, 21)
PAIRS = ((0, 1), (1, 2), (2, 0))
#: Fingerprints under one key that are compared pair by pair; fuller keys go through midpoints.
BUCKET = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """The SimHash of one text (UTF-8), signed: bit i is set if more than half the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :] - 1
    one, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    spans = zip(starts[:n].tolist(), last.tolist(), strict=True)
    hashes = np.fromiter((one(joined[a:b], seed) for a, b in spans), np.uint64, n)
    for i in range(0, n, BLOCK):
        part = hashes[i : i + BLOCK]
        bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)``: a hash of each whole text and its fingerprint, A-Z lower-cased, both as signed longs."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = pa.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], ["doc_id", "text_hash", "fp"])

    d = docs.select(_id(), F.xxhash64(text_of()).alias("text_hash"), text_of().cast("binary").alias("text"))
    return d.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _id():
    return F.col("doc_id").cast("long").alias("doc_id")


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """``(key, fp)``: the keys of each fingerprint, 3 to 18."""

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            seg = [(fp.view(np.uint64) >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS, strict=True)]
            keys, owners = [], []
            for p, (exact, near) in enumerate(PAIRS):
                codes = codeword_keys(seg[near])
                k = (np.int64(p) << 40) | (seg[exact][:, None] << 12) | codes
                keys.append(k[codes >= 0])
                owners.append(np.broadcast_to(fp[:, None], codes.shape)[codes >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, str]:
    """``(u, v)`` links, and the folder that holds them, that connect the distinct fingerprints ``fps(fp)`` as all pairs within two bits do.

    A key of two fingerprints is verified as it is counted, and one of up to ``bucket`` by a join.  A
    fuller key goes another exact way that makes no pairs: two fingerprints are within two bits if,
    and only if, they share a midpoint, a word at most one bit from both.  Each fingerprint of a full
    key names its 65 midpoints, no more than 65 distinct ones meet at a midpoint, all of these are within
    two bits of each other, and each is linked to their least.
    """
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2
    with Scratch(fps.sparkSession) as scratch:
        keys = scratch.write(fuzzy_keys(fps))
        counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        counts = scratch.write(counts.where("n > 1"))
        two = counts.where("n = 2").where(near("u", "v")).select("u", "v")
        shared = keys.join(counts.where(f"n between 3 and {bucket}").select("key"), "key")
        left, right = shared.select("key", F.col("fp").alias("u")), shared.select(F.col("key").alias("k"), F.col("fp").alias("v"))
        pairs = left.join(right, (F.col("key") == F.col("k")) & (F.col("u") < F.col("v")) & near("u", "v")).select("u", "v")
        full = keys.join(counts.where(f"n > {bucket}").select("key"), "key").select("fp").distinct()
        flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
        at = full.select("fp", F.explode(flips).alias("mid")).groupBy("mid").agg(F.collect_list("fp").alias("fps"))
        at = at.where("size(fps) > 1")
        stars = at.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v").select("u", "v")
        return written(two.unionByName(pairs).unionByName(stars).distinct())


def _labelled(docs: DataFrame, shingle: int, bucket: int, scratch: Scratch, keep) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_hash, fp)`` of each row, and ``(fp, root, component_id)`` of each distinct fingerprint; ``keep`` stores both."""
    spark = docs.sparkSession
    d = keep(fingerprints(docs, shingle))
    distinct = scratch.write(d.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges, path = links(distinct, bucket)
    roots, paths = connected_components(edges)
    removed(spark, path)
    scratch.paths += paths
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = scratch.write(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return d, keep(named.join(least, "root").select("fp", "root", "component_id"))


def near_groups(docs: DataFrame, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)``: documents whose fingerprints link at two or fewer differing bits, directly or through others.

    One row per row of ``docs``; ``component_id`` is the least id of the component.  Texts with no word
    have fingerprint 0 and link as any other; null counts as empty, null ids are members but never name
    a component unless it has no other.  Copies share a fingerprint, so only distinct ones are keyed.
    No rows give no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        d, label = _labelled(docs, shingle, bucket, scratch, scratch.keep)
    return d.join(label, "fp").select("doc_id", "fp", "component_id")


def near_report(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint as 16 lower-case hex digits, component_id; see :func:`near_groups`."""
    return near_groups(docs, shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they were, whatever their names.

    Rows are told apart by id and text, so rows that share an id but not a text are judged each on its
    own.  The row with the least id stays, of several with that id the one with the least hash of its
    text; a null id comes last.  Of rows alike in id and text the one with the least hash of all its columns
    stays, so reruns agree.  No rows give no rows.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        d, label = _labelled(docs, shingle, bucket, scratch, scratch.write)
        rows = d.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("n"))
        rows = scratch.write(rows.join(label.select("fp", "root"), "fp"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
        stays = rows.groupBy("root").agg(first).select("root", "first.doc_id", "first.text_hash")
        stays = stays.withColumnsRenamed({c: f"__{c}" for c in stays.columns})
        same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__text_hash"))
        judged = rows.join(stays, F.col("root") == F.col("__root")).withColumn("__stays", same)
        # what leaves, and what repeats: both are few beside the rows that stay as they are
        odd = judged.where("not __stays or n > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__stays")
        odd = scratch.keep(odd)
    own = free("own", docs)
    k = {c: free(f"odd_{c}", docs) for c in odd.columns}
    odd = odd.withColumnsRenamed(k)
    d = docs.withColumn(own, F.xxhash64(text_of()))
    match = d["doc_id"].cast("long").eqNullSafe(odd[k["__id"]]) & (d[own] == odd[k["__hash"]])
    left = d.join(odd, match, "left_anti")
    repeats = odd.where(F.col(k["__stays"]))
    if not repeats.isEmpty():
        left = left.unionByName(least_of_each(d.join(repeats, match, "left_semi"), ["doc_id", own]))
    return left.drop(own)
