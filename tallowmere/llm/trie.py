"""The prefix trie of conversations, by radix partitioning on the most significant turn first.

Turns become numbers of a dictionary, conversations strings of such numbers; alike strings are one row
from then on.  A bucket holds the strings that share a prefix.  Buckets with many turns are split by
Spark, round after round: the least and the greatest string of a bucket tell how far all its strings
agree, so that each round goes down to a node with several continuations, and the next number deals the strings to
smaller buckets.  Buckets with few turns go to one task each, which sorts them by multikey quicksort; its
recursion emits their nodes.  Counts of leaves and saved words come up from the buckets again.

A node is known by its depth and its least member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import NOT_BLANKS, Scratch, small_batches, text_of

#: Turns of a bucket that one task finishes: a few MB of numbers.
LOCAL = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "top_conv long, top_depth long"
)


def encoded(conversations: DataFrame, keep: Scratch) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as (id, words), by a dictionary of all (role, text).

    Numbers ascend with the turns' SHA-256, so that turns of one place always come in the same order.  A row
    without conv_id belongs to no conversation.
    """
    role, text = text_of("role"), text_of("text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    t = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), digest.alias("digest"), F.regexp_count(text, F.lit(NOT_BLANKS)).cast("long").alias("words")
    )
    t = keep.write(t)
    ids = keep.write(t.select("digest").distinct().orderBy("digest").select("digest", F.monotonically_increasing_id().alias("id")))
    own = t.join(ids, "digest").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "id", "words"))).alias("turns"))
    return own.select("conv_id", F.transform("turns", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))


def with_common_starts(own: DataFrame, share: int = 20, longest: int = 4) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % ``share`` instead of its own, h = crc32(c) % ``longest``."""
    h = (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int")
    heads = own.where(F.col("conv_id") % share == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, longest - 1).alias("head"))
    both = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % share}).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), 1, F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    at = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield at, i
            at = i


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and conv_id: the ids of each key in a batch, joined, and the first of them."""
    for b in batches:
        keys, ids = b.column("key").to_pylist(), b.column("conv_id").to_pylist()
        out = [(keys[i], ids[i], ",".join(map(str, ids[i:j]))) for i, j in _runs(keys)]
        yield pa.record_batch([list(c) for c in zip(*out, strict=True)] or [[], [], []], names=["key", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by key and first id: the SHA-256 of each key's whole list, hashed as it streams by."""
    key, h = None, None
    for b in batches:
        done: tuple[list, list] = ([], [])
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if k != key:
                if h is not None:
                    done[0].append(key), done[1].append(h.hexdigest())
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.record_batch([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["key", "ends"])
    if h is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["key", "ends"])


def distinct_strings(convs: DataFrame, keep: Scratch) -> DataFrame:
    """(turns, n, conv, ends): alike conversations once, their number, least id and the digest of their ids.

    The ids of large groups are sorted by ranges and joined to pieces where they lie; only the pieces of a
    group meet in one task, which hashes them as they come.
    """
    key = F.unhex(F.sha2(F.concat(F.lit("t"), F.array_join(F.transform("turns", lambda x: x["id"].cast("string")), ",")), 256))
    c = keep.write(convs.withColumn("key", key))
    g = c.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("turns").alias("turns"))
    g = keep.write(g)
    many = c.select("key", "conv_id").join(g.where("n > 1").select("key"), "key")
    pieces = many.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, ids string")
    ends = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends string")
    one = F.sha2(F.col("conv").cast("string"), 256)
    return g.join(ends, "key", "left").select("turns", "n", "conv", F.coalesce("ends", one).alias("ends"))


def _quicksort(rows: list[tuple[list[int], list[int], int, int, str]], depth: int) -> list[list]:
    """The nodes of strings (ids, words, n, conv, ends) that agree on their first ``depth`` numbers, those deeper than that.

    Three-way partitions by the number at one depth: less, equal, greater; the equal ones are a node and go
    on one number deeper.  A node is [conv, depth, place of its parent, n, children, leaves, saved, ends].
    """
    nodes: list[list] = []
    work = [(list(range(len(rows))), depth, -1)]
    while work:
        some, d, up = work.pop()
        if up >= 0 and some:
            for i in [i for i in some if len(rows[i][0]) == d]:
                nodes[up][7] = rows[i][4]
        some = [i for i in some if len(rows[i][0]) > d]
        if not some:
            continue
        pivot = sorted(rows[some[k]][0][d] for k in (0, len(some) // 2, -1))[1]
        less, equal, more = [], [], []
        for i in some:
            x = rows[i][0][d]
            (equal if x == pivot else less if x < pivot else more).append(i)
        n = sum(rows[i][2] for i in equal)
        nodes.append([min(rows[i][3] for i in equal), d + 1, up, n, 0, 0, (n - 1) * rows[equal[0]][1][d], NOTHING])
        work += [(less, d, up), (more, d, up), (equal, d + 1, len(nodes) - 1)]
    for x in reversed(nodes):
        x[5] = x[5] or 1
        if x[2] >= 0:
            up = nodes[x[2]]
            up[4] += 1
            up[5] += x[5]
            up[6] += x[6]
    return nodes


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of local buckets, whose rows come sorted by bucket."""
    names, types = [f.split()[0] for f in NODE.split(", ")], [pa.int64()] * 7 + [pa.string()] + [pa.int64()] * 2

    def emit(key: tuple, rows: list) -> list[tuple]:
        top_conv, top_depth, depth, _ = key
        nodes = _quicksort(rows, depth)
        return [(x[0], x[1], top_conv if x[2] < 0 else nodes[x[2]][0], *x[3:], *((top_conv, top_depth) if x[2] < 0 else (None, None))) for x in nodes]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)

    key, rows, out = None, [], []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("b_conv", "b_depth", "lcp", "digit", "ids", "words", "n", "conv", "ends")]
        for *k, ids, words, n, conv, ends in zip(*cols, strict=True):
            if tuple(k) != key:
                if rows:
                    out += emit(key, rows)
                    if len(out) > 10_000:
                        yield batch(out)
                        out = []
                key, rows = tuple(k), []
            rows.append((ids, words, n, conv, ends))
    if rows:
        out += emit(key, rows)
    if out:
        yield batch(out)


def _agree(a: Column, b: Column) -> Column:
    """How many turns two strings begin with alike."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x["id"] == y["id"], F.lit(False))), False).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b)))


def _split(rows: DataFrame, local: int, keep: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round over large buckets: their top nodes, the rows of small and of large buckets below these, and the latter's parents."""
    bucket = ["b_conv", "b_depth"]
    top = rows.groupBy(*bucket).agg(F.sum("n").alias("n"), F.min(F.struct("turns", "ends")).alias("lo"), F.max("turns").alias("hi"))
    top = top.withColumn("lcp", _agree(F.col("lo.turns"), F.col("hi")))
    top = keep.keep(top.select(*bucket, "n", "lcp", F.slice("lo.turns", 1, F.col("lcp")).alias("turns"), F.when(F.size("lo.turns") == F.col("lcp"), F.col("lo.ends")).alias("ends")))
    below = rows.join(top.select(*bucket, "lcp"), bucket).where(F.size("turns") > F.col("lcp"))
    below = below.withColumn("digit", F.get("turns", F.col("lcp"))["id"])
    key = [*bucket, "lcp", "digit"]
    large = below.groupBy(*key).agg(F.min("conv").alias("least"), F.sum(F.size("turns") - F.col("lcp")).alias("left")).where(F.col("left") > local)
    large = keep.write(large.drop("left"))
    small = below.join(large, key, "left_anti").select(*key, "turns", "n", "conv", "ends")
    deeper = below.join(large, key).select("turns", "n", "conv", "ends", F.col("least").alias("b_conv"), (F.col("lcp") + 1).alias("b_depth"))
    links = large.select(F.col("least").alias("b_conv"), (F.col("lcp") + 1).alias("b_depth"), F.col("b_conv").alias("top_conv"), F.col("b_depth").alias("top_depth"))
    return top, keep.write(small), keep.write(deeper), links


def _chain(top: DataFrame) -> DataFrame:
    """The nodes from the entry of a large bucket down to where its strings part."""
    saved = F.sum("own").over(Window.partitionBy("b_conv", "b_depth").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    each = top.select("*", F.explode(F.sequence("b_depth", "lcp")).alias("depth"))
    words = F.coalesce(F.try_element_at("turns", F.nullif("depth", F.lit(0)))["words"], F.lit(0))
    each = each.withColumn("own", (F.col("n") - 1) * words)
    last = F.col("depth") == F.col("lcp")
    return each.select(
        F.col("b_conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == F.col("b_depth"), F.col("top_conv")).otherwise(F.col("b_conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (saved + F.col("saved")).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends")), F.lit(NOTHING)).alias("ends_sha256"),
    )


def trie(convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes of the prefix trie of ``convs(conv_id, turns)``, ``turns`` an array of (id, words).

    Returns conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 of each node, the root (depth 0) among them.  No conversations give no rows.  Buckets of up to
    ``local`` turns are finished in one task; a conversation's numbers (16 bytes a turn) must fit a row.
    """
    spark = convs.sparkSession
    small_batches(spark)
    keep = Scratch(spark)
    with keep:
        g = keep.write(distinct_strings(convs, keep))
        least = g.agg(F.min("conv")).first()[0]
        rows = g.withColumns({"b_conv": F.lit(least).cast("long"), "b_depth": F.lit(0)})
        links = rows.select("b_conv", "b_depth", F.lit(None).cast("long").alias("top_conv"), F.lit(None).cast("int").alias("top_depth")).limit(1)
        tops, smalls = [], []
        while not rows.isEmpty():
            top, small, rows, below = _split(rows, local, keep)
            tops.append((top, links))
            smalls.append(small)
            links = below
        if not smalls:
            return spark.createDataFrame([], NODE).drop("top_conv", "top_depth")
        small = reduce(DataFrame.unionByName, smalls)
        own = small.withColumns({"ids": F.transform("turns", lambda x: x["id"]), "words": F.transform("turns", lambda x: x["words"])}).drop("turns")
        key = ["b_conv", "b_depth", "digit"]
        nodes = keep.keep(own.repartition(*key).sortWithinPartitions(*key).mapInArrow(_finished, NODE))
        entries = nodes.where("top_conv IS NOT NULL").select("top_conv", "top_depth", "n_leaves", "saved_tokens")
        whole = []
        for top, up in reversed(tops):
            kids = entries.groupBy(F.col("top_conv").alias("b_conv"), F.col("top_depth").cast("int").alias("b_depth"))
            kids = kids.agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            t = top.join(up, ["b_conv", "b_depth"]).join(kids, ["b_conv", "b_depth"], "left")
            t = keep.keep(t.fillna(0, ["kids", "saved"]).fillna(1, ["leaves"]))
            whole.append(_chain(t))
            below_entry = F.aggregate(F.slice("turns", F.greatest("b_depth", F.lit(1)), F.col("lcp")), F.lit(0).cast("long"), lambda so, x: so + x["words"])
            entries = entries.unionByName(t.select("top_conv", F.col("top_depth").cast("long").alias("top_depth"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * below_entry).alias("saved_tokens")))
        return reduce(DataFrame.unionByName, [nodes.drop("top_conv", "top_depth"), *whole])


def rebuilt_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of conversations whose first turns come from others, see :func:`with_common_starts`."""
    with Scratch(conversations.sparkSession) as keep:
        return trie(with_common_starts(keep.write(encoded(conversations, keep))), local)


def conversation_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)`` as they are.

    A null role or text is empty, a null turn comes first, turns of one place come in the order of their SHA-256,
    repeated ones each count; rows without conv_id are left out; further columns don't matter.  No rows give no rows.
    """
    with Scratch(conversations.sparkSession) as keep:
        return trie(encoded(conversations, keep), local)
