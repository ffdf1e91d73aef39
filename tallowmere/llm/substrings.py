"""Passages of many words that repeat across documents, by suffix trees over groups of suffixes with one prefix.

A window is 50 consecutive words.  Not every suffix goes into a tree: of the 16-word sequences in a window the one with the
least hash is its anchor, so that equal windows have the same anchor at the same place, and suffixes that begin at
anchors are all that is needed.  An anchor whose 16 words occur in one document only is dropped; of the others each brings the
words of the windows that it anchors, its context.  Contexts that are alike are one row from then on.

The 16 words are the prefix that deals suffixes to groups.  A group that fits into memory becomes a subtree, built as its
leaves in order and their common prefixes: an internal node at depth d is a run of leaves that agree on d words.  A window
that starts o words before its anchor is repeated where leaves share a node at depth 50 - o that is deep enough, and
on the left, in the tree of the words before the anchor, one at depth o.  A group that is too large is dealt
again by longer prefixes: those of whole windows, 50 words, where sharing the prefix is all there is to know.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, small_batches, text_of

#: Words of a window and of an anchor; a context's mask of windows must fit a long.
WINDOW, ANCHOR = 50, 16
SPREAD = WINDOW - ANCHOR + 1
#: Different contexts of an anchor that one task compares; more are dealt by whole windows.
LOCAL = 20_000
#: Contexts whose trees are built at once, and words whose hash a task remembers.
AT_ONCE, REMEMBERED = 20_000, 1 << 18
#: A null id counts as this one, the greatest.
LAST = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words, remembered while they are short and not too many."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 13)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _MIX) ^ (b + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _grams(words: np.ndarray) -> np.ndarray:
    """A hash of each 16 consecutive words, from pairs of pairs."""
    x, step = words, 1
    while step < ANCHOR:
        x = _mixed(x[:-step], x[step:])
        step *= 2
    return x


def _places(grams: np.ndarray) -> np.ndarray:
    """For each window the place of its anchor: the first of its least hashes."""

    def lesser(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.where(grams[p] <= grams[q], p, q)

    p, width = np.arange(len(grams)), 1
    while 2 * width <= SPREAD:
        p, width = lesser(p[:-width], p[width:]), 2 * width
    rest = SPREAD - width
    return lesser(p[:-rest], p[rest:]) if rest else p


def _anchors(text: bytes, known: _Words) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A text's words, their hashes, the hash of each 16 words, and the anchor of each window."""
    words = text.split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) < WINDOW:
        return words, h, h[:0], np.zeros(0, np.int64)
    g = _grams(h)
    return words, h, g, _places(g)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) rows with their number of words, the SHA-256 of these, and their anchors."""
    known = _Words()
    for b in batches:
        n, sha, anchors = [], [], []
        for text in b.column("text"):
            words, _, g, at = _anchors(text.as_py(), known)
            n.append(len(words)), sha.append(_sha(words)), anchors.append(_signed(np.unique(g[np.unique(at)])))
        yield pa.record_batch([b.column("doc_id"), b.column("t1"), b.column("t2"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(anchors, pa.list_(pa.int64()))], names=["doc_id", "t1", "t2", "n_words", "sha", "anchors"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each repeated anchor, consecutive ones as one row: the words they span, and the anchor's place in them."""
    known = _Words()
    for b in batches:
        for rid, doc, text, anchors in zip(b.column("rid").to_pylist(), b.column("doc").to_pylist(), b.column("text"), b.column("anchors").to_pylist(), strict=True):
            _, h, g, at = _anchors(text.as_py(), known)
            cut = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
            cut = np.column_stack([cut[:-1], cut[1:]])
            own = _signed(g[at[cut[:, 0]]])
            hit = np.isin(own, np.array(anchors, np.int64))
            for s in range(0, int(hit.sum()), 2000):
                (some, name), rows = (x[hit][s : s + 2000] for x in (cut, own)), []
                for (i, j), a in zip(some.tolist(), name.tolist(), strict=True):
                    rows.append((rid, doc, a, i, j - i, int(at[i]) - i, h[i : j - 1 + WINDOW].tobytes()))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:6]] + [pa.array([r[6] for r in rows], pa.binary())], names=["rid", "doc", "anchor", "at", "windows", "off", "words"])


def _nodes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaves (rows) in order, and on how many words each agrees with the one before: the tree's internal nodes."""
    flat = np.ascontiguousarray(words)
    order = np.argsort(flat.view(f"S{flat.shape[1] * 8}").ravel(), kind="stable")
    same = flat[order[1:]] == flat[order[:-1]]
    return order, np.r_[0, np.logical_and.accumulate(same, axis=1).sum(1)]


def repeated(words: list[bytes], off: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each context the windows (bit i: the i-th) that also start in a document with a lesser id, among these contexts.

    ``off`` is the anchor's place in a context, ``windows`` how many windows a context has.
    """
    size = len(words)
    right, left = np.zeros((size, WINDOW), np.uint64), np.zeros((size, SPREAD), np.uint64)
    for i, (raw, o) in enumerate(zip(words, off.tolist(), strict=True)):
        w = np.frombuffer(raw, np.uint64)
        r = w[o : o + WINDOW]
        right[i, : len(r)] = r
        left[i, :o] = w[:o][::-1]
    (after, deep), (before, high) = _nodes(right), _nodes(left)
    out = np.zeros(size, np.int64)
    node, other = np.empty(size, np.int64), np.empty(size, np.int64)
    for o in range(SPREAD):
        own = np.flatnonzero((off >= o) & (o > off - windows))
        if not len(own):
            continue
        node[after], other[before] = np.cumsum(deep < WINDOW - o), np.cumsum(high < o)
        order = own[np.lexsort((doc[own], other[own], node[own]))]
        new = np.r_[True, (np.diff(node[order]) != 0) | (np.diff(other[order]) != 0)]
        least = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        hit = order[doc[order] > least]
        out[hit] |= np.int64(1) << (off[hit] - o)
    return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The masks of contexts that come sorted by anchor; whole groups are compared, several at once."""
    held: list[tuple] = []

    def done(rows: list[tuple]) -> pa.RecordBatch:
        c1, c2, doc, _, off, windows, words = zip(*rows, strict=True)
        ints = [np.array(x, np.int64) for x in (off, windows, doc)]
        return pa.record_batch([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(repeated(list(words), *ints))], names=["c1", "c2", "mask"])

    for b in batches:
        held += zip(*[b.column(c).to_pylist() for c in ("c1", "c2", "doc", "anchor", "off", "windows", "words")], strict=True)
        if len(held) >= AT_ONCE:
            last = next((i for i in range(len(held) - 1, 0, -1) if held[i][3] != held[i - 1][3]), 0)
            if last:
                yield done(held[:last])
                held = held[last:]
    if held:
        yield done(held)


def _by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a context under the hash of its 50 words."""
    for b in batches:
        for c1, c2, doc, windows, words in zip(*[b.column(c).to_pylist() for c in ("c1", "c2", "doc", "windows", "words")], strict=True):
            keys = [hashlib.sha256(words[8 * i : 8 * (i + WINDOW)]).digest()[:16] for i in range(windows)]
            yield pa.record_batch([pa.array([c1] * windows, pa.int64()), pa.array([c2] * windows, pa.int64()), pa.array([doc] * windows, pa.int64()), pa.array(range(windows), pa.int32()), pa.array(keys, pa.binary())], names=["c1", "c2", "doc", "i", "key"])


def covered(n: int, starts: list[int], masks: list[int]) -> np.ndarray:
    """Which of ``n`` words lie in a window of the masks."""
    change = np.zeros(n + 1, np.int64)
    for s, mask in zip(starts, masks, strict=True):
        i = s + np.flatnonzero(np.unpackbits(np.array([mask], np.uint64).view(np.uint8), bitorder="little"))
        np.add.at(change, i, 1)
        np.add.at(change, i + WINDOW, -1)
    return np.cumsum(change[:n]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its repeated windows."""
    for b in batches:
        out = []
        for rid, text, marks in zip(b.column("rid").to_pylist(), b.column("text"), b.column("marks").to_pylist(), strict=True):
            words = text.as_py().split()
            gone = covered(len(words), [m["at"] for m in marks], [m["mask"] for m in marks])
            kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            out.append((rid, int(gone.sum()), _sha(kept), b" ".join(kept)))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string(), pa.binary())], names=["rid", "n_removed", "kept_sha256", "kept"])


def _ones(windows: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({windows} AS int)) - 1")


def _masks(contexts: DataFrame, local: int, keep: Scratch) -> DataFrame:
    """(c1, c2, mask) of different contexts: small groups by subtrees, large ones by whole windows."""
    large = keep.write(contexts.groupBy("anchor").count().where(F.col("count") > local).select("anchor"))
    small = contexts.join(large, "anchor", "left_anti").select("c1", "c2", "doc", "anchor", "off", "windows", "words")
    trees = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_subtrees, "c1 long, c2 long, mask long")
    windows = contexts.join(large, "anchor", "left_semi").select("c1", "c2", "doc", "windows", "words").mapInArrow(_by_window, "c1 long, c2 long, doc long, i int, key binary")
    windows = keep.write(windows)
    least = windows.groupBy("key").agg(F.min("doc").alias("least"))
    hit = windows.join(least, "key").where("doc > least").groupBy("c1", "c2").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    return trees.where("mask <> 0").unionByName(hit)


def repeats(docs: DataFrame, local: int = LOCAL, texts: bool = False) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_sha256, without the words of repeated windows.

    A word goes if a window of 50 words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input.  Words end at ASCII blanks and are compared as they are.  A null text has no words.  A null id
    counts as the greatest long.  Rows that share an id are parts of one document: none is smaller than the other, so
    repeats among them stay.  Texts of under 50 words keep all.  ``texts`` adds ``kept``, the words left joined by one space (null
    where nothing went).  No rows give no rows; further columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = Scratch(spark)
    with keep:
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
        rows = given.withColumn("text", F.col("text").cast("binary")).mapInArrow(_described, "doc_id long, t1 long, t2 long, n_words long, sha string, anchors array<long>")
        rows = keep.keep(rows)
        doc = F.coalesce("doc_id", F.lit(LAST)).alias("doc")
        first = rows.where(F.col("n_words") >= WINDOW).groupBy("sha").agg(F.min(F.struct(doc, "doc_id", "t1", "t2", "anchors")).alias("r"))
        first = keep.keep(first.select("sha", "r.*").withColumn("rid", F.monotonically_increasing_id()))
        each = first.select("rid", "doc", F.explode("anchors").alias("anchor"))
        twice = each.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor")
        hot = each.join(twice, "anchor", "left_semi").groupBy("rid").agg(F.collect_list("anchor").alias("anchors"))
        wanted = keep.write(first.drop("anchors").join(hot, "rid"))
        own = given.select(F.col("doc_id").alias("id"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("text").cast("binary").alias("text"))
        same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("u1") == F.col("t1")) & (F.col("u2") == F.col("t2"))
        found = keep.write(own.join(wanted, same).select("rid", "doc", "text", "anchors"))
        contexts = found.mapInArrow(_contexts, "rid long, doc long, anchor long, at long, windows long, off long, words binary")
        contexts = keep.write(contexts.withColumns({"c1": F.xxhash64("off", "words"), "c2": F.xxhash64(F.lit(1), "off", "words")}))
        different = contexts.groupBy("c1", "c2").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("anchor", "off", "windows", "words")])
        different = keep.write(different)
        masks = keep.write(different.select("c1", "c2", F.col("doc").alias("least")).join(_masks(different, local, keep), ["c1", "c2"], "left"))
        marks = contexts.select("rid", "doc", "at", "windows", "c1", "c2").join(masks, ["c1", "c2"])
        mask = F.when(F.col("doc") > F.col("least"), _ones("windows")).otherwise(F.col("mask"))
        marks = marks.select("rid", "at", mask.alias("mask")).where("mask <> 0").distinct().groupBy("rid").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))
        cut = found.select("rid", "text").join(marks, "rid").mapInArrow(_cut, "rid long, n_removed long, kept_sha256 string, kept binary")
        if not texts:
            cut = cut.drop("kept")
        cut = keep.keep(cut.dropDuplicates(["rid"]))
    return _joined(rows, first.select("sha", "rid", F.col("doc").alias("least")).join(cut, "rid", "left").drop("rid"), texts)


def _joined(rows: DataFrame, firsts: DataFrame, texts: bool) -> DataFrame:
    """The result of each row from that of the first document with its words: all goes where that one has a lesser id."""
    both = rows.select("doc_id", "n_words", "sha").join(firsts, "sha", "left")
    again = F.coalesce(F.col("least") < F.coalesce("doc_id", F.lit(LAST)), F.lit(False))
    out = {
        "n_removed": F.when(again, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))),
        "kept_sha256": F.when(again, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")),
    }
    more = {"kept": F.when(again, F.lit("")).otherwise(F.col("kept").cast("string"))} if texts else {}
    return both.select("doc_id", "n_words", *[c.alias(k) for k, c in (out | more).items()])
