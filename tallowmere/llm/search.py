"""Ranked search with Block-Max WAND over an index in shards.

Documents are indexed where they are read: a task cuts its rows to shards of bounded size, and a shard has for each term
a list of postings in blocks of 128, packed to as few bits as they need.  Beside each block stand its first and last
document and the pairs of (occurrences, length) that no other of the block surpasses, so that the greatest
impact of the block is known without unpacking it, whatever the corpus statistics turn out to be.  No list is ever gathered from
several shards: a term that every document holds is spread as the documents are.

A query's cut of a shard into intervals follows the ends of its lists' blocks, so that within an interval each list has one
block.  Shallow moves bring all lists' pointers to an interval and add up the greatest impacts there; intervals
whose sum stays below the k-th best score so far are passed over, and only blocks of the others are unpacked.
The first shards' k-th scores are the threshold that all other shards begin with.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, small_batches, text_of

#: Postings of a block; terms of a shard's texts, repeats included; letters that are cut to terms at once.
BLOCK, SHARD, PIECE = 128, 1 << 22, 1 << 20
#: Terms of queries that restrict an index (more of them: all terms are indexed), and terms of a block of queries.
VOCABULARY, QUERY_TERMS = 1 << 20, 1 << 18
#: One shard of so many is searched first.
FIRST = 16
_CLASS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
INDEX = (
    "shard long, term binary, docs long, terms long, first binary, last binary, peak_at binary, peak_tf binary, peak_n binary, blocks array<binary>, "
    "ids binary, missing binary, lengths binary"
)
_FIELDS = [f.split()[0] for f in INDEX.split(", ")]


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text (UTF-8) in its order, those of about a megabyte at a time: digits, letters a-z after lower-casing A-Z, and all beyond ASCII."""
    at = 0
    while at < len(text):
        end = at + PIECE
        part = text[at:end].translate(_CLASS)
        while end < len(text) and not part.endswith(b" "):  # on to the end of the term
            more = text[end : end + PIECE].translate(_CLASS)
            cut = more.find(b" ") + 1 or len(more)
            part, end = part + more[:cut], end + cut
        at = end
        yield part.split()


def _packed(values: np.ndarray, width: int) -> bytes:
    return np.packbits(((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpacked(raw: bytes, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits @ (1 << np.arange(width, dtype=np.int64))


def pack(docs: np.ndarray, tf: np.ndarray) -> bytes:
    """A block: its size, the bits of a gap and of an occurrence, the gaps from its first document on, the occurrences."""
    gaps = np.diff(docs, prepend=docs[0])
    wide, high = max(1, int(gaps.max()).bit_length()), max(1, int(tf.max()).bit_length())
    return bytes((len(docs) - 1, wide, high)) + _packed(gaps, wide) + _packed(tf, high)


def unpack(raw: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    n, wide, high = raw[0] + 1, raw[1], raw[2]
    cut = 3 + (n * wide + 7) // 8
    return first + np.cumsum(_unpacked(raw[3:cut], n, wide)), _unpacked(raw[cut:], n, high)


def peaks(tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the pairs that no other pair equals or exceeds with more occurrences in a shorter document."""
    order = np.lexsort((n, -tf))
    least = np.minimum.accumulate(n[order])
    return order[np.r_[True, n[order][1:] < least[:-1]]]


def _shard(number: int, ids: list, lengths: list, found: list[tuple[list, list]], names: list[bytes]) -> Iterator[tuple]:
    """The rows of one shard: its documents in the order of their ids, then each term's list."""
    own = np.array([-1 if i is None else i for i in ids], np.int64)
    missing, n = np.array([i is None for i in ids]), np.array(lengths, np.int64)
    order = np.lexsort((own, missing))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    yield (number, None, int((n > 0).sum()), int(n.sum()), None, None, None, None, None, None, own[order].tobytes(), np.packbits(missing[order]).tobytes(), n[order].tobytes())
    n = n[order]
    doc = np.repeat(place, [len(t) for t, _ in found])
    term = np.array([x for t, _ in found for x in t], np.int64)
    tf = np.array([x for _, c in found for x in c], np.int64)
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order]
    cut = np.flatnonzero(np.diff(term, prepend=-1, append=-1)).tolist() if len(term) else []
    for s, e in pairwise(cut):
        firsts, lasts, at, best_tf, best_n, blocks = [], [], [0], [], [], []
        for b in range(s, e, BLOCK):
            d, f = doc[b : min(b + BLOCK, e)], tf[b : min(b + BLOCK, e)]
            top = peaks(f, n[d])
            firsts.append(d[0]), lasts.append(d[-1]), at.append(at[-1] + len(top)), blocks.append(pack(d, f))
            best_tf.append(f[top]), best_n.append(n[d][top])
        ints = [np.array(x, np.int64).tobytes() for x in (firsts, lasts, at)] + [np.concatenate(x).tobytes() for x in (best_tf, best_n)]
        yield (number, names[term[s]], int(e - s), 0, *ints, blocks, None, None, None)


def build(docs: DataFrame, terms: list[bytes] | None = None, shard: int = SHARD) -> DataFrame:
    """The index of ``docs(doc_id, text)``: of all terms, or of ``terms`` alone.

    Each shard has a row of its documents (``term`` null) and one for each term.  A null text has no terms, a
    null id is kept and comes last; rows alike are documents of their own.  A shard closes once its texts have
    ``shard`` terms, so a task holds that many and its longest text at most.
    """
    small_batches(docs.sparkSession)
    wanted = docs.sparkSession.sparkContext.broadcast(None if terms is None else {t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, number = wanted.value, TaskContext.get().partitionId() << 32
        state: list = []

        def clear() -> None:
            state[:] = [[], [], [], {} if known is None else known, 0]

        def closed() -> Iterator[pa.RecordBatch]:
            rows: list = []
            for row in _shard(number, *state[:3], list(state[3])):
                rows.append(row)
                if len(rows) == 500:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        clear()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts: Counter = Counter()
                for part in _terms(text.as_py()):
                    counts.update(part)
                n = counts.total()
                names = state[3]
                if known is None:
                    state[2].append(([names.setdefault(t, len(names)) for t in counts], list(counts.values())))
                else:
                    own = [(names[t], c) for t, c in counts.items() if t in names]
                    state[2].append(([t for t, _ in own], [c for _, c in own]))
                state[0].append(i), state[1].append(n)
                state[4] += n
                if state[4] >= shard or len(state[0]) >= shard >> 6:
                    yield from closed()
                    number += 1
                    clear()
        if state[0]:
            yield from closed()

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary")).mapInArrow(run, INDEX)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.binary()), *[pa.binary()] * 3]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_FIELDS)


class _List:
    """A term's list in one shard, its blocks' greatest impacts, and the blocks that were unpacked."""

    def __init__(self, row: dict, impact):
        self.first, self.last, at, tf, n = (np.frombuffer(row[k], np.int64) for k in ("first", "last", "peak_at", "peak_tf", "peak_n"))
        self.most = np.maximum.reduceat(impact(tf, n), at[:-1])
        self.top, self.packed, self.open, self.impact = int(self.most.max()), row["blocks"], {}, impact

    def block(self, k: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            docs, tf = unpack(self.packed[k], int(self.first[k]))
            self.open[k] = docs, self.impact(tf, n[docs])
        return self.open[k]


class _Best:
    """The k best of a query so far: greatest score, then least id, missing ids last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.rows = k, max(1, floor), np.zeros((0, 3), np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        rows = np.vstack([self.rows, np.column_stack([score, missing, ids])])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]
        if len(self.rows) == self.k:
            self.floor = max(self.floor, int(self.rows[-1, 0]))


def _walk(lists: list[tuple[_List, int]], n: np.ndarray, ids: np.ndarray, missing: np.ndarray, best: _Best) -> int:
    """One query over one shard; how many blocks it opened."""
    if sum(x.top * w for x, w in lists) < best.floor:
        return 0
    ends = np.unique(np.concatenate([x.last for x, _ in lists]))
    bound, at = np.zeros(len(ends), np.int64), []
    for x, w in lists:  # shallow moves: the block of each list that holds an interval's end, or lies beyond it
        k = np.searchsorted(x.last, ends)
        inside = k < len(x.last)
        k[~inside] = 0
        inside &= x.first[k] <= ends
        bound += np.where(inside, x.most[k] * w, 0)
        at.append(np.where(inside, k, -1))
    order, begun, step, opened = np.argsort(-bound, kind="stable"), 0, 4, 0
    score = np.zeros(len(n), np.int64)
    while begun < len(order):
        some = order[begun : begun + step]
        some = some[bound[some] >= best.floor]
        if not len(some):
            break
        wanted = np.zeros(len(n), bool)
        for j in some:
            wanted[ends[j - 1] + 1 if j else 0 : ends[j] + 1] = True
        for (x, w), k in zip(lists, at, strict=True):
            for b in np.unique(k[some]):
                if b >= 0:
                    docs, impact = x.block(b, n)
                    score[docs] += impact * w
                    opened += 1
        hit = np.flatnonzero(wanted & (score >= best.floor))
        best.add(score[hit], ids[hit], missing[hit])
        score[:] = 0
        begun, step = begun + step, step * 2
    return opened


def _searched(index: DataFrame, queries: list[tuple], total: int, terms: int, k: int) -> DataFrame:
    """(query, score, doc_id): each task's k best documents of each query, by its place; queries are (floor, {term: weight})."""
    asked = index.sparkSession.sparkContext.broadcast(queries)

    def impact(tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k, floor) for floor, _ in asked.value]
        docs, lists = None, {}

        def search() -> None:
            for q, (_, own) in enumerate(asked.value):
                here = [(lists[t], w) for t, w in own.items() if t in lists]
                if here:
                    _walk(here, *docs, best[q])

        for b in batches:
            for row in b.to_pylist():
                if row["term"] is None:
                    if docs:
                        search()
                    ids, n = (np.frombuffer(row[c], np.int64) for c in ("ids", "lengths"))
                    docs, lists = (n, ids, np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=len(n)).astype(np.int64)), {}
                else:
                    lists[row["term"]] = _List(row, impact)
        if docs:
            search()
        for q, x in enumerate(best):
            if len(x.rows):
                ids = pa.array(x.rows[:, 2], mask=x.rows[:, 1] == 1)
                yield pa.record_batch([pa.array(np.full(len(x.rows), q)), pa.array(x.rows[:, 0]), ids], names=["query", "score", "doc_id"])

    return index.repartition("shard").sortWithinPartitions("shard", "term").mapInArrow(run, "query long, score long, doc_id long")


def query_terms(queries: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, term): the distinct terms of each item's texts; rows of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in set().union(*_terms(text))]
            yield pa.record_batch([pa.array([i for i, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], names=["item", "term"])

    return queries.select(F.col(item).cast("long"), text_of().cast("binary")).mapInArrow(run, "item long, term binary").distinct()


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents of each item of ``queries(item_id, text)`` by an index of :func:`build`: item_id, rank, doc_id, score.

    The score adds for each distinct term w * (1e9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L, w = floor(1000
    ln((2 N + 2) / (2 df + 1))), with N documents that have terms, L terms in all, n in the document and df documents
    with the term.  Only scores above 0 count; equal ones go by ascending doc_id, null ids last.  Rows of one item_id (null,
    too) are one item; an item without terms, or no documents, give no rows; further columns don't matter.

    ``index`` is read several times, so it should be a stored table.  Queries go to the tasks in blocks of about
    ``QUERY_TERMS`` terms, however many there are.
    """
    spark = index.sparkSession
    small_batches(spark)
    total, terms = index.where("term IS NULL").agg(F.sum("docs"), F.sum("terms")).first()
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not terms:
        return none
    with Scratch(spark) as keep:
        asked = keep.write(query_terms(queries))
        own = keep.write(index.where("term IS NULL").unionByName(index.join(asked.select("term").distinct(), "term", "left_semi").select(*index.columns)))
        df = own.where("term IS NOT NULL").groupBy("term").agg(F.sum("docs").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.col("df") + 1))).cast("long")
        weighted = keep.write(asked.join(df, "term").select("item", "term", weight.alias("w")).where("w > 0"))
        parts = max(1, -(-weighted.count() // QUERY_TERMS))
        first = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
        found = []
        for part in range(parts):
            rows = weighted.where(F.pmod(F.xxhash64(F.coalesce("item", F.lit(-1)), F.isnull("item")), F.lit(parts)) == part)
            block = [(r.item, {bytes(t.term): t.w for t in r.terms}) for r in rows.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("terms")).collect()]
            names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], "query long, item_id long")

            def ranked(shards: DataFrame, floors: dict, block: list = block, names: DataFrame = names) -> DataFrame:
                hits = _searched(shards, [(floors.get(q, 1), t) for q, t in block], total, terms, k)
                return keep.keep(_best(hits.join(names, "query").select("item_id", "score", "doc_id"), k))

            early = ranked(own.where(first), {})
            floors = {r.item_id: r.score for r in early.where(F.col("rank") == k).collect()}
            found += [early, ranked(own.where(~first), floors)]
        every = found[0]
        for x in found[1:]:
            every = every.unionByName(x)
        return _best(every, k)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """:func:`search` over ``docs(doc_id, text)``, indexed for these queries: of their terms alone where these are at most ``VOCABULARY``."""
    with Scratch(docs.sparkSession) as keep:
        terms = keep.write(query_terms(queries).select("term").distinct())
        few = terms.count() <= VOCABULARY
        index = build(docs, [bytes(r.term) for r in terms.collect()] if few else None)
        return search(keep.write(index), queries, k)
