"""Block-Max WAND against scores of all documents."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, SCHEMA, ascii_lower, docs

from tallowmere.llm import queries, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(ascii_lower(text))


def ranked(documents, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in documents]
    total, every = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked, out = defaultdict(set), []
    for q, t in items:
        asked[q] |= set(terms(t))
    for q, own in asked.items():
        w, found = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in own}, []
        for i, c in counts:
            if c:
                m = 50 + 50 * c.total() * total // every
                score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
                if score > 0:
                    found.append((-score, i is None, i or 0, i))
        out += [(q, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum()))) for i in rng.permutation(900)]
    rows += [(5000 + i, "the same words w1 w390") for i in range(300)]  # a large group of ties
    return rows + [(9000 + i, t) for i, t in enumerate(ODD)] + [(None, "w390 w391"), (None, "w390 w391"), (3, "W390"), (3, "W390")]


ITEMS = [(1, "w390 w391 w2 w1"), (2, "w5 w6 w7 w8 w9 w10"), (3, None), (4, "nothing-known"), (2, "w380"), (None, "same words"), (6, "中文字 é W1"), (7, "w1 " * 2000)]


@pytest.mark.parametrize("k", [50, 3])
def test_search_equals_all_scores(spark, corpus, k):
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, doc_id int")
    assert rows_of(search.ranked_search(docs(spark, corpus, term="x", shard=1), items, k)) == ranked(corpus, ITEMS, k)


def test_many_shards_and_blocks_of_queries(spark, corpus, monkeypatch):
    """Shards of a few documents, an index of all terms, and queries in blocks give the same."""
    monkeypatch.setattr(search, "QUERY_TERMS", 5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index, path = search.Scratch(spark), None
    with index:
        own = index.write(search.build(docs(spark, corpus), shard=700))
        assert own.where("term IS NULL").count() > 20
        assert rows_of(search.search(own, items, 10)) == ranked(corpus, ITEMS, 10)
    assert path is None


def test_query_on_given_documents(spark, small):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{small}/{name}.parquet").select(key, "text").collect()]
    assert rows_of(queries.op12_ranked_search(spark, small)) == ranked(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.ranked_search(none, items).count() == 0
    assert search.ranked_search(docs(spark, [(1, None), (2, "--")]), items).count() == 0
    assert search.ranked_search(docs(spark, [(1, "a")]), items.limit(0)).count() == 0


def test_blocks_come_back_whole():
    rng = np.random.default_rng(2)
    for n in (1, 2, 127, 128):
        at = np.sort(rng.choice(1 << 20, n, replace=False))
        tf = rng.integers(1, 300, n)
        got = search.unpack(search.pack(at, tf), int(at[0]))
        assert (got[0] == at).all() and (got[1] == tf).all()


def test_peaks_bound_every_posting():
    rng = np.random.default_rng(3)
    tf, n = rng.integers(1, 9, 128), rng.integers(10, 90, 128)
    top = search.peaks(tf, n)
    assert len(top) < 20 and all(any(tf[i] >= a and n[i] <= b for i in top) for a, b in zip(tf, n, strict=True))


def test_blocks_below_the_threshold_stay_packed():
    """One rare term decides: of a common term's blocks only those beside it are opened."""
    impact = lambda tf, n: 10**9 * tf // (1000 * tf + 2000)
    size = 128 * 60

    def listed(at, tf):
        cuts = range(0, len(at), 128)
        tops = [search.peaks(tf[i : i + 128], np.ones(len(tf[i : i + 128]), np.int64)) for i in cuts]
        best = np.concatenate([tf[i : i + 128][t] for i, t in zip(cuts, tops, strict=True)])
        ints = [at[::128], np.array([at[min(i + 127, len(at) - 1)] for i in cuts]), np.cumsum([0] + [len(t) for t in tops]), best, np.ones(len(best))]
        row = dict(zip(("first", "last", "peak_at", "peak_tf", "peak_n"), (np.asarray(x, np.int64).tobytes() for x in ints), strict=True))
        return search._List(row | {"blocks": [search.pack(at[i : i + 128], tf[i : i + 128]) for i in cuts]}, impact)

    common, rare = listed(np.arange(size), np.ones(size, np.int64)), listed(np.array([5000, 5001, 5002]), np.array([3, 3, 3]))
    best = search._Best(3, 1)
    opened = search._walk([(common, 1), (rare, 1000)], np.ones(size, np.int64), np.arange(size), np.zeros(size, np.int64), best)
    assert sorted(best.rows[:, 2].tolist()) == [5000, 5001, 5002]
    assert opened < 12 and len(common.open) < 8


def test_long_texts_are_cut_at_terms(monkeypatch):
    monkeypatch.setattr(search, "PIECE", 7)
    text = "Alpha beta-gamma " + "x" * 40 + " é中 1 "
    assert [t.decode() for part in search._terms(text.encode()) for t in part] == terms(text)
