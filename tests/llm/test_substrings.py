"""Repeated passages against all windows of all documents."""

from collections import Counter

import numpy as np
import pytest
from helpers import BLANK, ODD, SCHEMA, docs, sha

from tallowmere.llm import queries, substrings


def words_of(text):
    return [w for w in BLANK.split(text or "") if w]


def brute(rows):
    order = lambda i: substrings.LAST if i is None else i
    texts, least, out = [(i, words_of(t)) for i, t, *_ in rows], {}, []
    for i, w in texts:
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            least[key] = min(least.get(key, order(i)), order(i))
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if least[tuple(w[j : j + 50])] < order(i):
                gone[j : j + 50] = [True] * 50
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    shared, line = [text(n) for n in (49, 50, 51, 120, 400)], "all rights are reserved by the owner of this very line and nobody else at all ."
    out = [(i, t) for i, t in enumerate(ODD)]
    for i in range(60):  # passages at the start, the end, in the middle, side by side, and cut
        p = shared[i % 5]
        w = words_of(p)
        forms = [f"{p} {text(30)}", f"{text(30)} {p}", f"{text(9)}\t{p}\n{text(80)}", f"{p} {shared[(i + 1) % 5]}", " ".join(w[3:]) + " " + text(70), text(60) + " " + " ".join(w[:-2])]
        out.append((1000 - i, forms[i % 6]))
    out += [(2000 + i, f"{text(40)} {line} {line} {line} {text(40)}") for i in range(40)]
    out += [(3000 + i, "again " * n) for i, n in enumerate((49, 50, 51, 300, 300))]
    long = text(20_000)
    out += [(4000, long), (4001, long.replace(" ", "\n")), (4002, long + " end"), (3999, "start " + long)]
    out += [(None, shared[4]), (None, shared[4]), (None, text(60)), (1000, shared[3]), (1000, f"{shared[3]} {shared[3]}")]
    return out


@pytest.mark.parametrize("local", [substrings.LOCAL, 2])
def test_repeats_equal_all_windows(spark, rows, local):
    d = docs(spark, rows, anchor="x", sha=1, rid=2)
    assert rows_of(substrings.repeats(d, local)) == brute(rows)


def test_kept_words_are_those_of_the_digest(spark, rows):
    for r in substrings.repeats(docs(spark, rows), texts=True).where("n_removed > 0").collect():
        assert sha(r.kept) == r.kept_sha256 and len(words_of(r.kept)) == r.n_words - r.n_removed


def test_query_on_given_documents(spark, small):
    given = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op13_substring_dedup(spark, small)) == brute(given)


def test_empty_table(spark):
    assert substrings.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert rows_of(substrings.repeats(docs(spark, [(1, None), (2, "a b")]))) == brute([(1, None), (2, "a b")])


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    y = np.r_[rng.integers(0, 1 << 63, 77).astype(np.uint64), x[100:220], rng.integers(0, 1 << 63, 9).astype(np.uint64)]
    a, b = (substrings._places(substrings._grams(v)) for v in (x, y))
    for i in range(100, 220 - 49):
        assert a[i] - i == b[i - 23] - (i - 23) and 0 <= a[i] - i < substrings.SPREAD
    g = substrings._grams(x)
    assert all(g[a[i]] == g[i : i + substrings.SPREAD].min() for i in range(len(a)))


def test_a_very_long_text(spark):
    """20 MB in one row, repeated in another."""
    text = " ".join(f"w{i}" for i in range(2_400_000))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.repeats(docs(spark, [(1, text), (2, "new " + text), (3, "x")])).collect()}
    assert got == {1: (2_400_000, 0), 2: (2_400_001, 2_400_000), 3: (1, 0)}
