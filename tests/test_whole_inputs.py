"""Queries over whole inputs, against brute force: nothing is cut, whatever its length or place."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallowmere import catalog
from tallowmere.operators import decisions


def words(t):
    return re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip(" ").split(" ")


def best_phrases(documents, benchmark):
    """By document: candidates, match, item and coverage, all pairs compared."""
    out = {}
    for doc, text in documents:
        d, found = words(text), []
        for item, phrase in benchmark:
            p = words(phrase)
            at = [len(d) > i and len(p) > i and d[i] == p[i] for i in range(3)]
            if not at[0] or not (at[1] or at[2]):
                continue
            cov = len(set(p) & set(d)) / len(set(p))
            whole = f" {' '.join(p)} " in f" {' '.join(d)} "
            kind = 0 if d == p else 3 if len(p) < 4 else 1 if whole else 2 if cov >= 0.8 else 3
            found.append((kind, -cov, item))
        if found:
            kind, less, item = min(found)
            out[doc] = (len(found), ("EXACT", "CONTAINED", "HIGH_OVERLAP", "NONE")[kind], item, round(-less, 6))
    return out


def phrase_rows(spark, d):
    return {r.claim_id: (r.candidates, r.match_type, r.item_id, r.coverage) for r in catalog.QUERIES["safe_phrase_match"](spark, str(d)).collect()}


def test_phrases_match_beyond_the_first_words(spark, tmp_path):
    passage = "the quick brown fox jumps over a lazy dog near some river"
    filler = " ".join(f"w{i}" for i in range(60))
    documents = [(1, passage), (2, f"the quick start {filler} {passage}"), (3, f"the slow brown {filler} fox jumps over a lazy dog near some hill"), (4, f"the quick brown fox jumps over {filler}"), (5, "red fox"), (6, "red"), (7, ""), (8, None), (9, f"the quick {filler}")]
    benchmark = [(1, passage), (2, "red fox"), (3, "red"), (4, "the quick brown cat")]
    pq.write_table(pa.table({"doc_id": [i for i, _ in documents], "text": [x for _, x in documents]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in benchmark], "text": [x for _, x in benchmark]}), tmp_path / "benchmark.parquet")
    got = phrase_rows(spark, tmp_path)
    assert got == best_phrases(documents, benchmark)
    assert [got[i][1] for i in (1, 2, 3, 4, 5, 9)] == ["EXACT", "CONTAINED", "HIGH_OVERLAP", "NONE", "EXACT", "NONE"]


def test_phrases_on_given_documents(spark, medium):
    rows = lambda name: [tuple(r) for r in spark.read.parquet(f"{medium}/{name}.parquet").select("doc_id" if name == "documents" else "item_id", "text").collect()]
    assert phrase_rows(spark, medium) == best_phrases(rows("documents"), rows("benchmark"))


@pytest.mark.parametrize("block", [1, 3, 64])
def test_pareto_in_blocks_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(decisions.math, "isqrt", lambda n: 1)
    rows = [(i, i % 2, float(i * 7 % 11), None if i % 17 == 5 else float(i * 5 % 7), float(i * 3 % 5)) for i in range(90)]
    d = spark.createDataFrame(rows, "id long, g int, x double, y double, z double")
    better = lambda a, b: None not in (a[3], b[3]) and a[1] == b[1] and a[2] >= b[2] and a[3] >= b[3] and a[4] <= b[4] and a[2:] != b[2:]
    right = {b[0]: (sum(better(a, b) for a in rows), sum(better(b, a) for a in rows)) for b in rows}
    got = {r.id: (r.dominated_by, r.dominates, r.on_frontier) for r in decisions.pareto(d, "g", "id", ["x", "y"], ["z"], block=block).collect()}
    assert got == {i: (lost, won, rows[i][3] is not None and lost == 0) for i, (lost, won) in right.items()}


def options_at_random(n):
    """Options of three criteria: one continuous, one with half of its values alike, one the same for a group; some alike up to 1e-12."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 5 // 4, float(x), 0.0 if i % 2 else float(y), float(z) if i % 5 < 4 else 0.0) for i, (x, y, z) in enumerate(rng.normal(size=(n, 3)))]
    return rows + [(n + k, g, x + 4e-13, y, z) for k, (_, g, x, y, z) in enumerate(rows[:40])]


@pytest.mark.parametrize("block", [4, 100])
def test_pareto_with_frequent_values_equals_all_pairs(spark, block):
    rows = options_at_random(1200)
    d = spark.createDataFrame(rows, "id long, g int, x double, y double, z double")
    got = {r.id: (r.dominated_by, r.dominates) for r in decisions.pareto(d, "g", "id", ["x", "y"], ["z"], block=block).collect()}
    for g in (0, 1):
        ids = [r[0] for r in rows if r[1] == g]
        p = np.array([(r[2], r[3], -r[4]) for r in rows if r[1] == g])
        gap = p[:, None] - p[None]  # the first less the second
        better = (gap >= -1e-12).all(2) & (gap > 1e-12).any(2)
        assert [got[i] for i in ids] == list(zip(better.sum(0).tolist(), better.sum(1).tolist(), strict=True))


def test_pareto_pairs_few_of_its_options(spark, monkeypatch):
    """Of 4,800 options of one group some 8 million pairs dominate; no more are made than there are options times the size of a cell."""
    made = []
    own = decisions._paired

    def paired(*args):
        made.append(own(*args))
        return made[-1]

    monkeypatch.setattr(decisions, "_paired", paired, raising=False)
    d = spark.range(4800).selectExpr("id", "1 AS g", "id * 7919 % 4801 / 1.0D AS x", "id * 104729 % 4801 / 1.0D AS y")
    out = decisions.pareto(d, "g", "id", ["x", "y"], block=64)
    assert out.agg(F.sum("dominates") - F.sum("dominated_by")).first()[0] == 0
    assert len(made) == 3 and sum(x.count() for x in made) < 4800 * 64 * 4


def test_every_row_has_a_result(spark, medium):
    n = lambda name: spark.read.parquet(f"{medium}/{name}.parquet").count()
    assert catalog.QUERIES["claim_validation"](spark, medium).count() == n("lineitem")
    for name in ("constraint_eval", "scenario_utility", "pareto_frontier", "scenario_rank"):
        assert catalog.QUERIES[name](spark, medium).select("option_id").distinct().count() == n("supplier")
    got = catalog.QUERIES["lineage_closure"](spark, medium).collect()
    assert any(int(r.node[1:]) >= 200 for r in got if r.node[0] == "c")
