"""Exact and SimHash dedup, the Golay keys, and connected components."""

from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from helpers import ODD, SCHEMA, Groups, components_of, docs, fingerprint, fingerprint_groups, normal, sha, xxhash_signed

from tallowmere.llm import exact_dedup, golay, queries, shared, simhash
from tallowmere.llm.components import connected_components


def odd_rows():
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, t) for i, t in enumerate(ODD)]
    return rows + [(7, ODD[7]), (None, "only without id"), (None, "only without id"), (None, "a")]


def exact_brute(rows):
    least, size = defaultdict(list), Counter()
    for i, t in rows:
        size[normal(t)] += 1
        if i is not None:
            least[normal(t)].append(i)
    return Counter((i, min(least[normal(t)]) if least[normal(t)] else None, size[normal(t)], sha(normal(t))) for i, t in rows)


def test_exact_report_equals_brute_force(spark):
    rows = odd_rows()
    got = exact_dedup.exact_dedup_report(docs(spark, rows, digest="x", copies=1, keep_id=0)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact_brute(rows)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({sha(normal(t)) for _, t in rows})


def test_exact_dedup_keeps_one_row_a_text_with_all_columns(spark):
    rows = odd_rows()
    d = docs(spark, rows, digest="x", copies=1, keep_id=0)
    out = exact_dedup.exact_dedup(d)
    assert out.columns == d.columns
    got = out.collect()
    assert Counter(normal(r.text) for r in got) == Counter({normal(t) for _, t in rows})
    assert {normal(r.text): r.doc_id for r in got} == {normal(t): min((i for i, u in rows if normal(u) == normal(t) and i is not None), default=None) for _, t in rows}


def test_exact_index_persists_and_lets_only_new_texts_in(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    with exact_dedup.DigestIndex(spark, path, buckets=3) as first:
        exact_dedup.exact_groups(docs(spark, [(1, "a b"), (2, "c")]), first).count()
    with exact_dedup.DigestIndex(spark, path, buckets=7) as again:
        assert again.buckets == 3
        g = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs(spark, [(5, "a\tb"), (6, "new")]), again).collect()}
        assert g == {5: 1, 6: 6}
        assert again.rows().count() == 3
        exact_dedup.exact_groups(docs(spark, [(9, "new"), (8, "c")]), again).count()
        assert again.rows().count() == 3


def test_known_texts_are_not_let_in_again(spark, tmp_path):
    """The same rows given twice, one without id among them: the second time none stays."""
    path = f"file://{tmp_path}/index"
    d = docs(spark, [(1, "a b"), (None, "no id"), (2, "c")])
    with exact_dedup.DigestIndex(spark, path, buckets=3) as index:
        assert exact_dedup.exact_dedup(d, index).count() == 3
    with exact_dedup.DigestIndex(spark, path) as index:
        assert exact_dedup.exact_dedup(d, index).count() == 0
        got = exact_dedup.exact_dedup_report(docs(spark, [(1, "a\tb"), (None, "no id"), (7, "new"), (7, "new")]), index).collect()
        assert sorted((r.doc_id or 0, r.keep_id, r.kept) for r in got) == [(0, None, False), (1, 1, False), (7, 7, False), (7, 7, True)]
        assert index.last() > 0


class Refuses:
    """A place on a file system that says no instead of raising."""

    def getFileSystem(self, _):
        return self

    def rename(self, *_):
        return False


def test_a_compaction_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    with exact_dedup.DigestIndex(spark, path, buckets=2) as index:
        exact_dedup.exact_groups(docs(spark, [(i, f"text {i}") for i in range(20)]), index)
        before = sorted(map(tuple, index.rows().collect()))
        rename, calls = index._rename, []

        def second_fails(a, b):
            calls.append(a)
            if len(calls) == 2:
                raise OSError("not renamed")
            rename(a, b)

        monkeypatch.setattr(index, "_rename", second_fails)
        with pytest.raises(OSError, match="not renamed"):
            index.compact()
        assert sorted(map(tuple, index.rows().collect())) == before
        monkeypatch.setattr(index, "_rename", rename)
        with pytest.raises(OSError, match="was not renamed"):
            index._rename(Refuses(), index._at("-else"))
        index.compact()
        assert sorted(map(tuple, index.rows().collect())) == before
    (tmp_path / "index").rename(tmp_path / "index-old")  # the driver died between the two renames
    with exact_dedup.DigestIndex(spark, path) as again:
        assert again.buckets == 2 and sorted(map(tuple, again.rows().collect())) == before


NAMES = ("__own", "own", "own_", "kept_doc_id", "odd___id", "hash", "chunk", "new")


@pytest.mark.parametrize("dedup", [exact_dedup.exact_dedup, simhash.near_dedup])
def test_no_name_of_a_column_is_lost(spark, dedup):
    d = docs(spark, [(1, "a b"), (2, "a b"), (3, "c"), (3, "c"), (None, "d")], **{n: f"mine {n}" for n in NAMES})
    out = dedup(d)
    assert out.columns == d.columns
    got = out.collect()
    assert {r.doc_id for r in got} == {1, 3, None} and len(got) == 3
    assert all(r[n] == f"mine {n}" for r in got for n in NAMES)


@pytest.mark.parametrize("dedup", [exact_dedup.exact_dedup, simhash.near_dedup])
def test_ties_do_not_depend_on_the_order_of_rows(spark, dedup):
    """Rows alike in id and text, not in lang and source, and for exact dedup texts that differ in blanks only."""
    rows = [(3, "same text here", lang, source, n) for n, (lang, source) in enumerate([("en", "a"), ("fr", "b"), ("de", None), (None, "c")])]
    if dedup is exact_dedup.exact_dedup:
        rows += [(3, "same\ttext here", "en", "a", 9)]
    got = {tuple(map(tuple, dedup(spark.createDataFrame(x, SCHEMA).coalesce(1)).collect())) for x in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(got) == 1 and len(next(iter(got))) == 1


def test_a_text_of_20_mb_is_kept_once(spark):
    text = "word " * 4_000_000
    for dedup in (exact_dedup.exact_dedup, simhash.near_dedup):
        out = dedup(docs(spark, [(1, text), (2, text), (3, "x y z")]))
        assert sorted((r.doc_id, len(r.text)) for r in out.collect()) == [(1, 20_000_000), (3, 5)]


def test_index_is_read_by_sorted_buckets(spark, tmp_path):
    """No exchange of the index ever; no sort of it either while each bucket is one file, as after compaction."""
    path = f"file://{tmp_path}/index"
    with exact_dedup.DigestIndex(spark, path, buckets=4) as index:
        for number in range(3):
            rows = docs(spark, [(i, f"text {i}") for i in range(20 * number, 20 * number + 40)])
            index.add(exact_dedup.digests(rows), number)
        before = sorted(map(tuple, index.rows().collect()))
        assert len(before) == 80 and [b for _, _, b in before].count(0) == 40
        index.compact()
        assert sorted(map(tuple, index.rows().collect())) == before
        assert len(list((tmp_path / "index").glob("part-*"))) <= 4
        own, at = shared.written(exact_dedup.digests(docs(spark, [(3, "text 3"), (500, "text 500")])).groupBy("digest").count())
        with shared.setting(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
            new = index.new(own)
            plan = new._jdf.queryExecution().executedPlan().toString()
            assert new.count() == 1
        right = plan[plan.index("FileScan") :] if plan.index("Bucketed: true") > plan.index("FileScan") else ""
        assert "SortMergeJoin" in plan and "Bucketed: true" in right
        assert plan.count("Sort [") == plan.count("Exchange hashpartitioning") == 1  # both of the new rows
        shared.removed(spark, at)
    with exact_dedup.DigestIndex(spark, path) as again:
        assert sorted(map(tuple, again.rows().collect())) == before


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup_report(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash.near_report(none).count() == 0
    assert simhash.near_dedup(none).count() == 0


def test_words_one_bit_apart_share_a_key():
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    own = golay.codeword_keys(words)
    assert {int((k >= 0).sum()) for k in own} == {1, 6}
    for bit in range(23):
        other = golay.codeword_keys(words ^ (1 << bit))
        same = (own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)
        assert same.any((1, 2)).all()


def test_keys_name_nearby_codewords():
    words = np.random.default_rng(2).integers(0, 1 << 23, 300)
    code = sorted({int(w ^ golay._tables()[0][golay._syndrome(np.array([w]))[0]]) for w in words})
    assert all((a ^ b).bit_count() >= 7 for a, b in combinations(code[:60], 2))


def test_fingerprint_is_the_contracts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, "One two THREE"), (51, "one two three four one two three")]
    got = {r.doc_id: r.fingerprint for r in simhash.near_report(docs(spark, rows, fp=1, u=2)).collect()}
    assert got == {i: f"{fingerprint(t):016x}" for i, t in rows}


@pytest.mark.parametrize("bucket", [32, 1])
def test_components_equal_all_pairs(spark, bucket):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = set(base)
    for b in base[:4]:  # a ball of all words within a bit of one, and chains that leave it two bits at a time
        fps |= {b ^ (1 << i) for i in range(64)}
        x = b
        for _ in range(6):
            i, j = rng.choice(64, 2, replace=False)
            x ^= (1 << int(i)) | (1 << int(j))
            fps.add(x)
    fps |= {b ^ 0b111 for b in base[4:]} | {0}
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    e, _ = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), bucket)
    roots, _ = connected_components(e)
    got = {r.node: r.root for r in roots.collect()}
    want = fingerprint_groups(fps)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups({signed(f): got.get(signed(f), signed(f)) for f in fps}) == groups({signed(f): r for f, r in want.items()})


def test_query_equals_brute_force_on_given_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    fp, least = components_of(rows)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, small).collect())
    assert got == Counter((i, f"{f:016x}", least[f]) for i, f in fp)


def near_brute(rows):
    """(doc_id, text) rows that stay, each group and each repeated row once."""
    fp = {t: fingerprint(t) for _, t in rows}
    root = fingerprint_groups(fp.values())
    groups = defaultdict(set)
    for i, t in rows:
        groups[root[fp[t]]].add((i is None, i or 0, xxhash_signed(t), t))
    least = {min(g) for g in groups.values()}
    return Counter((None if none else i, t) for none, i, _, t in least)


TEXT = " ".join(f"w{i}" for i in range(300))
A, B, C = "one text about nothing much", "a second and quite different text", "third words that share none with these"
NEAR = [
    [(5, TEXT), (3, TEXT.upper()), (9, TEXT), (9, TEXT), (20, "quite another text with its own words"), (None, TEXT), (None, "no id at all but words")],
    [(9, A), (9, B), (3, C)],
    [(9, A), (9, C), (3, C)],
    [(9, A), (9, A.upper()), (9, A), (None, B), (None, B), (None, B.title())],
    [(1, None), (2, ""), (0, " "), (None, "")],
]


@pytest.mark.parametrize("rows", NEAR)
def test_near_dedup_keeps_one_of_each_group(spark, rows):
    d = docs(spark, rows, fp=1, component_id=2, text_hash=3, n=4)
    out = simhash.near_dedup(d)
    assert out.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == near_brute(rows)


def test_near_dedup_equals_brute_force_on_given_documents(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.text) for r in simhash.near_dedup(d).collect()) == near_brute(rows)


def test_nothing_is_left_behind(spark):
    """Tables that a run writes on its way go with it, the rest when results are released; the index has no name left."""
    shared.released()
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before, d = set(base.iterdir()), docs(spark, [(1, A), (2, A), (3, B)])
    assert simhash.near_dedup(d).count() == 2 and exact_dedup.exact_dedup(d).count() == 2
    assert exact_dedup.exact_dedup_report(d).count() == simhash.near_report(d).count() == 3
    assert len(set(base.iterdir()) - before) <= 8
    shared.released()
    assert set(base.iterdir()) == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (5001, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"))[0].collect()}
    g = Groups()
    for a, b in edges[:-2]:
        g.join(a, b)
    assert got == {x: g.find(x) for x in list(g.up)}
    assert connected_components(spark.createDataFrame([], "u long, v long"))[0].count() == 0
