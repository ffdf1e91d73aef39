"""The mix against one that takes one document after the other."""

from collections import Counter

import pytest
from helpers import ODD, SCHEMA, docs, mix
from pyspark.sql import functions as F

from tallowmere.llm import mixing, queries
from tallowmere.llm.shared import Scratch


def compare(got, rows):
    sizes, target, taken = mix(rows)
    want = Counter((r[0], r[1], n, n * t) for r, n, t in zip(rows, sizes, taken, strict=True))
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == want
    for r in got:
        assert r.target == pytest.approx(target[r.source], rel=1e-12)


def test_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").collect()]
    got = queries.op7_mixing(spark, small).collect()
    compare(got, rows)
    # each source's words come near its target: within a document of it
    longest = {s: max(r.size for r in got if r.source == s) for s in {r.source for r in got}}
    for s, most in longest.items():
        words = sum(r.taken for r in got if r.source == s)
        assert abs(words - next(r.target for r in got if r.source == s)) <= 2 * most
    assert all(r.taken <= 3 * r.size for r in got)


def test_odd_rows_and_a_hot_source(spark):
    rows = [(i, ["a", "b", None, "", "d"][i % 5] if i % 3 else "hot", "w " * (1 + i * 7 % 23)) for i in range(300)]
    rows += [(1000 + i, "odd", t) for i, t in enumerate(ODD)] + [(1, "hot", "one id again"), (1, "hot", "one id again"), (None, "a", "no id"), (5, "zero", None), (6, "zero", " ")]
    got = mixing.mix(docs(spark, [(i, t, s) for i, s, t in rows], block=1, upto=2, size=3, step=4)).collect()
    compare(got, rows)


def test_reruns_and_partitions_agree(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    one, other = (Counter(tuple(r) for r in mixing.mix(x).collect()) for x in (d.coalesce(1), d.repartition(7)))
    assert one == other


def test_mixed_repeats_rows_as_often_as_taken(spark):
    rows = [(1, "big", "a b c d e f g h i j " * 9), (2, "small", "x y"), (2, "small", "x y"), (3, "small", "z"), (None, None, "n o p")]
    d = docs(spark, [(i, t, s) for i, s, t in rows], copies=9, alike=1, size=0)
    out = mixing.mixed(d)
    assert out.columns == d.columns
    _, _, taken = mix(rows)
    assert Counter((r.doc_id, r.source, r.text) for r in out.collect()) == Counter({k: v for k, v in sum((Counter({r: t}) for r, t in zip([(i, s, t) for i, s, t in rows], taken, strict=True)), Counter()).items() if v})


def test_the_mix_is_in_the_order_of_finish_times(spark, small):
    """Partition after partition; any beginning of it has the sources in proportion to their targets."""
    d = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in d.select("doc_id", "source", "text").collect()]
    sizes, target, taken = mix(rows)
    out = mixing.mixed(d)
    parts = out.select("doc_id", "source", "text").rdd.glom().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = [tuple(r) for p in parts for r in p]
    assert Counter(r[0] for r in flat) == Counter({r[0]: n for r, n in zip(rows, taken, strict=True) if n})
    words, most = Counter(), Counter()
    for i, s, t in flat[: len(flat) // 2]:
        n = sizes[[r[0] for r in rows].index(i)]
        words[s] += n
        most[s] = max(most[s], n)
    half = sum(words.values()) / sum(target.values())
    for s in target:
        assert abs(words[s] - half * target[s]) <= 3 * max(most.values())


def test_running_totals_in_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(i % 2 or None, i * 7 % 40, i, 1 + i % 5) for i in range(200)]
    d = spark.createDataFrame(rows, "g int, b long, k int, size int")
    got = {r.k: r.upto for r in mixing._running(d, ["g"], "b", 40, [F.col("k")], "size", "upto").collect()}
    for g, b, k, _ in rows:
        assert got[k] == sum(n for h, c, j, n in rows if h == g and (c, j) <= (b, k))


def test_targets_stop_at_three_times_the_size(spark):
    t = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90)], "source string, source_size long")).collect()}
    assert t == {"a": 30.0, "b": pytest.approx(800), "c": 270.0}


def test_empty_table_and_no_words(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(docs(spark, [(1, None), (2, "  ")])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


NAMES = ("__hash", "__doc_id", "__text_hash", "__end", "__alike", "own", "mix_row", "mix_end", "hash", "row", "part", "chunk")


def test_no_name_of_a_column_is_lost(spark):
    d = docs(spark, [(1, "a b", "x"), (2, "c", "y"), (2, "c", "y")], **{n: f"mine {n}" for n in NAMES})
    out = mixing.mixed(d)
    assert out.columns == d.columns and out.count() > 0
    assert all(r[n] == f"mine {n}" for r in out.collect() for n in NAMES)


def test_rows_that_differ_in_one_column_are_rows_of_their_own(spark):
    """Rows alike in id, source and text, not in lang: each is taken as often, whatever the order of the input."""
    rows = [(1, "a b c", lang, "s", 5) for lang in ("en", "fr", "de")] + [(2, "d", "en", "s", 1)]
    seen = [Counter(r.lang for r in mixing.mixed(spark.createDataFrame(x, SCHEMA)).collect() if r.doc_id == 1) for x in (rows, rows[::-1])]
    assert seen[0] == seen[1] == {"en": 1, "fr": 1, "de": 1}


def test_null_ids_and_rows_alike_are_spread(spark):
    """A third of the rows without id, another third alike in everything: no range holds many more than its share."""
    with Scratch(spark) as scratch:
        i = F.col("id")
        n = 60_000
        d = spark.range(n).select(F.when(i % 3 == 0, i).alias("doc_id"), F.when(i % 3 == 2, "same").otherwise(F.concat(F.lit("w "), i.cast("string"))).alias("text"), F.lit("s").alias("source"))
        one, parts = mixing._in_ranges(mixing.repeated(mixing._units(d), "alike", "nth"), [F.col(c) for c in ("source", "key", "size", "text_hash", "row", "nth")], ["nth"], scratch)
        sizes = [r["count"] for r in one.groupBy("part").count().collect()]
        assert sum(sizes) == n and max(sizes) < 1.5 * n / parts


def test_a_text_of_20_mb_is_mixed_whole(spark):
    text = "word " * 4_000_000
    out = mixing.mixed(docs(spark, [(1, text, "s"), (2, "a b", "s")])).select("doc_id", F.length("text").alias("n")).collect()
    assert {r.doc_id: r.n for r in out} == {1: 20_000_000, 2: 3}
