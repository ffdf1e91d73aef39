"""Phrases through the index, replay, assertions, digests and the batch ledger: each fault made once."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallowmere import catalog
from tallowmere.operators import phrases, release
from tallowmere.streaming import ledger


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_indexed_phrases_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(words, n))
    library = [(p, i, say(rng.integers(1, 9))) for p in range(12) for i in range(3)]
    texts = [(i, say(rng.integers(1, 40)) + " " + (library[i % 36][2] if i % 3 else "") + " rare") for i in range(120)] + [(900, library[4][2]), (901, ""), (902, None)]
    d = spark.createDataFrame(texts, "id long, text string").withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    p = spark.createDataFrame(library, "package int, place long, text string")
    got = {(r.id, r.package, r.place): (r.match_type, round(r.coverage, 9)) for r in phrases.matches(d, "id", p, ["package", "place"]).collect()}
    want = {}
    for (i, t), (k, n, s) in itertools.product([(i, (t or "").strip()) for i, t in texts], library):
        a, b = t.split(), s.split()
        cov = len(set(a) & set(b)) / len(set(b))
        kind = "EXACT" if t == s else "CONTAINED" if len(b) >= 4 and f" {s} " in f" {t} " else "HIGH_OVERLAP" if len(b) >= 4 and cov >= 0.8 else None
        if kind:
            want[i, k, n] = (kind, round(cov, 9))
    assert got == want and {k for k, _ in want.values()} == {"EXACT", "CONTAINED", "HIGH_OVERLAP"}
    pairs = phrases.candidates(d, "id", p, ["package", "place"]).count()
    assert len(want) <= pairs < len(texts) * len(library)  # thirty words only: even the rarest is in many texts
    best = {r.id: r.match_type for r in phrases.best(phrases.matches(d, "id", p, ["package", "place"]), "id", ["package", "place"]).collect()}
    assert best[900] == "EXACT" and 901 not in best


def test_a_common_word_lists_no_phrase_that_has_rarer_ones(spark):
    d = spark.createDataFrame([(i, "the common words") for i in range(50)] + [(99, "the odd phrase stands here")], "id int, text string")
    p = spark.createDataFrame([(1, "the odd phrase stands")], "k int, text string")
    assert [r.id for r in phrases.candidates(d, "id", p, ["k"]).collect()] == [99]


def test_texts_are_not_cut_into_words_for_each_pair(spark):
    d = spark.createDataFrame([(i, "the odd phrase stands here") for i in range(3)], "id int, text string")
    p = spark.createDataFrame([(1, "the odd phrase stands"), (2, "phrase the here odd not"), (3, "here the"), (4, "odd phrases stands the here here")], "k int, text string")
    got = phrases.matches(d, "id", p, ["k"])
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.k, r.match_type, r.coverage) for r in got.collect()} == {(1, "CONTAINED", 1.0), (2, "HIGH_OVERLAP", 0.8), (4, "HIGH_OVERLAP", 0.8)}


def test_phrases_come_out_of_nested_evidence(spark):
    d = spark.createDataFrame([("a", [("One, two!", 1), ("", 2), ("THREE", 3)]), ("b", [])], "pkg string, items array<struct<said:string,n:int>>")
    assert [tuple(r) for r in phrases.from_packages(d, "pkg", "items", "said").orderBy("place").collect()] == [("a", 0, "one two"), ("a", 2, "three")]


RESPONSE = "cell_id string, part int, of int, payload string, payload_sha256 string"


def test_each_fault_of_a_replay_shows_at_its_cell(spark):
    plan = release.planned(spark.createDataFrame([(i,) for i in range(7)], "case long"), spark.createDataFrame([("S0", 1)], "level string, n int"), 1, "v1")
    cell = {r.case: r.cell_id for r in plan.collect()}
    assert len(set(cell.values())) == 7
    good = lambda c, part, of: (cell[c], part, of, f"{c}/{part}", sha(f"{c}/{part}"))
    rows = [good(0, 1, 1), good(1, 2, 2), good(1, 1, 2), good(2, 1, 1), good(2, 1, 1), (cell[3], 1, 1, "changed", sha("3/1")), good(4, 1, 2), good(5, 1, 2), good(5, 2, 3), ("unknown", 1, 1, "x", sha("x"))]
    got = {r.case: (r.status, r.parts) for r in release.replayed(plan, spark.createDataFrame(rows, RESPONSE)).collect()}
    assert got == {0: ("CERTIFIED", 1), 1: ("CERTIFIED", 2), 2: ("DUPLICATED", 2), 3: ("ALTERED", 1), 4: ("INCOMPLETE", 1), 5: ("INCONSISTENT", 2), 6: ("MISSING", 0), None: ("UNPLANNED", 1)}
    other = {r.case: r.cell_id for r in release.planned(plan.select("case"), spark.createDataFrame([("S0", 1)], "level string, n int"), 1, "v2").collect()}
    assert not set(other.values()) & set(cell.values())


def test_a_release_covers_its_rows(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "c|d")]
    frame = lambda x: spark.createDataFrame(x, "i int, t string")
    digest = lambda x: release.table_digest(frame(x)).first().digest
    assert digest(rows) == digest(rows[::-1]) == release.table_digest(frame(rows).repartition(3)).first().digest
    others = [rows[:-1], rows[:2] + rows[3:], [*rows, (3, "c|d")], [(1, "b"), *rows[1:]], [(1, "a"), (2, ""), (2, None), (3, "c|d")], []]
    assert len({digest(x) for x in [rows, *others]}) == 7
    one, other = (release.chained({"inputs": frame(rows), "results": frame(x)}) for x in (rows, others[0]))
    assert one[0] == other[0] and one[1][3] != other[1][3]
    assert release.chained({"inputs": frame(others[0]), "results": frame(rows)})[1][3] != one[1][3]


def test_each_assertion_is_broken_once(spark):
    tables = {"a": spark.createDataFrame([(1, 5), (2, -1), (2, None), (None, 3)], "k int, v int"), "b": spark.createDataFrame([(1,), (1,)], "k int")}
    found = release.verified(tables, [
        release.Assertion("v", "a", never="v < 0"), release.Assertion("whole", "a", never="v IS NULL", blocking=False), release.Assertion("fine", "a", never="v > 100"),
        release.Assertion("key", "a", key=("k",)), release.Assertion("ref", "a", refers=(("k",), "b", ("k",))), release.Assertion("back", "b", refers=(("k",), "a", ("k",))),
    ])
    got = {r.assertion: (r.rows, r.violations, r.status) for r in found.collect()}
    assert got == {"v": (4, 1, "FAIL"), "whole": (4, 1, "WARN"), "fine": (4, 0, "PASS"), "key": (4, 1, "FAIL"), "ref": (3, 2, "FAIL"), "back": (2, 0, "PASS")}


@pytest.mark.parametrize(
    ("text", "keys"),
    [('{"a": {"b": [{"c" : 1}]}}', ["a", "b", "c"]), ('{"a": "x \\"b\\": 1"}', ["a"]), ('{"a\\"b": "a\\"b"}', ['a\\"b']), ('["a", "b"]', []), ("{}", []), (None, None), ('{"x": "y:z", "x": {"y": 1}}', ["x", "y"])],
)
def test_keys_at_any_depth(spark, text, keys):
    assert spark.createDataFrame([(text,)], "t string").select(release.json_keys(F.col("t"))).first()[0] == keys


def test_every_state_occurs_in_the_query(spark, small):
    states = {r.status for r in catalog.QUERIES["replayed_cells"](spark, small).select("status").distinct().collect()}
    assert {"CERTIFIED", "ALTERED", "INCOMPLETE", "MISSING", "UNPLANNED"} <= states


def test_a_stream_goes_on_where_it_broke_off(spark, tmp_path):
    """Killed between the rows and the ledger: the batch is written again, its rows count once, later ones follow."""
    schema, out = "id long, v long", f"file://{tmp_path}/out"
    put = lambda k: spark.range(k * 10, k * 10 + 10).select("id", (F.col("id") * 2).alias("v")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    fails = {1}

    def broken(number):
        if number in fails:
            fails.discard(number)
            raise RuntimeError("killed")

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        w = s.writeStream.foreachBatch(ledger.sink(out, release.table_digest, broken)).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        w.awaitTermination()

    for k in range(3):
        put(k)
    with pytest.raises(Exception, match="killed"):
        run()
    assert ledger.committed(spark, out, schema).count() == 10 and ledger.attempts(spark, out).count() == 3
    run()
    rows = ledger.committed(spark, out, schema).collect()
    assert sorted(r.id for r in rows) == list(range(30))
    assert {r.batch: (r.attempt, r.rows) for r in ledger.written(spark, out).collect()} == {0: (1, 10), 1: (2, 10), 2: (1, 10)}
    again = ledger.sink(out, release.table_digest)
    one = ledger.committed(spark, out, schema).where("batch = 1").drop("batch")
    again(one, 1)  # the same batch once more adds nothing
    assert ledger.committed(spark, out, schema).count() == 30 and ledger.attempts(spark, out).where("batch = 1").count() == 3
    with pytest.raises(ValueError, match="other rows"):
        again(one.limit(3), 1)
