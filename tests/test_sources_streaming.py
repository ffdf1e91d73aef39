"""Readers, writers and manifests on files, and the streaming forms."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallowmere.operators import panel
from tallowmere.sources import readers, writers
from tallowmere.streaming import panel_fold, windows


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1||x\n2|y| \n3|z\n")
    d = readers.piped(spark, f"{tmp_path}/a.txt", 3, {0: "id", 1: "v"})
    assert [tuple(r) for r in d.orderBy("id").collect()] == [("1", None), ("2", "y"), ("3", "z")]
    assert {(r.fields, r.rows) for r in readers.widths(spark, f"{tmp_path}/a.txt").collect()} == {(3, 2), (2, 1)}
    (tmp_path / "b.csv").write_text('id,name\n1,"a, ""b"""\n2,\n')
    got = readers.csv(spark, f"{tmp_path}/b.csv", "id int, name string", ["name", "id"])
    assert [tuple(r) for r in got.orderBy("id").collect()] == [('a, "b"', 1), (None, 2)]


def test_only_asked_columns_are_parsed(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,name,more\n1,a,b\n")
    plan = readers.csv(spark, f"{tmp_path}/b.csv", "id int, name string, more string", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int>" in plan


def test_json_lines_strict_and_audited(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{oops\n{"a": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, f"{tmp_path}/a.jsonl", "a int").collect()
    bad = readers.json_lines(spark, f"{tmp_path}/a.jsonl", "a int", audit=True).cache().where("_corrupt_record is not null").collect()
    assert [r["_corrupt_record"] for r in bad] == ["{oops"]
    (tmp_path / "c.json").write_text('{\n "a": 7\n}')
    assert readers.json_document(spark, f"{tmp_path}/c.json", "a int").first().a == 7


def test_nested_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("perf_q1.txt", "l1\nl2\n")
        z.writestr("orig_q1.txt", "o1\n")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("q1.zip", inner.getvalue())
        z.writestr("perf_top.txt", "t\r\n")
    got = readers.nested_zip_lines(spark, str(tmp_path), "perf").collect()
    assert sorted((r.entry, r.line_number, r.line) for r in got) == [("perf_top.txt", 0, "t"), ("q1.zip!perf_q1.txt", 0, "l1"), ("q1.zip!perf_q1.txt", 1, "l2")]


@pytest.mark.parametrize("whole", [10**9, 10])
def test_members_and_digests_are_read_in_pieces(spark, tmp_path, monkeypatch, whole):
    """Alike whether a file is one value for Spark or a stream."""
    monkeypatch.setattr(readers, "PIECE", 7)
    rows = "".join(f"line {i}\n" for i in range(50_000)).encode()
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("perf.txt", rows)
        z.writestr("empty.txt", b"")
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "outer one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("q1.zip", inner.getvalue())
        z.writestr("note.txt", b"no line end")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.entry: (r.bytes, r.lines, r.sha256) for r in readers.zip_members(spark, f"{tmp_path}/in", whole).collect()}
    assert got == {"q1.zip!perf.txt": (len(rows), 50_000, sha(rows)), "q1.zip!empty.txt": (0, 0, sha(b"")), "note.txt": (11, 1, sha(b"no line end"))}
    lines = readers.nested_zip_lines(spark, f"{tmp_path}/in", "perf", whole)
    assert lines.count() == 50_000 and lines.where("line <> concat('line ', line_number)").count() == 0
    whole_file = (tmp_path / "in" / "outer one.zip").read_bytes()
    assert [(r.bytes, r.sha256) for r in readers.digests(spark, f"{tmp_path}/in", whole).collect()] == [(len(whole_file), sha(whole_file))]
    (tmp_path / "in" / "bad.zip").write_bytes(whole_file[:200])
    with pytest.raises(Exception, match="(?i)zip"):
        readers.zip_members(spark, f"{tmp_path}/in", whole).collect()


def test_names_below_a_folder_and_quoted_line_feeds(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "x.csv").write_text(f'id,name\n1,"{d}\n2"\n2,c\n')
    names = {r.name for r in writers.manifest(spark, f"file://{tmp_path}/in").collect()}
    assert names == {"a/x.csv", "b/x.csv"} == {r.path.rpartition("/in/")[2] for r in readers.listing(spark, f"{tmp_path}/in", ".csv").collect()}
    got = readers.csv(spark, f"{tmp_path}/in/a", "id int, name string", line_feeds=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a\n2"), (2, "c")]
    assert tuple(readers.shape(spark, f"{tmp_path}/in", line_feeds=True).first()) == (2, 4)


def test_writers_and_manifests(spark, tmp_path):
    d = spark.createDataFrame([(1, 1 / 3, None), (2, 2.0, "x")], "id int, v double, t string").coalesce(1)
    writers.csv(d, f"{tmp_path}/csv")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/csv").collect())
    assert "1,0.333333333333," in lines[0] and lines[1].startswith("2,2,x")
    writers.json_lines(d, f"{tmp_path}/json")
    assert '{"id":1,"t":null,"v":0.3333333333333333}' in [r.value for r in spark.read.text(f"{tmp_path}/json").collect()]
    writers.parquet(d, f"{tmp_path}/p", ["id"])
    assert readers.parquet(spark, f"{tmp_path}/p", ["t", "id"]).where("id = 2").first().t == "x"
    plan = readers.parquet(spark, f"{tmp_path}/p").where("id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(id" in plan
    now = writers.manifest(spark, f"{tmp_path}/csv").cache()
    writers.assert_locked(now, now)
    changed = now.withColumn("sha256", F.lit("0"))
    assert {r.change for r in writers.drift(now, changed).collect()} == {"changed"}
    with pytest.raises(ValueError, match="drifted"):
        writers.assert_locked(now, changed)
    writers.receipt(spark, f"{tmp_path}/receipt", "s", now, now, 2)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.receipt(spark, f"{tmp_path}/receipt", "s", now, now, 2)


def test_twelve_digits_are_written_as_c_writes_them(spark):
    v = [0.0, 2.0, -1.5, 1 / 3, 100.0, 123456789012.5, 1e20, 1.25e-7, None, 1e11, 20.0]
    got = [r.t for r in spark.createDataFrame([(x,) for x in v], "v double").select(writers.twelve_digits(F.col("v")).alias("t")).collect()]
    assert got == [None if x is None else "123456789013" if x == 123456789012.5 else f"{x:.12g}" for x in v]


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    rows = [(f"e{i % 5}", i // 5 + 1, (i * 7) % 23 == 0, i % 11 == 0) for i in range(70)]
    schema = "entity string, idx int, serious boolean, unknown boolean"
    d = spark.createDataFrame(rows, schema)
    for k, part in enumerate(d.randomSplit([1.0, 1.0, 1.0], 3)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = panel_fold.folded(stream).writeStream.format("memory").queryName("fold_out").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    updates = spark.table("fold_out")
    last = {r.entity: r for r in updates.collect() if r.rows == updates.where(F.col("entity") == r.entity).agg(F.max("rows")).first()[0]}
    want = {r.entity: r for r in panel.fold(d, F.when(F.col("serious"), "x"), F.col("unknown"), F.lit(None).cast("string")).collect()}
    for e, r in want.items():
        assert (last[e].first_idx, last[e].last_idx, last[e].observed_mask, last[e].unknown_mask, last[e].event_idx, last[e].rows) == (r.first_idx, r.last_idx, r.observed_mask, r.unknown_mask, r.event_idx, r.rows)


def test_windows_over_a_stream(spark, tmp_path):
    schema = "id long, ts timestamp, kind string, value double"
    rows = [(1, "2024-01-01 00:00:10", "a", 1.0), (1, "2024-01-01 00:00:10", "a", 1.0), (2, "2024-01-01 00:04:00", "a", 2.0), (3, "2024-01-01 00:11:00", "b", 4.0), (4, "2024-01-01 03:00:00", "z", 0.0)]
    d = spark.createDataFrame(rows, "id long, ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = lambda: windows.files(spark, f"{tmp_path}/in", schema)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name).collect()

    t = {(str(r.start), r.kind): (r.rows, r.total) for r in run(windows.tumbling(s(), "ts", "kind", "10 minutes", "1 minute"), "tumbling")}
    assert t == {("2024-01-01 00:00:00", "a"): (3, 4.0), ("2024-01-01 00:10:00", "b"): (1, 4.0)}
    ses = {(str(r.start), r.kind): r.rows for r in run(windows.sessions(s(), "ts", "kind", "5 minutes", "1 minute"), "sessions")}
    assert ses == {("2024-01-01 00:00:10", "a"): 3, ("2024-01-01 00:11:00", "b"): 1}
    assert sorted(r.id for r in run(windows.once(s(), "id", "ts", "1 minute"), "once")) == [1, 2, 3, 4]
    slid = run(windows.sliding(s(), "ts", "kind", "10 minutes", "5 minutes", "1 minute"), "sliding")
    assert sum(r.rows for r in slid if r.kind == "a") == 6


def _quarter(n, method=zipfile.ZIP_DEFLATED):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", method) as z:
        z.writestr(f"orig_{n}.txt", "".join(f"{n}|{i}\n" for i in range(300)))
        z.writestr(f"perf_{n}.txt", "".join(f"{n}|{i}|x\r\n" for i in range(9000)) + "last")
    return inner.getvalue()


def test_an_archive_is_read_by_a_task_for_each_entry(spark, tmp_path):
    """Four stored archives of two entries in one: eight tasks; a deflated archive is one."""
    from tallowmere.sources import archives

    with zipfile.ZipFile(tmp_path / "outer one.zip", "w") as z:
        for n in range(4):
            z.writestr(f"q{n}.zip", _quarter(n))
    with zipfile.ZipFile(tmp_path / "packed.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("q9.zip", _quarter(9))
        z.writestr("deep/empty.txt", "")
        z.writestr("deep/note.txt", "a\n\nb")
    one, other = (f"file://{tmp_path}/{x}" for x in ("outer one.zip", "packed.zip"))
    d = archives.archive_lines(spark, [one])
    assert d.rdd.getNumPartitions() == 8
    assert {r.entry: r["count"] for r in d.groupBy("entry").count().collect()} == {f"q{n}.zip!{k}_{n}.txt": c for n in range(4) for k, c in (("orig", 300), ("perf", 9001))}
    rows = archives.archive_lines(spark, [one, other], "^perf|note|empty").where("entry not like 'q0%'").collect()
    got = {}
    for r in rows:
        got.setdefault(r.entry, {})[r.line_number] = r.line
    assert got.keys() == {"q1.zip!perf_1.txt", "q2.zip!perf_2.txt", "q3.zip!perf_3.txt", "q9.zip!perf_9.txt", "deep/note.txt"}
    assert got["deep/note.txt"] == {0: "a", 1: "", 2: "b"} and got["q9.zip!perf_9.txt"][8999] == "9|8999|x" and got["q9.zip!perf_9.txt"][9000] == "last"


def test_archives_fail_closed(spark, tmp_path):
    from tallowmere.sources import archives

    inner = _quarter(1, zipfile.ZIP_STORED)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("q1.zip", inner)
    path, names = f"file://{tmp_path}/a.zip", ["q1.zip!orig_1.txt", "q1.zip!perf_1.txt"]
    sha = {n: hashlib.sha256(zipfile.ZipFile(io.BytesIO(inner)).read(n.split("!")[1])).hexdigest() for n in names}
    read = lambda **more: archives.archive_lines(spark, [path], **more)
    assert read(sha256=sha, names=names).count() == 9301
    with pytest.raises(Exception, match="SHA-256"):
        read(sha256=sha | {names[0]: "0" * 64}).count()
    with pytest.raises(Exception, match="SHA-256"):
        read(sha256={names[0]: sha[names[0]]}).count()
    with pytest.raises(Exception, match="missing"):
        read(names=[*names, "q2.zip!perf_2.txt"]).count()
    with pytest.raises(Exception, match="must not be there"):
        read(names=names[:1]).count()
    whole = (tmp_path / "a.zip").read_bytes()
    for bad in (whole.replace(b"1|17\n", b"1|71\n"), whole[:-30], whole[:4000] + whole[4100:]):
        assert bad != whole
        (tmp_path / "a.zip").write_bytes(bad)
        with pytest.raises(Exception, match="(?i)crc|zip"):
            read().count()


def test_stored_tables_go_when_released(spark, small):
    from pathlib import Path

    from tallowmere import catalog, session

    session.released()
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before, n = set(base.iterdir()), session.held()
    for name in ("lineage_closure", "topo_levels", "pareto_frontier", "macro_micro_ratio", "perturbed_scores"):
        catalog.QUERIES[name](spark, small).count()
    assert set(base.iterdir()) - before and session.held() > n
    session.released()
    assert set(base.iterdir()) == before
