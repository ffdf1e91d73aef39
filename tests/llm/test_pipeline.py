"""The corpus pipeline, stage by stage against plain Python, and its handling of odd rows."""

import hashlib
import struct
from collections import Counter
from pathlib import Path

import corpus_pipeline
import public_tokenizers
from helpers import ODD, components_of, docs, mix, normal
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallowmere.llm import toxicity


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "bpe"]


def after_toxicity(rows):
    """Rows (doc_id, source, n_tokens, ids, decoded) that the later stages make of (doc_id, source, text) rows without null ids."""
    least = {}
    for i, s, t in sorted(rows, key=lambda r: r[0]):
        least.setdefault(normal(t), (i, s, t))
    rows = list(least.values())
    fp, names = components_of([(i, t) for i, _, t in rows])
    rows = [r for r, (i, f) in zip(rows, fp, strict=True) if names[f] == i]
    _, _, taken = mix(rows)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    out = Counter()
    for (i, s, t), n in zip(rows, taken, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        if n:
            out[(i, s, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += n
    return out


def test_run_equals_brute_force_after_the_classifier(spark, small):
    d, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    clean = [(r.doc_id, r.source, r.text) for r in toxicity.drop_toxic(d, labels).collect()]
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(base.iterdir())
    got = corpus_pipeline.run(spark, small)
    assert len([f for f in base.iterdir() if f not in before]) == 1  # the last stage's
    rows = got.collect()
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == after_toxicity(clean)
    assert all(len(r.token_ids) == r.n_tokens for r in rows)


def test_stages_take_odd_rows_and_keep_the_columns(spark, small):
    odd = [(i, t) for i, t in enumerate(ODD)] + [(50, ODD[4]), (51, ODD[4]), (51, ODD[4]), (None, "no id"), (None, "no id")]
    d = docs(spark, odd).withColumns({"lang": F.lit(None).cast("string"), "extra": F.array(F.lit(1))})
    names = d.columns
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, small)
        assert name == "bpe" or d.columns == names
        d = spark.createDataFrame(d.collect(), d.schema)
    assert d.count() > 0


def test_stages_take_no_rows(spark, small):
    d = docs(spark, [(1, "x")]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, small)
        assert d.count() == 0
        d = spark.createDataFrame([], d.schema)
