"""Encoding and decoding against the library whose results are the contract."""

import hashlib
import struct
from collections import Counter

import public_tokenizers
import pytest
from helpers import ODD, SCHEMA, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallowmere.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.WordBpe(f.read(), words=50)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts(spark, library):
    rows = list(enumerate(ODD)) + [(7, ODD[7]), (None, "no id"), (60, "it's we'll THEY'RE 123 a.b,c!! <|startoftext|>x"), (61, "ｆｕｌｌ ﬁ ² Ⅷ ͅ ‍ ＿")]
    got = bpe.encoded(docs(spark, rows, token_ids=1, n_tokens=2), PATH).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter((i, *expected(library, t)) for i, t in rows)


def test_query_on_given_documents(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op6_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id])


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(max_size=60) | st.text(alphabet="aAbB' \t\n.019éßΣσ<|endoftext|>", max_size=60))
def test_any_text(library, own, text):
    assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert own.tokens(own.encode(text)) == library.decode(own.encode(text).tolist(), skip_special_tokens=False)


def test_every_plane_is_cut_as_the_library_does(library, own):
    """One of seven characters of all of Unicode, after a mark and before a letter."""
    texts = [f":{chr(c)}a" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts += [f":{chr(c)}a" for a, b, _ in bpe.CAPITALS for c in range(a, b + 1)]
    assert [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if list(own.encode(t)) != e.ids] == []


def plain_merge(ids, merges):
    ids = list(ids)
    while True:
        found = [(merges[p] >> 20, i) for i, p in enumerate(a << 20 | b for a, b in zip(ids, ids[1:])) if p in merges]
        if not found:
            return ids
        _, i = min(found)
        ids[i : i + 2] = [merges[ids[i] << 20 | ids[i + 1]] & 0xFFFFF]


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25, unique=True))
def test_segment_tree_merges_as_plain_search(ids, pairs):
    merges = {a << 20 | b: rank << 20 | (4 + rank) for rank, (a, b) in enumerate(pairs)}
    assert bpe.merge(ids, merges) == plain_merge(ids, merges)


def test_decoding_spells_the_words_again(spark):
    rows = [(1, "it is  A small\ttest"), (2, None), (3, "naïve café 中文 😀"), (4, "one<|endoftext|>two")]
    ids = bpe.encoded(docs(spark, rows), PATH)
    got = {r.doc_id: r.decoded for r in bpe.decoded(ids, PATH).collect()}
    assert got == {1: "it is a small test", 2: "", 3: "naïve café 中文 😀", 4: "one <|endoftext|> two"}


def test_empty_table(spark):
    assert bpe.encoded(spark.createDataFrame([], SCHEMA), PATH).count() == 0
