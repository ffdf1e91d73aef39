"""The conversation trie against all prefixes of all conversations."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import sha

from tallowmere.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def turns_of(rows):
    """conv_id -> its turns (role, text) in order; ties by SHA-256 of the turn."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def nodes(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * words
    digest = {k: sha(",".join(map(str, sorted(ends[k])))) for k in members}
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], digest[k]) for k, m in members.items())


def rows_of(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


ODD = (
    [(c, t, "user" if t % 2 else None, f"turn {t} of {'all' if t < 3 else c % 4}") for c in range(45) for t in range(c % 7)]
    + [(100, None, "user", "first"), (100, 1, None, None), (100, 1, "user", "a"), (100, 1, "user", "a"), (100, 1, "user", "b c  d")]
    + [(c, t, "user", "same") for c in range(200, 260) for t in range(5)]
    + [(-5, 0, "", "x"), (-20, 0, "user", "y"), (-20, 0, "user", "y"), (None, 0, "user", "nobody's"), (7, 9, "system", "word " * 3000), (8, 0, "é", "  \x0b中")]
    + [(300, t, "user", str(t)) for t in range(120)]
    + [(301, t, "user", str(t)) for t in range(60)]
)


@pytest.mark.parametrize("local", [trie.LOCAL, 40, 1])
def test_trie_equals_all_prefixes(spark, local):
    d = spark.createDataFrame([(*r, 1, "x") for r in ODD], SCHEMA + ", digest int, words string")
    assert rows_of(trie.conversation_trie(d, local)) == nodes(turns_of(ODD))


def test_rebuilt_trie_equals_all_prefixes(spark):
    d = spark.createDataFrame(ODD, SCHEMA)
    assert rows_of(trie.rebuilt_trie(d, 60)) == nodes(rebuilt(turns_of(ODD)))


def test_query_on_given_conversations(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op11_conversation_trie(spark, small)) == nodes(rebuilt(turns_of(rows)))


def test_empty_and_nameless(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_quicksort_makes_each_node_once():
    rows = [([1, 2, 3], [1, 1, 1], 2, 5, "e1"), ([1, 2], [1, 1], 1, 3, "e2"), ([1, 4], [1, 7], 1, 9, "e3"), ([2], [4], 3, 1, "e4")]
    got = sorted((x[0], x[1], x[3], x[4], x[5], x[6], x[7]) for x in trie._quicksort(rows, 0))
    none = trie.NOTHING
    assert got == sorted([(3, 1, 4, 2, 2, 3 + 2 + 1, none), (3, 2, 3, 1, 1, 2 + 1, "e2"), (5, 3, 2, 0, 1, 1, "e1"), (9, 2, 1, 0, 1, 0, "e3"), (1, 1, 3, 0, 1, 8, "e4")])


def test_digest_of_a_large_group_streams_in_pieces():
    import pyarrow as pa

    ids = list(range(0, 5000, 3))
    parts = [pa.record_batch([pa.array([b"k"] * len(p)), pa.array(p)], names=["key", "conv_id"]) for p in (ids[:700], ids[700:900], ids[900:])]
    (out,) = [b for b in trie._digests(trie._pieces(iter(parts))) if b.num_rows]
    assert out.column("ends").to_pylist() == [sha(",".join(map(str, ids)))]
