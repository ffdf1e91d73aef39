"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Spark spreads the documents; a worker encodes each of its distinct words once and keeps the result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, text_of

#: No pair of tokens: greater than any rank.
NONE = 1 << 62
#: Words a worker remembers in each of two generations; the older one is forgotten when the newer is full.
WORDS = 500_000


#: First and last of the letters and digits that are new in Unicode 16.0.  The tokenizers know them.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0),
    (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
#: First and last capital letter and first small one, new in Unicode 16.0 and 17.0; the tokenizers lower-case them.
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_SMALL = {c: c - a + small for a, b, small in CAPITALS for c in range(a, b + 1)}
_CAPITAL = re.compile("[" + "".join(map(chr, _SMALL)) + "]")


@lru_cache(1)
def later_characters() -> str:
    """A character class of what ``regex`` takes for letters and digits but Unicode 16.0 has not: unassigned for this Python (15.1), and not among :data:`UNICODE_16`."""
    known = {c for a, b in UNICODE_16 for c in range(a, b + 1)}
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    later = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn" and ord(c) not in known]
    return "".join(_ranges(later))


def _ranges(points: list[int]) -> list[str]:
    """Ascending code points as ranges of a character class."""
    runs: list[list[int]] = []
    for c in points:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return [f"\\U{a:08x}-\\U{b:08x}" for a, b in runs]


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def merge(ids: list[int], merges: dict[int, int]) -> list[int]:
    """The ids after every merge that ``merges`` allows, the lowest rank first and of its places the leftmost.

    ``merges`` has for a pair, left id * 2^20 + right id, its rank * 2^20 + the merged id.  The leaves of the
    segment tree are the adjacent pairs, each as rank * length + position (so that a minimum settles
    ties to the left) and each node holds the minimum below it.  The root is the next merge; it changes
    three leaves at most, and each change climbs until a node keeps its value.
    """
    n = len(ids)
    get, m = merges.get, n - 1
    size = 1 << max(0, (m - 1).bit_length())
    tree = [NONE] * (2 * size)
    k = size
    for i in range(m):
        if (f := get(ids[i] << 20 | ids[i + 1])) is not None:
            tree[k + i] = (f >> 20) * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, m))
    while (top := tree[1]) < NONE:
        i = top % n
        j = after[i]
        left = ids[i] = get(ids[i] << 20 | ids[j]) & 0xFFFFF
        ids[j] = -1
        after[i] = q = after[j]
        changed = [(j, NONE)] if j < m else []
        value = NONE
        if q < n:
            before[q] = i
            if (f := get(left << 20 | ids[q])) is not None:
                value = (f >> 20) * n + i
        changed.append((i, value))
        if (h := before[i]) >= 0:
            f = get(ids[h] << 20 | left)
            changed.append((h, NONE if f is None else (f >> 20) * n + h))
        for k, value in changed:
            k += size
            tree[k] = value
            while k > 1:
                if (b := tree[k ^ 1]) < value:
                    value = b
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    return [x for x in ids if x >= 0]


class WordBpe:
    """A tokenizer of words with an end mark, read from the JSON text of its file.

    Lower-cases and composes (NFC) the text, drops white space, cuts it into words and merges their
    bytes.  The strings of special tokens in a text become those tokens.
    """

    WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: The same for lower-cased ASCII.
    PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)

    def __init__(self, source: str, words: int = WORDS):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letter = byte_characters()
        self.byte = {c: b for b, c in self.letter.items()}
        self.first = [self.vocab.get(self.letter[b]) for b in range(256)]
        self.last = [self.vocab.get(self.letter[b] + self.end) for b in range(256)]
        # texts with characters that only newer Unicode knows are cut by a slower pattern, the same but for these
        self.later = re.compile(f"[{later}]") if (later := later_characters()) else None
        # most texts have no character as high as these: a range is looked for much faster than a large class
        self.high = re.compile(f"[{later.partition('-')[0]}-\U0010ffff]") if later else None
        self.exact = regex.compile(
            rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{later}]]+|[\p{{N}}--[{later}]]|(?:[{later}]|[^\s\p{{L}}\p{{N}}])+" if later else self.WORD.pattern
        )
        self.limit, self.new, self.old = words, {}, {}

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return merge([i for i in ids if i is not None], self.merges)

    def known(self, word: str) -> bytes:
        """The word's ids as unsigned 32-bit integers."""
        if (found := self.old.get(word)) is None:
            found = array("I", self.word_ids(word)).tobytes()
        if len(self.new) >= self.limit:
            self.old = dict(self.new)
            self.new.clear()
        self.new[word] = found
        return found

    @staticmethod
    def normal(text: str) -> str:
        """Composed, lower-cased one character at a time (a final sigma is as any other)."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text.translate(_SMALL) if _CAPITAL.search(text) else text

    def pieces(self, text: str) -> list[bytes]:
        out: list[bytes] = []
        parts = self.marks.split(text) if "<|" in text else [text]
        for part in parts:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            get, known = self.new.get, self.known
            if part.isascii():
                words = self.PLAIN.findall(part.lower())
            else:
                part = self.normal(part)
                later = self.later and self.high.search(part) and self.later.search(part)
                words = (self.exact if later else self.WORD).findall(part)
            out += [get(w) or known(w) for w in words]
        return out

    def encode(self, text: str) -> array:
        ids = array("I")
        ids.frombytes(b"".join(self.pieces(text)))
        return ids

    def tokens(self, ids) -> str:
        """The tokens of the ids with a space between: what a tokenizer without a decoder decodes to, special ones too."""
        return " ".join(map(self.token.__getitem__, ids))

    def decode(self, ids) -> str:
        """The words that the ids spell, special tokens as they are, one space after each word."""
        out, word = [], []
        for i in ids:
            t = self.token[i]
            if t in self.special:
                out.append(t)
                continue
            whole = t.endswith(self.end)
            word += [self.byte[c] for c in (t[: -len(self.end)] if whole else t)]
            if whole:
                out.append(bytes(word).decode(errors="replace"))
                word = []
        return " ".join(out + ([bytes(word).decode(errors="replace")] if word else []))


@lru_cache(1)
def of_worker(source: str) -> WordBpe:
    """The tokenizer that a Python worker keeps for all of its tasks, with the words it remembers."""
    return WordBpe(source)


def encoded(docs: DataFrame, tokenizer: str, carry: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """``carry`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids of each whole text.

    ``tokenizer`` is the path of the tokenizer's file on the driver; its text (its size is the
    vocabulary's, not the data's) is broadcast.  Null counts as empty: no tokens and the digests of
    nothing.  Rows stay as many and as they are; repeated ones are encoded again.  ``ids_sha256`` is that of
    the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` that of the text in UTF-8 that the ids
    decode to, both in lower-case hex.  :func:`decoded` spells the words instead, without the marks of
    their ends.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    kept = docs.select(*carry, text_of().alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids

    def run(batches):
        bpe = of_worker(source.value)
        for b in batches:
            n, a, c, lists = [], [], [], []
            for text in b.column(len(carry)).to_pylist():
                own = bpe.encode(text)
                raw = own.tobytes()
                n.append(len(own))
                a.append(hashlib.sha256(raw).hexdigest())
                c.append(hashlib.sha256(bpe.tokens(own).encode()).hexdigest())
                if ids:
                    lists.append(raw)
            out = [*b.columns[: len(carry)], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())]
            if ids:
                ends = [0]
                for x in n:
                    ends.append(ends[-1] + x)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(lists))])
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
            yield pa.RecordBatch.from_arrays(out, [*carry, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids])

    return kept.mapInArrow(run, schema)


def decoded(rows: DataFrame, tokenizer: str, column: str = "token_ids") -> DataFrame:
    """``rows`` with a column ``decoded``: the words that the ids of ``column`` spell; null for null."""
    spark = rows.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = of_worker(source.value)
        for s in batches:
            yield s.map(lambda x: None if x is None else bpe.decode(x.tolist()))

    return rows.withColumn("decoded", run(F.col(column)))
