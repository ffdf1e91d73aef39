"""Rows and brute-force forms that several tests of this folder use."""

import hashlib
import re
from collections import defaultdict

import xxhash

BLANK = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Texts that break things: none, empty, blanks only, marks, accents, long.
ODD = [None, "", " \t\n ", "a", "A  b\x0bC", " x y", "İstanbul ΣΑΣ ß", "é́ 中文字 😀", "\x00\x01", "<|endoftext|> <|im_start|>", "word " * 4000, "x" * 30_000]


def docs(spark, rows, **extra):
    """A table of documents from (doc_id, text[, source]) rows, with further columns whose names an operator might use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "web", None if r[1] is None else len(r[1])) for r in rows]
    d = spark.createDataFrame(full, SCHEMA)
    from pyspark.sql import functions as F

    return d.withColumns({k: F.lit(v) for k, v in extra.items()})


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def normal(t):
    return BLANK.sub(" ", t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def fingerprint(text, k=3):
    """The fingerprint, bit by bit."""
    words = [w for w in BLANK.split(ascii_lower(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Groups:
    """Union-find over any keys; the root of a group is its least member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def fingerprint_groups(fps):
    """Root fingerprint of each distinct one, all pairs compared."""
    g, distinct = Groups(), sorted(set(fps))
    for i, a in enumerate(distinct):
        g.find(a)
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                g.join(a, b)
    return {f: g.find(f) for f in distinct}


def components_of(rows):
    """doc_id -> least doc_id of its component, for (doc_id, text) rows."""
    fp = [(i, fingerprint(t)) for i, t, *_ in rows]
    root = fingerprint_groups([f for _, f in fp])
    least = defaultdict(list)
    for i, f in fp:
        if i is not None:
            least[root[f]].append(i)
    return fp, {f: min(least[r]) if least[r] else None for f, r in root.items()}


def mix(rows, weights=(5.0, 2.0, 1.0), repeats=3):
    """What the mix takes of (doc_id, source, text) rows: source targets and copies by row number, one document after the other."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    named = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    total, own = sum(sizes), {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[1] == s) for s in named}
    weight, full = {s: weights[i % len(weights)] for i, s in enumerate(named)}, set()
    while True:
        rest = [s for s in named if s not in full]
        left = total - sum(repeats * own[s] for s in full)
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * level > repeats * own[s]}
        if not over:
            break
        full |= over
    target = {s: float(repeats * own[s]) if s in full else weight[s] * level for s in named}
    offers = []
    for s in named:
        if not target[s]:
            continue
        mine = sorted((hashlib.md5(f"{'' if r[0] is None else r[0]}:mix".encode()).hexdigest(), sizes[i], xxhash_signed(r[2]), i) for i, r in enumerate(rows) if r[1] == s)
        upto = 0
        for key, n, h, i in mine:
            upto += n
            for p in range(min(repeats, -int(-target[s] // own[s]))):
                if n:
                    offers.append(((upto + p * own[s]) / target[s], s is None, s or "", key, h, i))
    taken, spent = [0] * len(rows), 0
    for *_, i in sorted(offers):
        spent += sizes[i]
        if spent > total:
            break
        taken[i] += 1
    return sizes, target, taken


def xxhash_signed(text):
    h = xxhash.xxh64((text or "").encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h
