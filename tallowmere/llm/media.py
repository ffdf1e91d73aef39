"""Media columns: local image descriptors that find cropped or edited copies of pictures.

Corners at several scales get an orientation from the intensity around them and 128 binary tests turned
by it.  Descriptors meet through tables keyed by some of their bits, a query's keys also with one bit turned,
and are verified by Hamming distance and by a neighbouring corner that looks alike and lies in the same
direction; of two pictures' matches, those that agree on one shift, turn and scale are counted.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, small_batches

#: Scales of the pyramid, and those at which a query is described, so that copies of sizes between are met too.
SCALES, FINE_SCALES = (1.0, 0.707, 0.5), (1.0, 0.841, 0.707, 0.595, 0.5)
#: A corner for so many pixels of a scale, and at least so many of a picture; half a patch's width.
PIXELS_PER_CORNER, LEAST_CORNERS, REACH = 230, 7, 10
#: Nearest corners of the same scale that a descriptor knows; bits of their first 64 that may differ; how far their directions may lie apart, of 256.
NEIGHBOURS, NEAR_HAMMING, NEAR_TURN = 3, 8, 21
#: Bits of 128 that may differ; matches that must agree; pixels that their shifts may differ.
HAMMING, AGREE, SLACK = 16, 4, 8
#: Tables are as many as find this share of the pairs that differ in so many bits.
RECALL, DISTANCE = 0.9, HAMMING


def _tests(n: int = 128, seed: int = 11) -> np.ndarray:
    """Pairs of points y, x, y, x of a patch to compare.  Close pairs in any direction: their outcomes depend on each other the least."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        (y, x), length, turn = rng.uniform(-0.7 * REACH, 0.7 * REACH, 2), rng.uniform(3, 6), rng.uniform(-np.pi, np.pi)
        dy, dx = length / 2 * np.sin(turn), length / 2 * np.cos(turn)
        t = np.round([y - dy, x - dx, y + dy, x + dx])
        if max(np.hypot(t[0], t[1]), np.hypot(t[2], t[3])) < REACH:
            out.append(t)
    return np.array(out)


_TESTS = _tests()
_Y, _X = np.mgrid[-REACH : REACH + 1, -REACH : REACH + 1]
_DISK = (_X**2 + _Y**2 <= REACH**2).ravel()


def _blur(a: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        p = np.pad(a, 1, mode="edge")
        a = (p[:-2, 1:-1] + 2 * p[1:-1, 1:-1] + p[2:, 1:-1]) / 4
        p = np.pad(a, 1, mode="edge")
        a = (p[1:-1, :-2] + 2 * p[1:-1, 1:-1] + p[1:-1, 2:]) / 4
    return a


#: Rows of a picture, and corners, that are worked on at once: memory beside the picture itself doesn't grow with it.
BAND, CORNERS = 256, 2048


def _bands(height: int, margin: int):
    """Rows lo to hi of each band, and the rows around them that what is computed from them needs."""
    for lo in range(0, height, BAND):
        hi = min(height, lo + BAND)
        yield lo, hi, max(0, lo - margin), min(height, hi + margin)


def resized(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, about the pictures' upper left corners."""
    if scale == 1.0:
        return a.astype(float)
    h, w = max(1, int(a.shape[0] * scale)), max(1, int(a.shape[1] * scale))
    y, x = np.minimum(np.arange(h) / scale, a.shape[0] - 1), np.minimum(np.arange(w) / scale, a.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    out = np.empty((h, w))
    for lo, hi, _, _ in _bands(h, 0):
        up, down, f = y0[lo:hi], y1[lo:hi], fy[lo:hi]
        out[lo:hi] = (a[np.ix_(up, x0)] * (1 - fx) + a[np.ix_(up, x1)] * fx) * (1 - f) + (a[np.ix_(down, x0)] * (1 - fx) + a[np.ix_(down, x1)] * fx) * f
    return out


def _blurred(a: np.ndarray, times: int) -> np.ndarray:
    """:func:`_blur` band by band."""
    out = np.empty_like(a)
    for lo, hi, start, end in _bands(len(a), times):
        out[lo:hi] = _blur(a[start:end], times)[lo - start : hi - start]
    return out


def _corners(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The strongest local maxima of Harris' response, away from the border."""
    e = REACH + 1
    if min(a.shape) <= 2 * e:
        return np.zeros(0, int), np.zeros(0, int)
    found = []
    for lo, hi, start, end in _bands(len(a), 5):
        gy, gx = np.gradient(a[start:end])
        xx, yy, xy = _blur(gx * gx, 2), _blur(gy * gy, 2), _blur(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        p = np.pad(r, 1, mode="constant", constant_values=-np.inf)
        around = r
        for i in (0, 1, 2):
            for j in (0, 1, 2):
                around = np.maximum(around, p[i : i + r.shape[0], j : j + r.shape[1]])
        peak = (r >= around) & (r > 1e-3)
        peak[:, :e] = peak[:, -e:] = False
        y, x = np.nonzero(peak[max(lo, e) - start : max(0, min(hi, len(a) - e) - start)])
        y += max(lo, e) - start
        found.append((y + start, x, r[y, x]))
    y, x, r = (np.concatenate(c) for c in zip(*found, strict=True))
    best = np.argsort(-r, kind="stable")[:most]
    return y[best], x[best]


def _nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Of each corner the places of its ``k`` nearest others, of equally near ones the first.

    Corners in the order of y are looked at in strips, which widen until they hold the nearest of all theirs.
    """
    order = np.argsort(y, kind="stable")
    ys, out = y[order], np.empty((len(x), k), np.int64)
    reach = max(8, int(2 * math.sqrt((np.ptp(x) + 1) * (np.ptp(y) + 1) / len(x))))
    for i in range(0, len(x), BAND):
        todo, wide = order[i : i + BAND], reach
        while len(todo):
            near = np.sort(order[np.searchsorted(ys, y[todo].min() - wide) : np.searchsorted(ys, y[todo].max() + wide, "right")])
            if len(near) > k:
                far = (x[todo, None] - x[near]) ** 2 + (y[todo, None] - y[near]) ** 2
                far[todo[:, None] == near] = np.iinfo(np.int64).max
                # distance first, then place: the order of a stable sort of all
                best = np.argsort(far, axis=1, kind="stable")[:, :k]
                sure = (np.take_along_axis(far, best[:, -1:], 1)[:, 0] < wide * wide) | (len(near) == len(x))
                out[todo[sure]] = near[best[sure]]
                todo = todo[~sure]
            wide *= 2
    return out


def _neighbours(x: np.ndarray, y: np.ndarray, angle: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each corner's nearest others the first halves of their descriptors, and their directions in its own frame, 9 bits each; 0 for none."""
    n = len(x)
    halves, turns = np.zeros((n, NEIGHBOURS), np.int64), np.zeros(n, np.int64)
    if n < 2:
        return halves, turns
    near = _nearest(x, y, min(NEIGHBOURS, n - 1))
    halves[:, : near.shape[1]] = first[near]
    way = np.arctan2(y[near] - y[:, None], x[near] - x[:, None]) - angle[:, None]
    steps = np.floor(way / (2 * np.pi) * 256).astype(np.int64) % 256 | 256
    for k in range(near.shape[1]):
        turns |= steps[:, k] << (9 * k)
    return halves, turns


def _tested(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corners' orientations and descriptors, two halves each."""
    patch = a[(y[:, None] + _Y.ravel()[_DISK]), (x[:, None] + _X.ravel()[_DISK])]
    patch = patch - patch.mean(1, keepdims=True)
    angle = np.arctan2(patch @ _Y.ravel()[_DISK], patch @ _X.ravel()[_DISK])
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    at = lambda u, v: a[np.clip(y[:, None] + np.round(s * u + c * v).astype(int), 0, a.shape[0] - 1), np.clip(x[:, None] + np.round(c * u - s * v).astype(int), 0, a.shape[1] - 1)]
    bits = at(_TESTS[:, 0], _TESTS[:, 1]) > at(_TESTS[:, 2], _TESTS[:, 3])
    return angle, np.packbits(bits, axis=1, bitorder="little").view("<i8")


def describe(picture: np.ndarray, scales: tuple[float, ...] = SCALES) -> np.ndarray:
    """Rows of x, y, angle, scale (of the whole picture's pixels), the two halves of the descriptor, and what is near the corner.

    A structured array; pictures too small or too plain for a corner have none.  The strongest corners count,
    as many as the scale's area asks for.
    """
    kind = [("x", "f4"), ("y", "f4"), ("angle", "f4"), ("scale", "f4"), ("d0", "i8"), ("d1", "i8"), *[(f"n{k}", "i8") for k in range(NEIGHBOURS)], ("turns", "i8")]
    out = []
    for scale in scales:
        a = _blurred(resized(picture, scale), 2)
        y, x = _corners(a, max(LEAST_CORNERS, a.size // PIXELS_PER_CORNER))
        if not len(y):
            continue
        angle, halves = (np.concatenate(c) for c in zip(*[_tested(a, y[i : i + CORNERS], x[i : i + CORNERS]) for i in range(0, len(y), CORNERS)], strict=True))
        rows = np.zeros(len(y), kind)
        rows["x"], rows["y"], rows["angle"], rows["scale"] = x / scale, y / scale, angle, 1 / scale
        rows["d0"], rows["d1"] = halves[:, 0], halves[:, 1]
        near, rows["turns"] = _neighbours(x, y, angle, halves[:, 0])
        for k in range(NEIGHBOURS):
            rows[f"n{k}"] = near[:, k]
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, kind)


NEAR = [*[f"n{k}" for k in range(NEIGHBOURS)], "turns"]


def descriptors(pictures: DataFrame, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """``(id, corner, x, y, angle, scale, d0, d1, n0, n1, n2, turns)`` of ``pictures(id, height, width, pixels)``, 8-bit grey rows.

    A null picture, or one whose pixels are not height times width, has no descriptor; a null id is described
    as any other.  Rows that repeat an id are each described, with corners numbered from 0 again.  No
    rows give no rows.
    """
    small_batches(pictures.sparkSession)

    def run(batches):
        for b in batches:
            ids, found = [], []
            for i, h, w, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if raw is None or not h or not w or len(raw) != h * w:
                    continue
                d = describe(np.frombuffer(raw, np.uint8).reshape(h, w), scales)
                ids += [i] * len(d)
                found.append((np.arange(len(d), dtype=np.int32), d))
            d = np.concatenate([x[1] for x in found]) if found else describe(np.zeros((1, 1)))
            n = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), *[pa.array(np.ascontiguousarray(d[k])) for k in d.dtype.names]], ["id", "corner", *d.dtype.names])

    schema = "id long, corner int, x float, y float, angle float, scale float, d0 long, d1 long, " + ", ".join(f"{c} long" for c in NEAR)
    return pictures.select(F.col("id").cast("long"), F.col("height").cast("int"), F.col("width").cast("int"), "pixels").mapInArrow(run, schema)


def tables(rows: int, recall: float = RECALL, distance: int = DISTANCE, seed: int = 17) -> list[list[int]]:
    """For each table the bits that key it, for an index of so many descriptors.

    A key has so many bits that a few descriptors share it, whatever the size.  A query also asks for the keys
    with one bit turned, so a pair meets in a table unless two of the key's bits differ.  Tables are added until a share
    ``recall`` of random pairs of that ``distance`` meet in one of them.
    """
    bits = min(40, max(14, math.ceil(math.log2(max(2, rows))) - 3))
    rng = np.random.default_rng(seed)
    differ = np.argsort(rng.random((4000, 128)), axis=1) < distance  # pairs by bit
    met, order, out = np.zeros(len(differ), bool), [], []
    sure = recall + 2 * math.sqrt(recall * (1 - recall) / len(differ))  # these pairs are a sample too
    while met.mean() < sure:
        while len(order) < bits:  # all bits once before any again
            order += [b for b in rng.permutation(128).tolist() if b not in order]
        out.append(order[:bits])
        met |= differ[:, out[-1]].sum(1) <= 1
        order = order[bits:]
    return out


def _keyed(d: DataFrame, keys: list[list[int]], turned: bool) -> DataFrame:
    """A row for each table's key ``k``, and with ``turned`` for each key with one bit turned."""
    bit = lambda b: F.shiftrightunsigned(F.col("d0" if b < 64 else "d1"), b % 64).bitwiseAND(F.lit(1))
    whole = [reduce(add, [F.shiftleft(bit(b), i) for i, b in enumerate(bits)], F.lit(t << 40)) for t, bits in enumerate(keys)]
    d = d.withColumn("k", F.explode(F.array(*whole)))
    if turned:
        d = d.withColumn("k", F.explode(F.array(F.col("k"), *[F.col("k").bitwiseXOR(F.lit(1 << i)) for i in range(len(keys[0]))])))
    return d


def _alike() -> Column:
    """Whether the descriptors of a query ``q_`` and of the index are near enough and one neighbour of each looks alike in the same direction."""
    differ = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    way = lambda c, k: F.shiftright(F.col(c), 9 * k).bitwiseAND(F.lit(511))
    near = []
    for i in range(NEIGHBOURS):
        for j in range(NEIGHBOURS):
            a, b = way("q_turns", i), way("turns", j)
            near.append((a > 0) & (b > 0) & (F.pmod(a - b + NEAR_TURN, F.lit(256)) <= 2 * NEAR_TURN) & (differ(f"q_n{i}", f"n{j}") <= NEAR_HAMMING))
    return reduce(or_, near)


def matches(queries: DataFrame, index: DataFrame, hamming: int = HAMMING) -> DataFrame:
    """``(query, c, id, corner)``: the descriptors of a query and of the index that match, each pair once.

    Both sides are :func:`descriptors`.  At most ``hamming`` of all bits differ, and one of the corners'
    nearest neighbours does the same; pairs are looked for through :func:`tables`.  Only what decides this
    goes through the join, a row for each key.
    """
    keys = tables(index.count())
    slim = ["d0", "d1", *NEAR]
    q = _keyed(queries.select(F.col("id").alias("query"), F.col("corner").alias("c"), *slim), keys, True).withColumnsRenamed({c: f"q_{c}" for c in slim} | {"k": "q_k"})
    i = _keyed(index.select("id", "corner", *slim), keys, False)
    bits = F.bit_count(F.col("q_d0").bitwiseXOR(F.col("d0"))) + F.bit_count(F.col("q_d1").bitwiseXOR(F.col("d1")))
    return q.join(i.hint("merge"), (F.col("q_k") == F.col("k")) & (bits <= hamming) & _alike()).select("query", "c", "id", "corner").distinct()


def find_copies(queries: DataFrame, index: DataFrame, hamming: int = HAMMING, agree: int = AGREE) -> DataFrame:
    """``(query, id, agreeing)``: the pictures of ``index`` of which a query seems a cropped or edited copy.

    Both sides are :func:`descriptors`, the queries' best at :data:`FINE_SCALES`.  Each of the :func:`matches` says how the
    query lies in the picture: its turn, its scale and the place of its corner; it votes for the cells of such poses
    around its own, and a pair stands if a cell has ``agree`` corners of the query.  Nothing is capped: a key that many
    descriptors share is joined whole, and Spark splits its partition.  Null ids are a picture of their own on either
    side, repeated ids one picture with all their corners.  An empty side gives no rows.
    """
    with Scratch(queries.sparkSession) as scratch:
        m = scratch.write(matches(queries, index, hamming))
        place = lambda d, names: d.select(*[F.col(a).alias(b) for a, b in names.items()])
        q = place(queries, {"id": "query_", "corner": "c_", "x": "qx", "y": "qy", "angle": "qa", "scale": "qs"})
        i = place(index, {"id": "id_", "corner": "corner_", "x": "x", "y": "y", "angle": "angle", "scale": "scale"})
        m = m.join(q, F.col("query").eqNullSafe(F.col("query_")) & (F.col("c") == F.col("c_")))
        m = m.join(i, F.col("id").eqNullSafe(F.col("id_")) & (F.col("corner") == F.col("corner_")))
        turn, ratio = F.col("angle") - F.col("qa"), F.col("scale") / F.col("qs")
        px = F.col("x") - ratio * (F.cos(turn) * F.col("qx") - F.sin(turn) * F.col("qy"))
        py = F.col("y") - ratio * (F.sin(turn) * F.col("qx") + F.cos(turn) * F.col("qy"))
        near = lambda v, size: F.array(F.floor(v / size - 0.5), F.floor(v / size - 0.5) + 1)
        turns = F.transform(near(F.pmod(turn, F.lit(2 * np.pi)), np.pi / 6), lambda b: F.pmod(b, F.lit(12)))
        cells = m.select("query", "id", "c", "qx", "qy", near(F.log2(ratio), 0.5).alias("zoom"), turns.alias("turn"), near(px, SLACK).alias("bx"), near(py, SLACK).alias("by"))
        for c in ("zoom", "turn", "bx", "by"):
            cells = cells.withColumn(c, F.explode(c))
        # one corner of the query may be met at two scales: it is one place
        spot = F.struct(F.round(F.col("qx") / 4).alias("x"), F.round(F.col("qy") / 4).alias("y"))
        seen = cells.select("query", "id", "zoom", "turn", "bx", "by", spot.alias("spot")).distinct()
        votes = seen.groupBy("query", "id", "zoom", "turn", "bx", "by").agg(F.count("*").alias("n"))
        return scratch.keep(votes.groupBy("query", "id").agg(F.max("n").alias("agreeing")).where(F.col("agreeing") >= agree))


# ---- pictures for tables that hold none -------------------------------------------------------

SIDE = 80


def drawn(seed: int) -> np.ndarray:
    """A grey test picture: 40 rectangles on mottled ground."""
    rng = np.random.default_rng(seed)
    a = _blur(np.kron(rng.uniform(60, 190, (SIDE // 4, SIDE // 4)), np.ones((4, 4))), 2)
    x0, y0 = rng.integers(-8, SIDE - 4, (2, 40))
    w, h = rng.integers(5, 26, (2, 40))
    shade = rng.uniform(0, 255, 40)
    for k in range(40):
        part = a[max(0, y0[k]) : y0[k] + h[k], max(0, x0[k]) : x0[k] + w[k]]
        part *= 0.25
        part += 0.75 * shade[k]
    return np.clip(a, 0, 255).astype(np.uint8)


def edited(picture: np.ndarray, seed: int) -> np.ndarray:
    """A crop of three quarters of the width and height, with other brightness and contrast and some noise."""
    rng = np.random.default_rng(seed ^ 0x5EED)
    side = SIDE * 3 // 4
    y, x = rng.integers(0, SIDE - side + 1, 2)
    part = picture[y : y + side, x : x + side] * rng.uniform(0.7, 0.95) + rng.uniform(0, 12)
    return np.clip(part + rng.normal(0, 1.5, part.shape), 0, 255).astype(np.uint8)


def pictures_of(seeds: DataFrame, edit: bool) -> DataFrame:
    """``(id, height, width, pixels)`` for ``seeds(id, seed)``: a drawing for each seed, or an edited crop of it."""
    small_batches(seeds.sparkSession)

    def run(batches):
        for b in batches:
            made = [drawn(s & 0x7FFFFFFFFFFFFFFF) for s in b.column(1).to_pylist()]
            if edit:
                made = [edited(p, s & 0x7FFFFFFFFFFFFFFF) for p, s in zip(made, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.shape[0] for p in made], pa.int32()), pa.array([p.shape[1] for p in made], pa.int32()), pa.array([p.tobytes() for p in made], pa.binary())], ["id", "height", "width", "pixels"])

    # few bytes a row, but much work: by number, else Spark would put them into one partition
    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seeds.select("id", "seed").repartition(parts).mapInArrow(run, "id long, height int, width int, pixels binary")


def copy_report(vectors: DataFrame, every: int = 50) -> DataFrame:
    """For each row whose vec_id ``every`` divides, the pictures of which its edited crop is found to be a copy.

    The tables have no pictures, so each distinct vector is drawn as one, and a query is a crop of it, edited.
    Rows with equal vectors have equal pictures: they are one class, named by its least vec_id, and only classes
    are compared.  Columns: vec_id (of the query row), class_id (its own picture's class), copy_of (the class
    found; null if none), members (rows of the class found; null if none), agreeing (corners that agree).  Null vectors are one class
    as any other; null ids are members of their class but no queries.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(F.to_json(F.struct("embedding"))).alias("seed"))
    with Scratch(vectors.sparkSession) as scratch:
        v = scratch.keep(v)
        classes = scratch.keep(v.groupBy("seed").agg(F.min("vec_id").alias("id"), F.count("*").alias("members")))
        asked = v.where(F.col("vec_id") % every == 0).select("vec_id", F.col("seed").alias("__seed"))
        index = scratch.write(descriptors(pictures_of(classes, False)))
        query_classes = classes.join(asked.select(F.col("__seed").alias("seed")).distinct(), "seed", "left_semi")
        queries = scratch.write(descriptors(pictures_of(query_classes, True), FINE_SCALES))
        found = find_copies(queries, index)
    named = asked.join(classes, F.col("__seed") == F.col("seed")).select("vec_id", F.col("id").alias("class_id"))
    hits = found.select(F.col("query").alias("__query"), F.col("id").alias("copy_of"), "agreeing").join(classes.select(F.col("id").alias("copy_of"), "members"), "copy_of")
    return named.join(hits, F.col("class_id").eqNullSafe(F.col("__query")), "left").select("vec_id", "class_id", "copy_of", "members", "agreeing")
