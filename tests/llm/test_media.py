"""Picture copies: found by local descriptors, whatever else is in the table."""

import numpy as np
from pyspark.sql import functions as F

from tallowmere.llm import media, queries

SCHEMA = "id long, height int, width int, pixels binary"


def table(spark, pictures):
    return spark.createDataFrame([(i, *p.shape, p.tobytes()) for i, p in pictures], SCHEMA)


def test_cropped_and_edited_copies_are_found_and_others_are_not(spark):
    originals = [(i, media.drawn(i)) for i in range(60)]
    crops = [(i, media.edited(p, i)) for i, p in originals[:20]]
    strangers = [(100 + i, media.drawn(1000 + i)) for i in range(20)]
    index = media.descriptors(table(spark, originals).repartition(4))
    got = {(r.query, r.id) for r in media.find_copies(media.descriptors(table(spark, crops + strangers)), index).collect()}
    right = {(i, i) for i in range(20)}
    assert len(got & right) >= 18
    assert len(got - right) <= 1


def test_turned_copies_are_found(spark):
    p = media.drawn(7)
    index = media.descriptors(table(spark, [(1, p), (2, media.drawn(8))]))
    got = {(r.query, r.id) for r in media.find_copies(media.descriptors(table(spark, [(9, np.ascontiguousarray(np.rot90(p)))])), index).collect()}
    assert got == {(9, 1)}


def photo(seed, side=120):
    """A picture that no code of the operator draws: soft waves with filled circles and triangles."""
    rng = np.random.default_rng(900 + seed)
    y, x = np.mgrid[:side, :side].astype(float)
    a = 120 + sum(rng.uniform(8, 25) * np.sin(rng.uniform(-0.15, 0.15) * x + rng.uniform(-0.15, 0.15) * y + rng.uniform(0, 6)) for _ in range(5))
    for k in range(45):
        cy, cx = rng.uniform(0, side, 2)
        if k % 2:
            inside = (y - cy) ** 2 + (x - cx) ** 2 < rng.uniform(3, 12) ** 2
        else:
            turn = rng.uniform(0, 6) + np.array([0, 2.1, 4.2])
            inside = np.all([(y - cy) * np.cos(t) + (x - cx) * np.sin(t) < rng.uniform(2, 8) for t in turn], 0)
        a[inside] = 0.2 * a[inside] + 0.8 * rng.uniform(0, 255)
    return np.clip(a, 0, 255).astype(np.uint8)


def crop(p, share, seed):
    h, w = (int(n * share) for n in p.shape)
    y, x = np.random.default_rng(seed).integers(0, (p.shape[0] - h + 1, p.shape[1] - w + 1))
    return p[y : y + h, x : x + w].astype(float)


def whole(a):
    return np.clip(a, 0, 255).astype(np.uint8)


def blurred(a):
    for _ in range(2):
        p = np.pad(a, 1, mode="edge")
        a = sum(p[i : i + a.shape[0], j : j + a.shape[1]] * (2 - abs(i - 1)) * (2 - abs(j - 1)) for i in range(3) for j in range(3)) / 16
    return a


def coarse(a, step=14):
    """Blocks of 8 by 8 in the cosine basis, their coefficients rounded, as lossy formats do."""
    k = np.arange(8)
    c = np.cos(np.pi * (2 * k + 1) * k[:, None] / 16) / 2
    c[0] /= np.sqrt(2)
    h, w = (n // 8 * 8 for n in a.shape)
    b = a[:h, :w].reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)
    q = step * (1 + np.add.outer(k, k) / 3)
    return (c.T @ (np.round(c @ b @ c.T / q) * q) @ c).transpose(0, 2, 1, 3).reshape(h, w)


def moved(a, turn, scale):
    """Turned about its middle and rescaled, by interpolation."""
    h, w = (int(n * scale) for n in a.shape)
    y, x = np.mgrid[:h, :w]
    dy, dx = (y - (h - 1) / 2) / scale, (x - (w - 1) / 2) / scale
    sy = np.clip(np.cos(turn) * dy - np.sin(turn) * dx + (a.shape[0] - 1) / 2, 0, a.shape[0] - 1.001)
    sx = np.clip(np.sin(turn) * dy + np.cos(turn) * dx + (a.shape[1] - 1) / 2, 0, a.shape[1] - 1.001)
    y0, x0 = sy.astype(int), sx.astype(int)
    fy, fx = sy - y0, sx - x0
    return (a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx) * (1 - fy) + (a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx) * fy


EDITS = {
    "brightness and contrast": lambda p, i: whole(crop(p, 0.75, i) * 0.8 + 9),
    "noise": lambda p, i: whole(crop(p, 0.75, i) + np.random.default_rng(i).normal(0, 3, crop(p, 0.75, i).shape)),
    "blur": lambda p, i: whole(blurred(crop(p, 0.75, i))),
    "compression": lambda p, i: whole(coarse(crop(p, 0.75, i))),
    "half": lambda p, i: whole(crop(p, 0.5, i)),
    "turn": lambda p, i: whole(moved(crop(p, 0.85, i), 0.35, 1.0)),
    "smaller": lambda p, i: whole(moved(crop(p, 0.9, i), 0.0, 0.85)),
    "larger": lambda p, i: whole(moved(crop(p, 0.75, i), 0.0, 1.2)),
}


def bits(d):
    return np.array([[(int(v) & (1 << 64) - 1) >> b & 1 for v in (r.d0, r.d1) for b in range(64)] for r in d], np.uint8).reshape(-1, 128)


def test_independent_pictures_and_edits(spark):
    """Recall of pictures and of descriptors, by edit, against all pairs of descriptors."""
    n = 30
    originals = [(i, photo(i)) for i in range(n)]
    index = media.descriptors(table(spark, originals)).persist()
    queries_ = media.descriptors(table(spark, [(1000 * e + i, f(p, i)) for e, f in enumerate(EDITS.values()) for i, p in originals[:20]]), media.FINE_SCALES).persist()
    found = {(r.query, r.id) for r in media.find_copies(queries_, index).collect()}
    met = {(r.query, r.c, r.id, r.corner) for r in media.matches(queries_, index).collect()}
    q, i = queries_.collect(), index.collect()
    qb, ib = bits(q).astype(np.int16), bits(i).astype(np.int16)
    far = qb.sum(1)[:, None] + ib.sum(1) - 2 * (qb @ ib.T)
    close = lambda a, b: any((ta := a.turns >> 9 * x & 511) and (tb := b.turns >> 9 * y & 511) and (ta - tb + media.NEAR_TURN) % 256 <= 2 * media.NEAR_TURN and ((a[f"n{x}"] ^ b[f"n{y}"]) & (1 << 64) - 1).bit_count() <= media.NEAR_HAMMING for x in range(3) for y in range(3))
    pairs = {(q[a].id, q[a].corner, i[b].id, i[b].corner) for a, b in zip(*np.nonzero(far <= media.HAMMING), strict=True) if close(q[a], i[b])}
    assert met <= pairs
    true = {p for p in pairs if p[0] % 1000 == p[2]}
    assert len(met & true) >= 0.9 * len(true)
    for e, name in enumerate(EDITS):
        own = {(1000 * e + k, k) for k in range(20)}
        assert len(found & own) >= 0.9 * 20, (name, len(found & own))
        assert len([p for p in found if p[0] // 1000 == e] ) - len(found & own) <= 1, name


def test_tables_grow_with_the_index_and_hold_their_recall():
    for rows in (10, 10_000, 10**7, 10**11):
        keys = media.tables(rows)
        assert len({len(k) for k in keys}) == 1 and all(len(set(k)) == len(k) and max(k) < 128 for k in keys)
        rng = np.random.default_rng(rows % 1000)
        flips = [set(rng.choice(128, media.HAMMING, replace=False).tolist()) for _ in range(20_000)]
        assert np.mean([any(len(f & set(k)) <= 1 for k in keys) for f in flips]) >= media.RECALL
    assert len(media.tables(10**11)) > len(media.tables(10_000))


def test_odd_pictures(spark):
    plain = np.full((80, 80), 9, np.uint8)
    rows = [(1, 80, 80, None), (2, None, 80, b"x"), (3, 10, 10, bytes(99)), (4, 2, 2, bytes(4)), (5, 80, 80, plain.tobytes()), (None, 80, 80, media.drawn(1).tobytes()), (6, 80, 80, media.drawn(1).tobytes()), (6, 80, 80, media.drawn(1).tobytes())]
    d = media.descriptors(spark.createDataFrame(rows, SCHEMA).withColumn("corner", F.lit(1)))
    assert {r.id for r in d.select("id").distinct().collect()} == {None, 6}
    assert media.descriptors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert media.find_copies(d.limit(0), d).count() == 0


def test_query_takes_every_fiftieth_row_and_finds_its_picture(spark, medium):
    v = spark.read.parquet(f"{medium}/embeddings.parquet")
    asked = {r.vec_id for r in v.where("vec_id % 50 = 0").select("vec_id").collect()}
    got = queries.op2_media_copies(spark, medium).collect()
    assert {r.vec_id for r in got} == asked
    own = {r.vec_id for r in got if r.copy_of == r.class_id}
    assert len(own) >= 0.9 * len(asked)
    false = [r for r in got if r.copy_of is not None and r.copy_of != r.class_id]
    assert len(false) <= 0.05 * len(asked) + 1


def test_equal_vectors_are_one_class(spark):
    rows = [(0, [0.1, 0.2]), (50, [0.1, 0.2]), (3, [0.1, 0.2]), (100, [0.5, 0.5]), (None, [0.5, 0.5]), (150, None), (7, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.class_id, r.copy_of, r.members) for r in media.copy_report(d.withColumn("seed", F.lit(1))).collect()}
    assert set(got) == {0, 50, 100, 150}
    assert got[0] == got[50] == (0, 0, 3) and got[100] == (100, 100, 2) and got[150][0] == 7
    assert media.copy_report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_a_photo_of_12_megapixels_takes_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    picture = np.clip(media.resized(rng.integers(0, 256, (431, 574)).astype(float), 7.0)[:3000, :4000], 0, 255).astype(np.uint8)
    tracemalloc.start()
    found = media.describe(picture)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(found) > 50_000 and most < 500 << 20


def test_bands_and_strips_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    picture = np.clip(media.resized(rng.integers(0, 256, (50, 60)).astype(float), 7.0)[:300, :400], 0, 255).astype(np.uint8)
    small = media.describe(picture, media.FINE_SCALES)
    monkeypatch.setattr(media, "BAND", 10_000)
    monkeypatch.setattr(media, "CORNERS", 10_000)
    assert len(small) > 500 and np.array_equal(small, media.describe(picture, media.FINE_SCALES))


def test_nearest_corners_equal_all_pairs(monkeypatch):
    monkeypatch.setattr(media, "BAND", 7)
    rng = np.random.default_rng(7)
    for n, side in ((4, 50), (60, 12), (300, 900)):
        x, y = rng.integers(0, side, (2, n))
        far = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
        np.fill_diagonal(far, 1 << 60)
        assert np.array_equal(media._nearest(x, y, 3), np.argsort(far, axis=1, kind="stable")[:, :3])
