"""Scan lines, edges, segments, regions, openings and resampling against plain numpy and planted shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.functions import resample
from rasterflow.operators import dedupe, regions
from rasterflow.operators import scanlines as L

PHOTOS = "photo_id long, height int, width int, px array<int>"


def photos(spark, planes):
    return spark.createDataFrame([(k, *p.shape, p.ravel().tolist()) for k, p in enumerate(planes)], PHOTOS)


def noise(*shape, seed=1):
    return np.random.default_rng(seed).integers(0, 256, shape)


def peaks(plane, low):
    """Strength of the pixels that are the largest across their edge and above low."""
    h, w = plane.shape
    p = np.pad(plane, ((1, 1), (0, 0)), mode="reflect" if h > 1 else "edge")
    p = np.pad(p, ((0, 0), (1, 1)), mode="reflect" if w > 1 else "edge")
    gx = p[:-2, 2:] - p[:-2, :-2] + 2 * (p[1:-1, 2:] - p[1:-1, :-2]) + p[2:, 2:] - p[2:, :-2]
    gy = p[2:, :-2] - p[:-2, :-2] + 2 * (p[2:, 1:-1] - p[:-2, 1:-1]) + p[2:, 2:] - p[:-2, 2:]
    m = np.pad(abs(gx) + abs(gy), 1)
    out = {}
    for y, x in np.argwhere(m[1:-1, 1:-1] > low):
        a, b, v = abs(gx[y, x]), abs(gy[y, x]), m[y + 1, x + 1]
        if b * 32768 < a * 13573:
            top = v > m[y + 1, x] and v >= m[y + 1, x + 2]
        elif b * 32768 > a * (13573 + 65536):
            top = v > m[y, x + 1] and v >= m[y + 2, x + 1]
        else:
            s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
            top = v > m[y, x + 1 - s] and v > m[y + 2, x + 1 + s]
        if top:
            out[int(y), int(x)] = int(v)
    return out


def flood(cells, start):
    seen, todo = set(start), list(start)
    while todo:
        y, x = todo.pop()
        for cell in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
            if cell in cells and cell not in seen:
                seen.add(cell)
                todo.append(cell)
    return seen


def cells_of(rows, key):
    return {(r.y, r.x) for r in rows if r.photo_id == key}


def test_edges_equal_plain_code(spark):
    step = np.where(np.arange(40)[:, None] + np.arange(50) // 5 > 30, 180, 60) + np.zeros((40, 50), int)
    planes = [noise(17, 23) // 4 * 2, step, noise(3, 90, seed=2), np.full((9, 9), 7), noise(1, 8, seed=3), noise(30, 2, seed=4)]
    for low, high in L.EDGES.values():
        found = L.edge_pixels(L.lines(photos(spark, planes)), low, high).collect()
        for k, plane in enumerate(planes):
            weak = peaks(plane, low)
            assert cells_of(found, k) == flood(weak, [c for c, v in weak.items() if v > high]), k


def test_weak_way_between_far_pixels(spark):
    """A snake of weak pixels is kept along its whole length if a strong one is at its end."""
    rows = [(0, 2 * k, x, 1) for k in range(12) for x in range(60)] + [(0, 2 * k + 1, 59 if k % 2 == 0 else 0, 1) for k in range(11)] + [(1, 0, x, 1) for x in range(9)]
    cells = spark.createDataFrame([(*r[:3], 2 if r[:3] == (0, 0, 0) else 1) for r in rows], "photo_id long, y int, x int, value int")
    found = regions.labelled(cells)
    assert {(r.photo_id, r.n, r.top) for r in found.groupBy("photo_id", "region").agg(F.count("*").alias("n"), F.max("value").alias("top")).collect()} == {(0, 12 * 60 + 11, 2), (1, 9, 1)}


@pytest.mark.parametrize("corners", [True, False])
def test_regions_equal_flood(spark, corners):
    mask = noise(18, 70, seed=6) < 100
    cells = {(int(y), int(x)) for y, x in np.argwhere(mask)}
    found = regions.labelled(spark.createDataFrame([(0, *c) for c in cells], "photo_id long, y int, x int"), corners).collect()
    got = {}
    for r in found:
        got.setdefault(tuple(r.region), set()).add((r.y, r.x))
    left, want = set(cells), []
    while left:
        one = flood(cells, [next(iter(left))]) if corners else sides(cells, next(iter(left)))
        want.append(one)
        left -= one
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert all(top == min(members) for top, members in got.items())


def sides(cells, start):
    seen, todo = {start}, [start]
    while todo:
        y, x = todo.pop()
        for cell in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if cell in cells and cell not in seen:
                seen.add(cell)
                todo.append(cell)
    return seen


def test_bounded_regions_of_planted_spots(spark):
    plane = np.zeros((60, 70), int)
    plane[5:8, 5:9] = plane[20:50, 20:50] = 255
    plane[10, 60] = 255
    rows = L.lines(photos(spark, [plane])).withColumn("bright", F.transform("line", lambda v: (v > 200).cast("int")))
    found = regions.bounded(L.marked(rows, "bright"), 2, 100).collect()
    assert [(r.area, r.top, r.left, r.bottom, r.right) for r in found] == [(12, 5, 5, 7, 8)]
    assert regions.bounded(L.marked(rows.where("false"), "bright"), 2, 100).count() == 0


def test_segments_follow_planted_lines(spark):
    """A slanting border gives its angle; gaps up to the bound are bridged, wider ones part a line; steep ones are left out."""
    y, x = np.mgrid[0:120, 0:200]
    planes = [np.where(y > 50 + x * np.tan(np.radians(a)), 200, 50) for a in (0, 3, -6)] + [np.where(y > x, 200, 50), np.zeros((120, 200), int)]
    shots = photos(spark, planes)
    found = L.segments(L.edge_pixels(L.lines(shots), *L.EDGES["horizon"]), 60, 80, 20)
    angles = {r.photo_id: r.angle for r in L.horizon(shots, found).collect()}
    assert abs(angles[0]) < 0.2 and abs(angles[1] - 3) < 0.7 and abs(angles[2] + 6) < 0.7
    assert angles[3] == 0 == angles[4]
    dots = [(0, 10, x) for x in range(100) if not 40 <= x < 50] + [(1, 10, x) for x in range(100) if not 40 <= x < 65]
    edges = spark.createDataFrame(dots, "photo_id long, y int, x int")
    got = sorted((r.photo_id, r.x1, r.x2) for r in L.segments(edges, 30, 30, 20).collect())
    assert got == [(0, 0, 99), (1, 0, 39), (1, 65, 99)]


def windows(mask, size):
    """Union of the squares that fit into mask; three by three counts only what lies inside."""
    h, w = mask.shape
    out = np.zeros_like(mask)
    offsets = range(2) if size == 2 else range(-1, 2)
    for y in range(h):
        for x in range(w):
            cells = [(y + a, x + b) for a in offsets for b in offsets]
            inside = [c for c in cells if 0 <= c[0] < h and 0 <= c[1] < w]
            if (size == 3 or len(inside) == 4) and all(mask[c] for c in inside):
                for c in inside:
                    out[c] = True
    return out


@pytest.mark.parametrize("size", [2, 3])
def test_opening(spark, size):
    mask = noise(25, 31, seed=8) < 200
    rows = L.lines(photos(spark, [mask.astype(int)])).withColumn("m", F.col("line"))
    got = np.array([r.m for r in L.opening(rows, "m", size).orderBy("y").collect()], bool)
    assert (got == windows(mask, size)).all()


def test_median_and_dust(spark):
    plane = noise(22, 27, seed=9)
    padded = np.pad(plane, 1, mode="reflect")
    want = np.median(np.stack([padded[a : a + 22, b : b + 27] for a in range(3) for b in range(3)]), axis=0)
    rows = L.lines(photos(spark, [plane]))
    assert (np.array([r.middle for r in L.median_filter(rows).orderBy("y").collect()]) == want).all()
    assert L.dust(rows).first().share == windows(abs(plane - want) > 28, 2).mean()
    specks = np.full((40, 40), 100)
    specks[10:12, 10:12] = 255  # a square of two keeps its own median from covering it
    specks[30, 30] = 255
    assert L.dust(L.lines(photos(spark, [specks]))).first().share == 4 / 1600


def by_area(plane, m, n):
    h, w = plane.shape
    over = lambda size, out: np.array([[max(0, min((j + 1) * out, (i + 1) * size) - max(j * out, i * size)) for j in range(size)] for i in range(out)])
    return (2 * (over(h, m) @ plane @ over(w, n).T) + h * w) // (2 * h * w)


def test_area_resampling(spark):
    planes = [noise(24, 24), noise(7, 40, seed=2), noise(96, 96, seed=3), noise(1, 1, seed=4), noise(131, 5, seed=5)]
    df = photos(spark, planes).withColumn("m", F.col("height") * 2 % 37 + 3)
    got = df.select("m", resample.area("px", F.col("height"), F.col("width"), F.col("m"), 16).alias("a"), resample.patch("px", F.col("height"), F.col("width")).alias("p"), resample.preview_side(F.col("height"), F.col("height"), F.col("width"), 50).alias("s")).collect()
    for plane, r in zip(planes, got, strict=True):
        assert r.a == by_area(plane, r.m, 16).ravel().tolist()
        assert r.p == by_area(plane, 96, 96).ravel().tolist()
        assert r.s == max(1, round(plane.shape[0] * min(1, 50 / max(plane.shape))))
    empty = spark.createDataFrame([(0, 0, 0, [])], PHOTOS)
    assert empty.select(resample.patch("px", F.col("height"), F.col("width")).alias("p")).first().p == []


def test_signatures_equal_the_cosine_transform(spark):
    planes = [noise(16, 16, seed=k) for k in range(20)] + [noise(40, 30, seed=77)]
    k = np.arange(16)
    waves = np.sqrt(np.where(k == 0, 1, 2) / 16)[:, None] * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 32)
    got = photos(spark, planes).select(dedupe.signature_hex(dedupe.perceptual_hash(F.col("px"), F.col("height"), F.col("width"))).alias("s")).collect()
    for plane, r in zip(planes, got, strict=True):
        low = (waves @ by_area(plane, 16, 16) @ waves.T)[:8, :8]
        assert r.s == f"{int(''.join(map(str, (low > np.median(low[1:])).astype(int).ravel())), 2):016x}"
    ramp = np.add.outer(np.arange(16) * 5, np.arange(16) * 3)
    a, b = photos(spark, [ramp, ramp + 20]).select(dedupe.perceptual_hash(F.col("px"), 16, 16).alias("s")).collect()
    assert a.s == b.s  # a brighter copy has the same


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 300)] + [(5000, 6000), (5500, 5000)], "a long, b long")
    assert {r.node: r.component for r in regions.components(edges).collect()} == {k: 1 for k in range(1, 301)} | {5000: 5000, 5500: 5000, 6000: 5000}


def test_regions_over_blocks_of_lines(spark):
    """A comb and loops that run through several blocks of lines, and blocks that nothing joins."""
    plane = noise(230, 40, seed=9) < 95
    plane[:, 3] = True
    cells = {(int(y), int(x)) for y, x in np.argwhere(plane)}
    found = regions.labelled(spark.createDataFrame([(7, *c) for c in cells], "photo_id long, y int, x int")).collect()
    want, left = {}, set(cells)
    while left:
        part = flood(cells, [min(left)])
        want |= dict.fromkeys(part, min(part))
        left -= part
    assert len(found) == len(cells)
    assert {(r.y, r.x): (r.region.y, r.region.first) for r in found} == want


def test_regions_of_low_photos_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(regions, "components", lambda edges: pytest.fail("joined in rounds"))
    cells = [(k, y, x) for k in range(3) for y in range(60) for x in range(20) if x == 4 or y % 7 == 0]
    assert {tuple(r) for r in regions.labelled(spark.createDataFrame(cells, "photo_id long, y int, x int")).select("photo_id", "region.*").distinct().collect()} == {(k, 0, 0) for k in range(3)}


def test_scenes_are_dealt_to_all_cores(spark, sf_dir):
    from rasterflow.sources import rasters

    assert rasters.scene_rasters(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
