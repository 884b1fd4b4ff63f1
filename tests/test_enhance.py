import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.operators import images, measure, rules
from rasterflow.operators import transforms as T
from rasterflow.plans import enhance


def photo(h, w, seed, low=20, high=220):
    rng = np.random.default_rng(seed)
    img = np.tile(np.linspace(low, high, w), (h, 1))[..., None] + rng.normal(0, 4, (h, w, 3))
    img[h // 3 : h // 2, w // 4 : w // 2] += 30
    return np.clip(img, 0, 255).astype(np.uint8)


def test_lab_there_and_back():
    img = photo(20, 30, 1)
    assert np.abs(T.from_lab(T.to_lab(img)).astype(int) - img).max() <= 6
    assert T.to_lab(np.full((1, 1, 3), 255, np.uint8))[0, 0].tolist() == [255, 128, 128] and T.to_lab(np.zeros((1, 1, 3), np.uint8))[0, 0].tolist() == [0, 128, 128]


def test_columns_and_images_measure_alike(spark):
    rng = np.random.default_rng(5)
    img = rng.integers(0, 256, (8, 8, 3)).astype(np.uint8)
    gray = T.luma(img)
    df = spark.createDataFrame([(1, gray.reshape(-1).tolist(), *[img[..., k].reshape(-1).tolist() for k in range(3)])], "photo_id long, px array<int>, b array<int>, g array<int>, r array<int>")
    want = measure.colour(measure.all_small(df)).first()
    got = dict(zip(images._NAMES, images.measure_image(img), strict=True))
    for name in ("brightness", "contrast", "dark_35", "light_248", "blur", "noise", "dynamic_range", "saturation_p90", "channel_spread", "colour_cast"):
        assert got[name] == pytest.approx(want[name], abs=1e-4), name
    c = F.col
    scored = measure.all_small(df).select(rules.engine_quality(c("blur"), c("contrast"), c("noise"), c("dark_8"), c("clipped_250")).alias("q")).first().q
    assert images.quality(gray) == pytest.approx(scored, abs=1e-4)


def test_screens_horizons_and_orientations(spark):
    flat = np.full((1800, 900), 120, np.uint8)
    flat[:100], flat[1500:] = 20, 20
    flat[1550:1750:6, 100:800:9] = 230
    shots = [np.repeat(flat[..., None], 3, 2), photo(300, 400, 2)]
    rows = [(k, *p.shape, p.tobytes(), 1) for k, p in enumerate(shots)]
    seen = images.inspected(spark.createDataFrame(rows, "photo_id long, height int, width int, n_channels int, data binary, orientation int"))
    social = {r.photo_id: r.social for r in seen.collect()}
    assert social[0] > 34 > social[1]
    y, x = np.mgrid[0:300, 0:500]
    assert images.horizon(np.where(y > 150 + (x - 250) * np.tan(np.radians(5)), 200, 40).astype(np.uint8)) == pytest.approx(5, abs=1)
    assert images.horizon(flat[:50, :50]) == 0
    tiff = b"II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    assert images.orientation(b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff + b"\xff\xda") == 6
    assert images.orientation(tiff) == 6 and images.orientation(b"\xff\xd8\xff") == 1 and images.orientation(b"") == 1


def test_guards_of_profiles():
    sharp = np.random.default_rng(3).integers(0, 256, (40, 40, 3)).astype(np.uint8)
    assert T.motion(sharp) is sharp
    bright = photo(40, 60, 4, 150, 240)
    assert T.night(bright) is bright
    dark = (photo(40, 60, 4) * 0.25).astype(np.uint8)
    out = T.profile(dark, "auto-night-recovery", {})
    assert out.mean() > dark.mean() and np.array_equal(out, T.mix(dark, T.night(dark), 0.76))
    spotted = np.full((80, 80), 120, np.uint8)
    spotted[10:12, 10:12] = 250
    mask, share = T.dust(spotted)
    assert mask.sum() == 4 and mask[10:12, 10:12].all() and share == 4 / 6400
    spotted[30, 30] = 250  # a single pixel is opened away
    assert T.dust(spotted)[0].sum() == 4
    img = np.full((60, 60, 3), 90, np.uint8)
    img[20:26, 20:26] = 255
    assert T.clean_flares(img, 0.05)[22, 22].max() < 120
    assert np.array_equal(T.clean_flares(img, 0.05, faces=[(18, 18, 10, 10)]), img)


def test_faces_are_lit_and_locked():
    img = photo(80, 80, 6, 20, 120)
    lit = T.relight_faces(img, [(20, 20, 30, 30)])
    assert lit[30:40, 30:40].mean() > img[30:40, 30:40].mean() and np.array_equal(lit[70:], img[70:])
    blurred = T._bytes(T.gaussian(img, 3))
    locked, n, least = T.lock_faces(blurred, img, [(20, 20, 30, 30)])
    assert n == 1 and least < 1 and np.abs(locked[30:40, 30:40].astype(int) - img[30:40, 30:40]).mean() < np.abs(blurred[30:40, 30:40].astype(int) - img[30:40, 30:40]).mean()
    assert T.lock_faces(blurred[:40], img, [(1, 1, 5, 5)])[1:] == (0, 0.0)


def test_strategies_follow_their_gates():
    names = lambda *a: [s for s, _ in enhance.strategy_steps(*a)]
    assert names(1, False, 0, False, 9, 100, 0.2, 0.1) == ["denoise", "detail", "recover_lighting", "finish"]
    assert names(0, False, 9, False, 9, 200, 0, 0) == ["repair_compression", "recover_lighting", "finish"]
    assert names(2, True, 0, True, 9, 100, 0, 0) == ["crop_screenshot", "repair_compression", "restore_monochrome"]
    img = photo(40, 60, 8)
    assert np.array_equal(T.recover_lighting(img, 1, 0.0, 0.0), T.lightened(img, lambda l: T.local_contrast(l, 1.42)))


def test_folder_of_mixed_sizes(spark, tmp_path):
    """Unreadable files keep a row, photos of one stem in several folders and formats a file each; output isn't read again."""
    source = tmp_path / "in"
    (source / "deep er").mkdir(parents=True)
    for k, (name, h, w) in enumerate([("p0.png", 40, 60), ("deep er/p0.png", 90, 50), ("p2.PNG", 33, 33), ("note.txt", 9, 9)]):
        (source / name).write_bytes(T.png(photo(h, w, k)))
    (source / "p0.jpg").write_bytes(T.png(photo(31, 30, 9)))  # a format by another name is still an image
    (source / "broken.png").write_bytes(b"no picture")
    out = source / "Professionally Enhanced"
    for _ in range(2):
        rows = enhance.enhance_folder(spark, f"file://{source}", f"file://{out}", "4K long edge").collect()
        by = {r.path.rpartition("/in/")[2].replace("%20", " "): r for r in rows}
        assert set(by) == {"p0.png", "p0.jpg", "deep er/p0.png", "p2.PNG", "broken.png"}
        bad = by.pop("broken.png")
        assert bad.error and bad.review_needed and bad.bytes is None and bad.name is None
        assert all(r.error is None and r.bytes > 0 for r in by.values())
        names = {k: r.name for k, r in by.items()}
        assert names == {"p0.png": "p0-png_enhanced.png", "p0.jpg": "p0-jpg_enhanced.png", "deep er/p0.png": "deep er/p0_enhanced.png", "p2.PNG": "p2_enhanced.png"}
        assert sorted(str(f.relative_to(out)) for f in out.rglob("*.png")) == sorted(names.values())
    assert enhance.enhance_folder(spark, f"file://{source}", f"file://{tmp_path}/other", exif=False).count() == 5


def test_flat_candidates_are_refused():
    sharp, flat = photo(60, 60, 3), np.full((60, 60, 3), 120, np.uint8)
    assert T.strict_likeness(sharp, flat) == 0.0 == T.strict_likeness(flat, sharp) and T.likeness(sharp, flat) == 1.0
    assert T.strict_likeness(flat, flat) == 1.0 and abs(T.strict_likeness(flat, flat - 51) - 0.8) < 0.01
    assert T.strict_likeness(sharp[:0], sharp) == 1.0 and T.likeness(sharp[:30], sharp) == 0.0
    assert T.face_likeness(sharp, sharp, [(10, 10, 20, 20)]) > 0.999 and T.face_likeness(flat, sharp, [(10, 10, 20, 20)]) == 0.0 and T.face_likeness(flat, sharp) == 1.0
    assert T.upscale(np.zeros((3, 5, 3), np.uint8), 1.3).shape == (3, 6, 3)


def test_small_photos_are_dealt_to_all_cores(spark, sf_dir):
    from rasterflow import queries

    done = queries.enhanced_photos(spark, sf_dir)
    assert done.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # few bytes, much work: one merged partition would be one task


def test_local_contrast_equals_tile_by_tile():
    plane = np.random.default_rng(5).integers(0, 256, (37, 53)).astype(np.uint8)
    ys, xs = np.linspace(0, 37, 9).astype(int), np.linspace(0, 53, 9).astype(int)
    curves = np.zeros((8, 8, 256), np.float32)
    for i in range(8):
        for j in range(8):
            part = plane[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            hist = np.bincount(part.reshape(-1), minlength=256).astype(np.float32)
            top = max(1.7 * part.size / 256, 1)
            curves[i, j] = np.cumsum(np.minimum(hist, top) + np.maximum(hist - top, 0).sum() / 256) * 255 / part.size
    got = T.local_contrast(plane, 1.7)
    assert got[0, 0] == T._bytes(np.rint(curves[0, 0, plane[0, 0]])) and got[-1, -1] == T._bytes(np.rint(curves[-1, -1, plane[-1, -1]]))


def test_padded_equals_numpys():
    x = np.arange(5 * 7 * 3).reshape(5, 7, 3)
    for width, mode in ((1, "reflect"), (4, "reflect"), (3, "edge")):
        assert np.array_equal(T.padded(x, width, mode), np.pad(x, ((width, width), (width, width), (0, 0)), mode))
    assert np.array_equal(T.padded(x[..., 0], 1, 9), np.pad(x[..., 0], 1, constant_values=9))
