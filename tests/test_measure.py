import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.functions import pixels as P
from rasterflow.operators import candidates, faces, measure, rules, tiles


def frame(spark, rasters, **more):
    return spark.createDataFrame([(k, r.reshape(-1).tolist(), *[v[k] for v in more.values()]) for k, r in enumerate(rasters)], ", ".join(["photo_id long", "px array<int>", *[f"{n} array<int>" for n in more]]))


@pytest.fixture(scope="module")
def rasters():
    rng = np.random.default_rng(4)
    return [rng.integers(0, 256, (24, 24)), np.full((24, 24), 90), np.tile(np.arange(24) * 10, (24, 1)), np.kron(rng.integers(0, 256, (3, 3)), np.ones((8, 8), int))]


def stencil(img):
    p = np.pad(img, 1, "reflect").astype(int)
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * img
    k = np.array([1, 2, 1])
    smooth = sum(k[a] * k[b] * p[a : a + img.shape[0], b : b + img.shape[1]] for a in range(3) for b in range(3))
    return lap, (smooth + 8) // 16


def test_metrics_against_numpy(spark, rasters):
    df = measure.dynamic_range(measure.blockiness(measure.focus(measure.tone(frame(spark, rasters)), 24, 24), 24, 24))
    for r in df.orderBy("photo_id").collect():
        img = rasters[r.photo_id]
        lap, smooth = stencil(img)
        assert r.brightness == pytest.approx(img.mean()) and r.contrast == pytest.approx(img.std())
        assert r.dark_35 == (img < 35).mean() and r.clipped_250 == (img >= 250).mean()
        assert r.blur == pytest.approx(lap.var()) and r.noise == pytest.approx((img - smooth).std())
        assert r.dynamic_range == pytest.approx(np.percentile(img, 95) - np.percentile(img, 5))
        v, h = np.abs(np.diff(img, axis=1)), np.abs(np.diff(img, axis=0))
        vb, hb = v[:, 7::8].mean(), h[7::8].mean()
        assert r.compression_axes == pytest.approx(np.clip(((vb / (v.mean() + 1e-6) + hb / (h.mean() + 1e-6)) / 2 - 0.88) * 120, 0, 100))
        assert r.compression_pooled == pytest.approx(np.clip(((vb + hb) / 2 / ((v.mean() + h.mean()) / 2 + 1e-6) - 0.9) * 115, 0, 100))


def test_small_rasters_have_no_blocks(spark):
    assert measure.blockiness(frame(spark, [np.zeros((8, 8), int)]), 8, 8).first().compression_axes == 0


def test_correlations_of_flat_patches(spark):
    flat, other, busy = [90] * 64, [120] * 64, list(range(64))
    rows = [(1, flat, other), (2, flat, busy), (3, busy, busy), (4, busy, busy[::-1]), (5, [], []), (6, busy, busy[:9])]
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>")
    got = {r.k: (r.s, r.l) for r in df.select("k", P.correlation_strict(F.col("a"), F.col("b")).alias("s"), P.correlation_lenient(F.col("a"), F.col("b")).alias("l")).where("k <> 6").collect()}
    assert got[1] == (pytest.approx(1 - 30 / 255), 1.0) and got[2] == (0.0, 1.0)
    assert got[3] == (pytest.approx(1), pytest.approx(1)) and got[4] == (pytest.approx(-1), pytest.approx(-1)) and got[5] == (1.0, 0.0)
    assert df.where("k = 6").select(P.correlation_lenient(F.col("a"), F.col("b")).alias("l")).first().l == 0


def inspection(spark, **over):
    base = {"is_screenshot": False, "is_monochrome": False, "is_low_resolution": False, "face_count": 0, "smallest_face": 0.0, "blur": 300.0, "noise": 4.0, "compression": 0.0, "dark": 0.0, "highlight": 0.0, "contrast": 50.0, "quality_score": 55}
    return spark.createDataFrame([tuple((base | over).values())], list(base))


@pytest.mark.parametrize(("over", "want"), [
    ({"is_screenshot": True, "is_low_resolution": True, "compression": 45.0, "blur": 90.0, "noise": 12.0}, ["jpeg_repair", "denoise", "deblur", "colour", "super_resolution"]),
    ({"is_monochrome": True, "blur": 100.0, "noise": 10.0}, ["denoise", "deblur"]),
    ({"is_monochrome": True, "quality_score": 88, "blur": 400.0, "noise": 3.0}, []),
    ({"face_count": 2, "smallest_face": 0.01}, ["face_recovery", "face_protect", "colour"]),
])
def test_requested_capabilities(spark, over, want):
    assert inspection(spark, **over).select(rules.requested_capabilities(F.col).alias("c")).first().c == want


def test_planned_and_executed_thresholds_differ(spark):
    df = inspection(spark, compression=10.0, blur=170.0)
    assert df.select(rules.plan_stages(F.col).alias("s")).first().s == ["professional colour and lighting", "quality validation with retry"]
    from rasterflow.plans.enhance import strategy_steps

    r = df.first()
    steps = strategy_steps(1, r.is_screenshot, r.compression, r.is_monochrome, r.noise, r.blur, r.dark, r.highlight)
    assert [name for name, _ in steps] == ["repair_compression", "detail", "recover_lighting", "finish"]


def test_plan_routing(spark):
    name = lambda mode, **over: inspection(spark, **over).select(rules.plan_name(F.col, F.lit(mode)).alias("n")).first().n
    assert name("Auto Detect", quality_score=80) == "Professional Light Polish"
    assert name("", face_count=1) == "Identity-Safe Portrait Recovery"
    assert name("Auto Portrait", is_screenshot=True) == "Auto Portrait"


def test_first_of_equal_scores_wins(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 0, 5.0), (1, 1, 4.0), (2, 1, 0.0)], "photo_id int, ordinal int, after double")
    assert sorted(tuple(r) for r in candidates.best(df, "photo_id", "after", "ordinal").collect()) == [(1, 0, 5.0), (2, 1, 0.0)]


def test_changed_geometry_passes_and_best_rejected_is_kept(spark):
    busy = [k % 37 * 7 for k in range(64)]
    rows = [(1, 0, busy, busy[:32]), (2, 0, busy, [90] * 64), (2, 1, busy, busy[::-1])]
    df = spark.createDataFrame(rows, "ref int, k int, px array<int>, out_px array<int>").withColumns({"identity": F.lit(1.0), "target": F.lit("Nobody")})
    found = {(r.ref, r.k): r for r in candidates.validate(df).collect()}
    assert found[1, 0].accepted and found[1, 0].reasons == ["geometry"] and found[2, 0].reasons == ["structure"] and found[2, 0].target == "Professional"
    ranked = {r.ref: r for r in candidates.rank(candidates.validate(df), "ref", "k").collect()}
    assert ranked[2].accepted_candidates == 0 and ranked[2].attempted == 2 and ranked[1].chosen == 0


def test_padded_faces_stay_inside(spark):
    box = spark.range(1).select(faces.padded("flare", F.lit(1), F.lit(0), F.lit(4), F.lit(4), F.lit(8), F.lit(8)).alias("b")).first().b
    assert tuple(box) == (0, 0, 7, 6)


def test_tile_weights_and_overlap_add(spark):
    px = list(range(64))
    photo = spark.createDataFrame([(1, 8, 8, px)], "photo_id int, height int, width int, px array<int>")
    cells = tiles.grid(photo, 4, 3).withColumn("k", F.explode(F.sequence(F.lit(0), F.expr("(y1 - y) * (x1 - x) - 1"))))
    py, qx = F.expr("cast(k / (x1 - x) as int)"), F.expr("k % (x1 - x)")
    rows = cells.select("photo_id", (F.col("y") + py).alias("yy"), (F.col("x") + qx).alias("xx"), tiles.weight(py, qx, F.expr("y1 - y"), F.expr("x1 - x"), 1).alias("weight"), "px").selectExpr("photo_id", "yy as y", "xx as x", "weight", "px[yy * 8 + xx] as value")
    out = tiles.overlap_add(rows).orderBy("y", "x").collect()
    assert [r.value for r in out] == px
    assert tiles.step_of(256, 32) == (32, 224) and tiles.step_of(64, 60) == (21, 43)


def test_number_ranges_round_trip(spark):
    df = spark.createDataFrame([([0, 127, 255, 32, 64, 128],)], "px array<int>")
    for kind in ("zero_one", "minus_one_one", "zero_255"):
        back = df.select(tiles.decode(tiles.encode(F.col("px"), F.lit(kind)), F.lit(kind)).alias("b")).first().b
        assert max(abs(a - b) for a, b in zip(back, [0, 127, 255, 32, 64, 128], strict=True)) <= 1
    odd = spark.createDataFrame([([float("nan"), float("inf"), float("-inf")],)], "v array<double>")
    assert odd.select(tiles.decode(F.col("v"), F.lit("zero_255")).alias("b")).first().b == [0, 255, 0]
