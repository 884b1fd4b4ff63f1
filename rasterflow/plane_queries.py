"""Registered queries of the operators on scan lines, regions and resampled rasters, over stand-ins made of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.functions import pixels as P
from rasterflow.functions import resample
from rasterflow.functions.sharing import checkpoint
from rasterflow.operators import dedupe, faces, measure, regions, rules, tiles
from rasterflow.operators import scanlines as L
from rasterflow.sources import rasters

R = lambda c, n=6: F.round(c, n).alias(c)
#: What lines take on rasters of 24 columns: votes, least length and gap (photographs: 90, a fifth of the width, 20).
VOTES, LEAST, GAP = 9, 8, 3


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint(L.lines(rasters.scene_rasters(spark, sf_dir)))


def edge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the edge pixels of every line."""
    found = L.edge_pixels(_lines(spark, sf_dir), *L.EDGES["screen"])
    return found.groupBy("photo_id", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.cast("string")), ",").alias("xs"))


def _screens(rows: DataFrame) -> DataFrame:
    found = L.bands(rows, L.edge_pixels(rows, *L.EDGES["screen"]))
    return found.withColumns({c: F.round(c, 6) for c in ("text_edge", "social")}).withColumn("is_screenshot", rules.is_screenshot(F.col("height"), F.col("width"), F.col("text_edge"), F.col("social")))


def screen_ui(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen scores from edge maps, and whether a photo is a screenshot."""
    return _screens(_lines(spark, sf_dir)).select("photo_id", "text_edge", "social", "is_screenshot")


def _segments(rows: DataFrame) -> DataFrame:
    return L.segments(L.edge_pixels(rows, *L.EDGES["horizon"]), VOTES, LEAST, GAP)


def horizon_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight stretches of edges near level."""
    return _segments(_lines(spark, sf_dir)).select("photo_id", R("angle"), "x1", "y1", "x2", "y2")


def horizon_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each photo's horizon, and whether it is straightened: screenshots aren't."""
    rows = _lines(spark, sf_dir)
    found = _screens(rows).join(L.horizon(rows.select("photo_id").distinct(), _segments(rows)), "photo_id").withColumn("angle", F.round("angle", 6))
    return found.select("photo_id", "angle", rules.straightens(F.col("angle"), F.lit(False), ~F.col("is_screenshot")).alias("straightens"))


def scene_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems, type and stages of scenes, whose screen flag comes from their edges, not from their ids."""
    photos = checkpoint(rasters.scene_rasters(spark, sf_dir))
    h, w, px = F.col("height"), F.col("width"), F.col("px")
    measured = measure.tone(photos).withColumns({"blur": P.sharpness(px, h, w), "noise": P.noise(px, h, w), "compression_axes": P.blockiness_axes(px, h, w)}).drop("px", "height", "width")
    seen = checkpoint(_screens(L.lines(photos)).join(measured, "photo_id")).withColumns({
        "is_low_resolution": rules.is_low_resolution(h, w), "is_monochrome": F.lit(False), "face_count": F.lit(0), "smallest_face": F.lit(0.0),
        "quality_score": F.bround(rules.engine_quality(F.col("blur"), F.col("contrast"), F.col("noise"), F.col("dark_8"), F.col("clipped_250"))).cast("int"),
    })
    i = lambda name: F.col({"compression": "compression_axes", "dark": "dark_35", "highlight": "light_248"}.get(name, name))
    return seen.select("photo_id", "is_screenshot", F.concat_ws("; ", rules.problems(i)).alias("problems"), rules.image_type(i).alias("image_type"), F.concat_ws("; ", rules.plan_stages(i)).alias("stages"))


def spot_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright regions of 2 pixels to 1 % of the photo: single pixels and large areas aren't spots."""
    rows = _lines(spark, sf_dir)
    bright = L.marked(rows.withColumn("bright", F.transform("line", lambda v: (v > 232).cast("int"))), "bright")
    sizes = rows.select("photo_id", (F.col("height") * F.col("width") / 100).alias("most")).distinct()
    found = regions.bounded(bright.join(sizes, "photo_id"), 2, F.col("most"))
    return found.select("photo_id", "area", "top", "left", "bottom", "right")


def flare_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright regions that are left when what no square of three pixels fits into is taken off."""
    rows = _lines(spark, sf_dir).withColumn("bright", F.transform("line", lambda v: (v > 232).cast("int")))
    found = regions.bounded(L.marked(L.opening(rows, "bright", 3), "bright"), 9, 1000)
    return found.select("photo_id", "area", "top", "left", "bottom", "right")


def dust_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of dust by photo, and whether it is mended."""
    found = L.dust(_lines(spark, sf_dir))
    return found.select("photo_id", R("share"), ((F.col("share") > 0) & (F.col("share") < 0.012)).alias("mended"))


def preview_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blur and noise of previews whose longer side is 20."""
    h, w = F.col("height"), F.col("width")
    side = lambda n: resample.preview_side(n, h, w, 20)
    small = rasters.scene_rasters(spark, sf_dir).select("photo_id", side(h).alias("rows"), side(w).alias("columns"), resample.area(F.col("px"), h, w, side(h), side(w)).alias("small"))
    small = checkpoint(small)
    px, m, n = F.col("small"), F.col("rows"), F.col("columns")
    return small.select("photo_id", "rows", "columns", P.total(px).alias("level_sum"), F.round(P.sharpness(px, m, n), 4).alias("blur"), F.round(P.noise(px, m, n), 6).alias("noise"))


def patch_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face crops of several sizes before and after, compared at one size; every tenth photo's second crop has another shape."""
    key = F.col("photo_id")
    tiles = rasters.tiled_rasters(spark, sf_dir)
    follower = tiles.select((key - 1).alias("photo_id"), F.col("px").alias("next"))
    both = tiles.join(follower, "photo_id", "left").withColumn("next", F.coalesce("next", "px"))
    mixed = both.withColumn("after", F.zip_with("px", "next", lambda a, b: F.floor((3 * a + b) / 4).cast("int")))
    x, y, w, h = key % 5, key % 3, 6 + key % 9, 7 + key % 7
    less = F.when(key % 10 == 0, 1).otherwise(0)
    box = lambda cut: F.struct(x.cast("int").alias("x0"), y.cast("int").alias("y0"), (x + w).cast("int").alias("x1"), (y + h - cut).cast("int").alias("y1"))
    crops = mixed.select("photo_id", w.cast("int").alias("w"), h.cast("int").alias("h"), (h - less).cast("int").alias("other_h"), faces.crop(F.col("px"), box(F.lit(0)), 24).alias("one"), faces.crop(F.col("after"), box(less), 24).alias("other"))
    sized = checkpoint(crops.select("photo_id", (F.col("h") == F.col("other_h")).alias("same"), resample.patch(F.col("one"), F.col("h"), F.col("w")).alias("one"), resample.patch(F.col("other"), F.col("other_h"), F.col("w")).alias("other")))
    lenient = F.when(F.col("same"), P.correlation_lenient(F.col("one"), F.col("other"))).otherwise(0.0)
    return sized.select("photo_id", F.size("one").cast("long").alias("pixels"), F.round(P.correlation_strict(F.col("one"), F.col("other")), 6).alias("strict"), F.round(lenient, 6).alias("lenient"))


def perceptual_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine-transform signatures of rasters of 24 x 24, brought to 16 x 16."""
    return rasters.tiled_rasters(spark, sf_dir).select("photo_id", dedupe.signature_hex(dedupe.perceptual_hash(F.col("px"), 24, 24)).alias("phash"))


#: Tiles of scenes (photographs: 256 and 16 or more), and how much larger the stand-in for a model makes them.
TILE, OVERLAP, SCALE = 12, 4, 2


def tiled_upscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes doubled tile by tile, each tile's levels raised by its place, and added up: by edge-ramped weights and by plain averages."""
    cells = tiles.grid(rasters.scene_rasters(spark, sf_dir), TILE, TILE - OVERLAP).withColumns({"tall": (F.col("y1") - F.col("y")) * SCALE, "wide": (F.col("x1") - F.col("x")) * SCALE})
    cells = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tall") * F.col("wide") - 1))).withColumns({"dy": F.floor(F.col("k") / F.col("wide")).cast("int"), "dx": F.col("k") % F.col("wide")})
    made = F.get("px", (F.col("y") + F.floor(F.col("dy") / SCALE)).cast("int") * F.col("width") + (F.col("x") + F.floor(F.col("dx") / SCALE)).cast("int")) + (F.col("y") + F.col("x")) % 16
    ramped = tiles.weight(F.col("dy"), F.col("dx"), F.col("tall"), F.col("wide"), OVERLAP * SCALE)
    patches = cells.select("photo_id", (F.col("y") * SCALE + F.col("dy")).alias("y"), (F.col("x") * SCALE + F.col("dx")).alias("x"), made.alias("value"), ramped.alias("weight"))
    both = tiles.overlap_add(patches).withColumnRenamed("value", "ramped").join(tiles.overlap_add(patches.withColumn("weight", F.lit(1.0))).withColumnRenamed("value", "even"), ["photo_id", "y", "x"])
    return both.groupBy("photo_id").agg(
        F.count("*").alias("pixels"), *[F.sum(c).alias(f"{c}_sum") for c in ("ramped", "even")], F.sum(F.col("ramped") * (F.col("y") * 7 + F.col("x"))).alias("ramped_place_sum"), F.count_if(F.col("ramped") != F.col("even")).alias("differing")
    )


QUERIES = {f.__name__: f for f in (
    edge_map, screen_ui, horizon_segments, horizon_plan, scene_inspection, spot_regions, flare_regions, dust_share, preview_focus, patch_similarity, perceptual_hashes, tiled_upscale,
)}
