"""Rasters: image files through Spark's own readers, and stand-ins made of the embeddings table.

A photo row has photo_id, height, width and planes: ``px`` (luma) and, for colour, ``b``, ``g`` and ``r``, each
an array of integers row by row. Files keep their bytes as binary instead (see ``operators.transforms``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.functions import pixels
from rasterflow.functions.sharing import spread

#: Suffixes of photographs.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
OUTPUT_FOLDER = "Professionally Enhanced"
#: (gain, offset) by vec_id modulo 6: normal, dark, bright, flat, very dark and harsh scenes.
SHAPES = ((1.0, 0.0), (0.35, -15.0), (1.6, 40.0), (0.06, 110.0), (0.03, 10.0), (3.0, -250.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def supported(path: Column) -> Column:
    """Whether a path ends in a photograph's suffix, in any case."""
    return suffix(path).isin(*SUFFIXES)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def output_path(path: Column, root: Column | None = None) -> Column:
    """Where the enhanced copy goes: below root's output folder, or in one beside the source."""
    name = F.concat(stem(path), F.lit("_enhanced.jpg"))
    if root is None:
        return F.concat(parent(path), F.lit(f"/{OUTPUT_FOLDER}/"), name)
    below = F.substring(parent(path), F.length(root) + 1, F.length(path))
    return F.concat(root, F.lit(f"/{OUTPUT_FOLDER}"), below, F.lit("/"), name)


def is_source(path: Column) -> Column:
    """Whether a path is a photograph outside of output folders."""
    return supported(path) & ~path.contains(f"/{OUTPUT_FOLDER.replace(' ', '%20')}/") & ~path.contains(f"/{OUTPUT_FOLDER}/")


def scan_photos(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length and content of the photographs below a folder, without its output folder, in path order.

    ``content`` is read only by queries that use it.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(is_source(F.col("path"))).orderBy("path")


def select_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The photographs among explicit files, each once, in path order."""
    return spark.read.format("binaryFile").load(sorted(set(paths))).where(supported(F.col("path"))).dropDuplicates(["path"]).orderBy("path")


def decoded(spark: SparkSession, folder: str, keep_broken: bool = False) -> DataFrame:
    """path, height, width, n_channels, data (rows of blue, green, red bytes) by the built-in image source.

    It reads PNG, JPEG, BMP, GIF and TIFF, not WebP, and applies no EXIF orientation (see ``transforms.orient``).
    """
    found = spark.read.format("image").option("dropInvalid", str(not keep_broken).lower()).option("recursiveFileLookup", "true").load(folder)
    return found.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").toDF("path", "height", "width", "n_channels", "data")


def _levels(embedding: Column, gain: Column, offset: Column) -> Column:
    base = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((v.cast("double") + 0.5) * 255.0).cast("double")))
    return F.transform(embedding, lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(base(v) * gain + offset).cast("double"))).cast("int"))


def _shape(key: Column, which: int) -> Column:
    out = F.lit(SHAPES[0][which])
    for k, s in enumerate(SHAPES[1:], 1):
        out = F.when(key % 6 == k, F.lit(s[which])).otherwise(out)
    return out


def small_rasters(spark: SparkSession, sf_dir: str, shaped: bool = True) -> DataFrame:
    """photo_id, label, px: an 8 x 8 raster for each vector of embeddings; shaped into different scenes by photo_id."""
    e = table(spark, sf_dir, "embeddings")
    key = F.col("vec_id") if shaped else F.lit(0)
    return e.select(F.col("vec_id").alias("photo_id"), "label", _levels(F.col("embedding"), _shape(key, 0), _shape(key, 1)).alias("px"))


def colour_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, b, g, r, px: an 8 x 8 colour raster of each three consecutive vectors (every third one faded)."""
    e = small_rasters(spark, sf_dir, shaped=False)
    three = e.groupBy(F.floor(F.col("photo_id") / 3).alias("photo_id")).agg(*[F.max(F.when(F.col("photo_id") % 3 == k, F.col("px"))).alias(c) for k, c in enumerate("bgr")])
    # channels that the last photo lacks are those it has
    whole = three.select("photo_id", F.coalesce("b", "g", "r").alias("b"), F.coalesce("g", "b", "r").alias("g"), F.coalesce("r", "g", "b").alias("r"))
    # every third photo is faded: its channels are pulled to the green one
    pull = lambda c: F.when(F.col("photo_id") % 3 == 0, F.zip_with(F.col(c), F.col("g"), lambda x, y: F.floor((x + 15 * y) / 16).cast("int"))).otherwise(F.col(c))
    out = whole.select("photo_id", pull("b").alias("b"), F.col("g"), pull("r").alias("r"))
    return out.withColumn("px", pixels.luma(F.col("b"), F.col("g"), F.col("r")))


def tiled_rasters(spark: SparkSession, sf_dir: str, side: int = 3) -> DataFrame:
    """photo_id, px: side x side vectors laid out as tiles of one raster of 8 * side pixels a side; the last one repeats its tiles."""
    e, n = small_rasters(spark, sf_dir, shaped=False), side * side
    edge = 8 * side
    dealt = spread(e.select(F.floor(F.col("photo_id") / n).alias("photo_id"), F.struct((F.col("photo_id") % n).alias("k"), "px").alias("tile")), "photo_id")
    tiles = dealt.groupBy("photo_id").agg(F.sort_array(F.collect_list("tile")).alias("tiles"))

    def pixel(i):
        row, column = (i / edge).cast("int"), i % edge
        tile = F.get(F.col("tiles"), ((row / 8).cast("int") * side + (column / 8).cast("int")) % F.size("tiles"))
        return F.get(tile["px"], row % 8 * 8 + column % 8)

    return tiles.select("photo_id", F.transform(F.sequence(F.lit(0), F.lit(edge * edge - 1)), pixel).alias("px"))


def scene_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, height, width, px: tiled rasters as scenes of 24, 32 or 40 lines: a sky and a ground that a slanting line parts, and bright spots."""
    tiles, key = tiled_rasters(spark, sf_dir), F.col("photo_id")
    height, width = (24 + key % 3 * 8).cast("int"), 24
    side = (2 + key % 3).cast("int")

    def pixel(i):
        y, x = (i / width).cast("int"), i % width
        ground = 16 * y > 8 * F.col("height") + x * (key % 7 - 3)
        level = F.floor(F.get("px", y % 24 * 24 + x) / 8).cast("int") + F.when(ground, 150).otherwise(40)
        left, top = key * 5 % 20, key * 3 % 18
        spot = (x >= left) & (x < left + side) & (y >= top) & (y < top + side)
        return F.when(spot | ((x == key * 11 % 24) & (y == F.col("height") - 2)), 255).otherwise(level)

    sized = tiles.select("photo_id", height.alias("height"), F.lit(width).alias("width"), "px")
    return sized.withColumn("px", F.transform(F.sequence(F.lit(0), F.col("height") * width - 1), pixel))
