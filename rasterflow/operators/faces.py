"""Face regions as a child table: padded crops, profiles, aggregates. Detection itself is an input (no detector is built in)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.functions import pixels as P
from rasterflow.operators import rules

#: Padding as shares of width and height (or of the longer side where one number is given), by user.
PADDING = {"safety": (0.12, None), "identity": (0.14, None), "relight": (0.22, 0.28), "capability": (0.28, 0.35), "flare": (0.55, 0.70)}
#: Scale factor, divisor of the shorter side for the smallest face, and its lower bound, by user.
DETECTORS = {"analyser": (1.12, 16, 36), "engine": (1.10, 22, 28), "safety": (1.10, 24, 28), "identity": (1.10, 18, 36), "capability": (1.08, 24, 28)}


def smallest_side(user: str, height: Column, width: Column) -> Column:
    """The least side of a face that a user's detector looks for."""
    _, divisor, least = DETECTORS[user]
    return F.greatest(F.lit(least), F.floor(F.least(height, width) / divisor).cast("int"))


def padded(user: str, x: Column, y: Column, w: Column, h: Column, height: Column, width: Column) -> Column:
    """The box with its user's padding, clamped to the raster, as (x0, y0, x1, y1)."""
    across, down = PADDING[user]
    if down is None:
        pad_x = pad_y = F.floor(F.greatest(w, h) * across).cast("int")
    else:
        pad_x, pad_y = F.floor(w * across).cast("int"), F.floor(h * down).cast("int")
    zero = F.lit(0)
    return F.struct(F.greatest(zero, x - pad_x).alias("x0"), F.greatest(zero, y - pad_y).alias("y0"), F.least(width, x + w + pad_x).alias("x1"), F.least(height, y + h + pad_y).alias("y1"))


def crop(px: Column, box: Column, width: int) -> Column:
    """The pixels of a box (x0, y0, x1, y1), row by row."""
    rows = F.when(box["y1"] > box["y0"], F.sequence(box["y0"], box["y1"] - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(rows, lambda r: F.slice(px, r * width + box["x0"] + 1, F.greatest(box["x1"] - box["x0"], F.lit(0)))))


def profiles(faces: DataFrame, height: int, width: int) -> DataFrame:
    """Area ratio, brightness, contrast, sharpness and protection of each face row (photo_id, x, y, w, h, px)."""
    box = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    faces = faces.withColumn("roi", crop(F.col("px"), box, width)).withColumn("area_ratio", F.col("w") * F.col("h") / F.lit(float(height * width)))
    faces = faces.withColumns({"brightness": P.mean(F.col("roi")), "contrast": P.deviation(F.col("roi")), "sharpness": roi_sharpness(F.col("roi"), F.col("h"), F.col("w"))})
    return faces.withColumn("protection", rules.protection(F.col("area_ratio"), F.col("sharpness"))).select("*", "protection.level", "protection.most_change").drop("protection", "roi")


def roi_sharpness(px: Column, height: Column, width: Column) -> Column:
    """Variance of second differences of a crop whose size is a column."""

    def mirror(k, n):
        return F.when(n == 1, F.lit(0)).when(k < 0, -k).when(k > n - 1, 2 * (n - 1) - k).otherwise(k)

    def at(i, dy, dx):
        return F.get(px, mirror((i / width).cast("int") + dy, height) * width + mirror(i % width + dx, width))

    differences = F.transform(F.sequence(F.lit(0), height * width - 1), lambda i: at(i, -1, 0) + at(i, 1, 0) + at(i, 0, -1) + at(i, 0, 1) - 4 * F.get(px, i))
    return P.variance(differences)


def per_photo(profiled: DataFrame) -> DataFrame:
    """Count, smallest ratio and whether any face needs the most protection; photos without faces are joined with defaults by the caller."""
    return profiled.groupBy("photo_id").agg(F.count("*").alias("face_count"), F.min("area_ratio").alias("smallest_face"), F.bool_or(F.col("level") == "Maximum").alias("any_maximum"))


def similarities(faces: DataFrame, width: int, height: int, strict: bool = True) -> DataFrame:
    """Least similarity over each photo's padded faces between px and out_px, and their number."""
    measure = P.correlation_strict if strict else P.correlation_lenient
    box = padded("safety" if strict else "identity", F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(height), F.lit(width))
    rows = faces.withColumn("box", box).withColumn("similarity", measure(crop(F.col("px"), F.col("box"), width), crop(F.col("out_px"), F.col("box"), width)))
    return rows.groupBy("photo_id").agg(F.min("similarity").alias("identity"), F.count("*").alias("faces_protected"))
