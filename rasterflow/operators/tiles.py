"""Tiling: spatial hopping windows, edge-ramped weights and weighted overlap-add, with pixels as rows where rasters are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step_of(tile: int, overlap: int) -> tuple[int, int]:
    """(overlap, step) that a tile size and a wished overlap come to: a third of the tile at most, a step of 32 at least."""
    overlap = min(max(0, overlap), tile // 3)
    return overlap, max(32, tile - overlap)


def grid(photos: DataFrame, tile: int, step: int) -> DataFrame:
    """A row per tile (y, x, y1, x1) of photos with height and width."""
    rows = photos.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(step)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(step))))
    return rows.withColumns({"y1": F.least(F.col("y") + tile, F.col("height")), "x1": F.least(F.col("x") + tile, F.col("width"))})


def ramp(place: Column, size: Column, overlap: int) -> Column:
    """Weight along one axis: rises from 0.08 to 1 over the overlap at both ends (the far end wins where they meet)."""
    if overlap <= 0:
        return F.lit(1.0)
    edge = F.least(F.lit(overlap), F.greatest(F.lit(1), F.floor(size / 2).cast("int")))
    rise = lambda k: F.when(edge == 1, F.lit(0.08)).otherwise(0.08 + 0.92 * k / F.greatest(edge - 1, F.lit(1)))
    return F.when(place >= size - edge, rise(size - 1 - place)).when(place < edge, rise(place)).otherwise(1.0)


def weight(y: Column, x: Column, height: Column, width: Column, overlap: int) -> Column:
    return ramp(y, height, overlap) * ramp(x, width, overlap)


def overlap_add(patches: DataFrame, key: str = "photo_id") -> DataFrame:
    """Weighted mean per output pixel of rows (key, y, x, value, weight), clipped to 0 .. 255 and cut to whole levels (at six digits, so the order of summation doesn't show)."""
    sums = patches.groupBy(key, "y", "x").agg(F.sum(F.col("value") * F.col("weight")).alias("v"), F.sum("weight").alias("w"))
    return sums.select(key, "y", "x", F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("v") / F.greatest(F.col("w"), F.lit(1e-4)))), 6)).cast("int").alias("value"))


def encode(px: Column, input_range: Column) -> Column:
    """Levels in a model's number range."""
    return F.transform(px, lambda x: F.when(input_range == "minus_one_one", x / 127.5 - 1.0).when(input_range == "zero_255", x.cast("double")).otherwise(x / 255.0))


def decode(values: Column, output_range: Column) -> Column:
    """A model's numbers as levels: scaled, not-a-numbers to 0 and infinities to the ends, clipped, cut."""
    scaled = lambda v: F.when(output_range == "minus_one_one", (v + 1.0) * 127.5).when(output_range == "zero_255", v).otherwise(v * 255.0)
    return F.transform(values, lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.nanvl(scaled(v), F.lit(0.0))))).cast("int"))


def tensor(b: Column, g: Column, r: Column, layout: Column, order: Column) -> Column:
    """Planes as one flat array: plane by plane (nchw) or pixel by pixel (any other), the first plane blue (bgr) or red (any other)."""
    first, last = F.when(order == "bgr", b).otherwise(r), F.when(order == "bgr", r).otherwise(b)
    by_pixel = F.flatten(F.transform(F.arrays_zip(first.alias("x"), g.alias("y"), last.alias("z")), lambda p: F.array(p["x"], p["y"], p["z"])))
    return F.when(layout == "nchw", F.flatten(F.array(first, g, last))).otherwise(by_pixel)


def planes(flat: Column, layout: Column, order: Column) -> Column:
    """The planes b, g and r of such an array, whatever it is made of."""
    n = (F.size(flat) / 3).cast("int")
    plane = lambda k: F.when(layout == "nchw", F.slice(flat, k * n + 1, n)).otherwise(F.filter(flat, lambda _, i: i % 3 == k))
    return F.struct(F.when(order == "bgr", plane(0)).otherwise(plane(2)).alias("b"), plane(1).alias("g"), F.when(order == "bgr", plane(2)).otherwise(plane(0)).alias("r"))
