"""Measurements of rasters: one row in, the same row with metric columns out. Narrow; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.functions import pixels as P


def tone(df: DataFrame) -> DataFrame:
    """Brightness, contrast and the dark and highlight shares with each user's own threshold."""
    px = F.col("px")
    return df.withColumns({
        "brightness": P.mean(px),
        "contrast": P.deviation(px),
        "dark_35": P.share(px, lambda x: x < 35),
        "dark_8": P.share(px, lambda x: x <= 8),
        "light_250": P.share(px, lambda x: x > 250),
        "light_248": P.share(px, lambda x: x > 248),
        "clipped_250": P.share(px, lambda x: x >= 250),
    })


def focus(df: DataFrame, height: int, width: int) -> DataFrame:
    """Blur (variance of second differences) and noise (deviation from the smoothed raster)."""
    return df.withColumns({"blur": P.sharpness(F.col("px"), height, width), "noise": P.noise(F.col("px"), height, width)})


def blockiness(df: DataFrame, height: int, width: int) -> DataFrame:
    """Both block-edge scores; they differ in formula and both are in use."""
    return df.withColumns({"compression_axes": P.blockiness_axes(F.col("px"), height, width), "compression_pooled": P.blockiness_pooled(F.col("px"), height, width)})


def dynamic_range(df: DataFrame) -> DataFrame:
    return df.withColumn("dynamic_range", P.percentile(F.col("px"), 0.95) - P.percentile(F.col("px"), 0.05))


def colour(df: DataFrame) -> DataFrame:
    """Colour cast, saturation, its 90th percentile, monochrome flags and channel spread, from planes b, g, r."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    means = [P.mean(c) for c in (b, g, r)]
    df = df.withColumns({"colour_cast": F.greatest(*means) - F.least(*means), "sat": P.saturation(b, g, r), "channel_spread": P.mean(P.spread(b, g, r))})
    return df.withColumns({"saturation": P.mean(F.col("sat")), "saturation_p90": P.percentile(F.col("sat"), 0.9)}).withColumns({"is_monochrome": F.col("saturation_p90") < 18, "is_gray_scan": F.col("channel_spread") < 9}).drop("sat")


def clipping(px) -> F.Column:
    """Share of pixels at either end, as the safety check counts it."""
    return P.share(px, lambda x: (x <= 5) | (x >= 250))


def medians(df: DataFrame) -> DataFrame:
    """Median luma and dark share that gate the low-light repair, and the gate itself."""
    return df.withColumns({"median_luma": P.percentile(F.col("px"), 0.5), "share_55": P.share(F.col("px"), lambda x: x < 55)}).withColumn("night_applies", ~((F.col("median_luma") > 112) & (F.col("share_55") < 0.16)))


def gradients(df: DataFrame, height: int, width: int) -> DataFrame:
    """Mean absolute 3 x 3 gradients along both axes, and the blur widths that their ratio selects."""
    px = F.col("px")

    def side(i, across: bool):
        at = lambda dy, dx: P.neighbour(px, i, dy, dx, height, width)
        if across:
            return at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
        return at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)

    places = F.sequence(F.lit(0), F.lit(height * width - 1))
    x = P.mean(F.transform(places, lambda i: F.abs(side(i, True))))
    y = P.mean(F.transform(places, lambda i: F.abs(side(i, False))))
    df = df.withColumns({"gradient_x": x, "gradient_y": y})
    wide, tall = F.col("gradient_x") < F.col("gradient_y") * 0.78, F.col("gradient_y") < F.col("gradient_x") * 0.78
    return df.withColumns({"sigma_x": F.when(wide, 1.8).when(tall, 0.7).otherwise(1.15), "sigma_y": F.when(wide, 0.7).when(tall, 1.8).otherwise(1.15)})


def all_small(df: DataFrame, height: int = 8, width: int = 8) -> DataFrame:
    """Everything that the rules need from a gray raster."""
    return dynamic_range(blockiness(focus(tone(df), height, width), height, width))
