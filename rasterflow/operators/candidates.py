"""Candidates per photo: expansion by strategy, scoring, stable arg-max, acceptance and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterflow.functions import pixels as P
from rasterflow.operators import measure, rules

#: Fixed values by strategy: ordinal, crop (top, bottom), detail amount, gray-world shift, saturation gain, blend, gamma, shadow amount, highlight amount.
STRATEGIES = [
    (0, "gentle", 0.05, 0.86, 0.22, 0.06, 1.035, 0.62, 0.95, 0.22, 8.0),
    (1, "balanced", 0.05, 0.86, 0.42, 0.10, 1.065, 0.78, 0.89, 0.42, 15.0),
    (2, "strong", 0.075, 0.82, 0.60, 0.14, 1.09, 0.88, 0.83, 0.58, 22.0),
]


def strategies(spark: SparkSession) -> DataFrame:
    """Three rows."""
    return spark.createDataFrame(STRATEGIES, "ordinal int, strategy string, crop_top double, crop_bottom double, detail double, shift double, saturation double, blend double, gamma double, shadow double, highlight_cut double")


def expand(photos: DataFrame, plan: str = "plan") -> DataFrame:
    """A row per photo and strategy to try: two for the light polish, three otherwise."""
    tried = F.when(F.col(plan) == "Professional Light Polish", F.col("ordinal") < 2).otherwise(F.lit(True))
    return photos.join(F.broadcast(strategies(photos.sparkSession)), tried)


def crop_rows(px: Column, height: int, width: int, top: Column, bottom: Column) -> Column:
    """The rows between two shares of the height; all of them if fewer than 64 % would stay."""
    a, b = F.floor(top * height).cast("int"), F.floor(bottom * height).cast("int")
    return F.when(b - a >= height * 0.64, F.slice(px, a * width + 1, (b - a) * width)).otherwise(px)


def recover_detail(px: Column, amount: Column, height: int, width: int) -> Column:
    """Adds the difference from the smoothed raster, amount times; whole levels, clipped."""
    return F.zip_with(px, P.smooth(px, height, width), lambda x, s: P.clip(F.bround((1 + amount) * x - amount * s), 0.0, 255.0).cast("int"))


def lift_shadows(px: Column, gamma: Column, amount: Column) -> Column:
    """Blends each level with its gamma curve, the more the darker."""
    curve = lambda x: F.floor(F.pow(x / 255.0, gamma) * 255)
    weight = lambda x: (255 - x) / 255.0 * amount
    return F.transform(px, lambda x: P.clip(F.floor(x * (1 - weight(x)) + curve(x) * weight(x)).cast("double"), 0.0, 255.0).cast("int"))


def compress_highlights(px: Column, amount: Column) -> Column:
    """Lowers levels above 188, by amount at most."""
    return F.transform(px, lambda x: P.clip(F.floor(x - P.clip((x - 188) / 67.0, 0.0, 1.0) * amount).cast("double"), 0.0, 255.0).cast("int"))


def repairs(df: DataFrame, height: int = 8, width: int = 8) -> DataFrame:
    """The luma part of a strategy: detail below blur 180, shadows above 8 % dark, highlights above 3 % light."""
    detail = F.when(F.col("blur") < 180, recover_detail(F.col("px"), F.col("detail"), height, width)).otherwise(F.col("px"))
    df = df.withColumn("work", detail)
    df = df.withColumn("work", F.when(F.col("dark_35") > 0.08, lift_shadows(F.col("work"), F.col("gamma"), F.col("shadow"))).otherwise(F.col("work")))
    return df.withColumn("work", F.when(F.col("light_248") > 0.03, compress_highlights(F.col("work"), F.col("highlight_cut"))).otherwise(F.col("work")))


def quality_of(px: Column, height: int, width: int) -> Column:
    return rules.engine_quality(P.sharpness(px, height, width), P.deviation(px), P.noise(px, height, width), P.share(px, lambda x: x <= 8), P.share(px, lambda x: x >= 250))


def best(rows: DataFrame, key: str, score: str, ordinal: str) -> DataFrame:
    """The row of each key with the largest score; the first ordinal wins ties."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(ordinal))
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def accept(df: DataFrame) -> DataFrame:
    """Keeps a candidate unless it scores worse than the original by more than the tolerance; else the original."""
    tolerance = F.when(F.col("is_screenshot"), 4.0).otherwise(1.5)
    df = df.withColumn("accepted", F.col("after") + tolerance >= F.col("before"))
    return df.withColumn("after", F.when(F.col("accepted"), F.col("after")).otherwise(F.col("before"))).withColumn("improvement", F.col("after") - F.col("before"))


def validate(pairs: DataFrame, height: int = 8, width: int = 8) -> DataFrame:
    """Safety check of candidate rasters (out_px) against references (px); identity and target are columns."""
    same = F.size("px") == F.size("out_px")
    pairs = pairs.withColumns({
        "same_geometry": same,
        "structure": F.when(same, P.correlation_strict(F.col("px"), F.col("out_px"))).otherwise(1.0),
        "clip_delta": F.when(same, F.greatest(F.lit(0.0), measure.clipping(F.col("out_px")) - measure.clipping(F.col("px")))).otherwise(0.0),
        "sharp_ratio": F.when(same, P.sharpness(F.col("out_px"), height, width) / (P.sharpness(F.col("px"), height, width) + 1e-6)).otherwise(1.0),
    })
    pairs = rules.with_limits(pairs)
    pairs = pairs.withColumn("reasons", rules.validation_reasons(F.col("identity"), F.col("structure"), F.col("clip_delta"), F.col("sharp_ratio"), F.col("same_geometry")))
    return pairs.withColumn("accepted", F.when(F.col("same_geometry"), F.size("reasons") == 0).otherwise(F.lit(True)))


def rank(validated: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Per reference: how many candidates were tried and accepted, and the best accepted one, or else the best rejected one."""
    scored = validated.withColumn("score", rules.candidate_score(F.col("identity"), F.col("structure"), F.col("clip_delta"), F.col("sharp_ratio")))
    counts = scored.groupBy(key).agg(F.count("*").alias("attempted"), F.count_if("accepted").alias("accepted_candidates"))
    order = Window.partitionBy(key).orderBy(F.col("accepted").desc(), F.col("score").desc(), F.col(ordinal))
    first = scored.withColumn("_place", F.row_number().over(order)).where("_place = 1").select(key, F.col(ordinal).alias("chosen"), "accepted", "score")
    return counts.join(first, key)
