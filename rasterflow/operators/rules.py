"""Scores, labels and plans: closed-form rules over measurement columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.functions.pixels import clip

#: Limits by quality target.
TARGETS = [
    ("Standard", 0.80, 0.74, 0.035, 3.2),
    ("Professional", 0.84, 0.78, 0.028, 2.8),
    ("Studio", 0.88, 0.82, 0.022, 2.5),
    ("Archive", 0.91, 0.86, 0.018, 2.2),
    ("Museum", 0.94, 0.89, 0.014, 2.0),
]
#: Other names of modes.
MODE_ALIASES = {
    "Smart Auto": "Auto Detect",
    "Event / Christening": "Auto Celebrations",
    "Professional Portrait": "Auto Portrait",
    "Old Photo Restoration": "Auto Restore",
    "Night / Low Light": "Auto Low Light",
    "Celebrations": "Auto Celebrations",
    "Portrait": "Auto Portrait",
    "Landscape": "Auto Landscape",
    "Low Light": "Auto Low Light",
    "Screenshot Recovery": "Auto Screenshot Recovery",
}


def listed(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))


def analyser_score(blur, brightness, dark, clipped, contrast, noise) -> Column:
    """1 .. 100: 100 less penalties, rounded half to even before clipping."""
    penalties = (
        F.greatest(F.lit(0.0), 70 - F.least(F.lit(70.0), blur)) * 0.38
        + dark * 34
        + clipped * 45
        + F.greatest(F.lit(0.0), noise - 5) * 1.3
        + F.greatest(F.lit(0.0), 34 - contrast) * 0.45
        + F.when((brightness < 55) | (brightness > 215), 9.0).otherwise(0.0)
    )
    return clip(F.bround(100 - penalties), 1.0, 100.0).cast("int")


def engine_quality(sharpness, contrast, noise, dark, clipped) -> Column:
    """0 .. 100, not rounded."""
    return clip(35.0 + F.least(F.log1p(sharpness) * 8.2, F.lit(41.0)) + F.least(contrast / 55.0, F.lit(1.0)) * 23.0 - clipped * 95.0 - dark * 80.0 - F.greatest(noise - 8.0, F.lit(0.0)) * 0.9, 0.0, 100.0)


def safety_score(blur, noise, compression, dynamic_range, dark, highlight) -> Column:
    """0 .. 100, clipped and then rounded half to even."""
    raw = 35.0 + F.least(F.log1p(blur) * 8.0, F.lit(40.0)) + F.least(dynamic_range / 150.0, F.lit(1.0)) * 24.0 - (noise * 0.7 + compression * 0.15 + dark * 55.0 + highlight * 70.0)
    return F.bround(clip(raw, 0.0, 100.0)).cast("int")


def scene(faces, brightness, saturation, width, height) -> Column:
    return (
        F.when(faces >= 2, "Group portrait").when(faces == 1, "Portrait").when(brightness < 75, "Night / low light")
        .when(saturation < 35, "Old or faded photo").when(width > height * 1.25, "Landscape / event").otherwise("General photo")
    )


def review_reasons(blur, dark, clipped, noise, score) -> Column:
    return listed((blur < 35, "severe blur"), ((blur >= 35) & (blur < 75), "soft focus"), (dark > 0.28, "very dark"), (clipped > 0.10, "blown highlights"), (noise > 10, "heavy noise"), (score < 48, "low quality score"))


def ui_social_score(top_density, bottom_density, top_std, bottom_std, top_mean, middle_mean, bottom_mean, height, width) -> Column:
    """How much a raster looks like a phone screenshot, from its top and bottom bands' edges, flatness and contrast."""
    flat = lambda std: F.greatest(F.lit(0.0), 20.0 - std)
    bands = F.least(F.abs(top_mean - middle_mean) + F.abs(bottom_mean - middle_mean), F.lit(80.0)) / 4.0
    tall = F.when(height / F.greatest(width, F.lit(1)) > 1.5, 16.0).otherwise(0.0)
    return clip(top_density * 1.8 + bottom_density * 1.5 + flat(top_std) * 0.35 + flat(bottom_std) * 0.55 + bands + tall, 0.0, 100.0)


def is_screenshot(height, width, text_edge, social) -> Column:
    aspect = height / F.greatest(width, F.lit(1))
    return (social >= 34) | ((aspect > 1.5) & (social >= 26)) | ((aspect > 1.75) & (social >= 22) & (text_edge >= 1.0))


def is_low_resolution(height, width) -> Column:
    return (F.least(height, width) < 1000) | (height.cast("long") * width < 1_500_000)


def problems(i) -> Column:
    """i(name): a column of the inspection."""
    return listed(
        (i("is_screenshot"), "social-media or phone screenshot interface"),
        (i("is_low_resolution"), "low resolution"),
        (i("compression") > 12, "JPEG compression artefacts"),
        (i("blur") < 120, "soft focus or blur"),
        (i("noise") > 8.5, "visible noise"),
        (i("dark") > 0.14, "deep shadows"),
        (i("highlight") > 0.05, "clipped highlights"),
        (i("contrast") < 36, "low contrast"),
        ((i("face_count") > 0) & (i("smallest_face") < 0.015), "small face detail"),
        (i("is_monochrome"), "black and white / monochrome image"),
    )


def image_type(i) -> Column:
    return (
        F.when(i("is_screenshot"), "Screenshot Recovery").when(i("is_monochrome"), "Black & White Restore")
        .when(i("face_count") > 0, "Portrait / People").when(i("dark") > 0.16, "Low Light").otherwise("General Photograph")
    )


def plan_name(i, mode) -> Column:
    """Automatic routing; any other mode passes through as the plan's name."""
    asked = F.coalesce(F.nullif(mode, F.lit("")), F.lit("Auto Detect"))
    routed = (
        F.when(i("is_screenshot"), "Screenshot Recovery").when(i("is_monochrome"), "Black & White Restore").when(i("quality_score") >= 80, "Professional Light Polish")
        .when(i("face_count") > 0, "Identity-Safe Portrait Recovery").otherwise("Automatic Photo Recovery")
    )
    return F.when(asked == "Auto Detect", routed).otherwise(asked)


def plan_stages(i) -> Column:
    """What is announced; what is carried out has its own thresholds (``candidates.repairs``)."""
    return listed(
        (i("is_screenshot"), "crop screenshot interface"),
        (i("is_screenshot") | (i("compression") > 12), "repair JPEG compression"),
        (i("noise") > 8.5, "adaptive denoise"),
        (i("blur") < 160, "edge-limited detail recovery"),
        (i("is_monochrome"), "restore monochrome contrast"),
        (i("is_monochrome"), "recover local tonal detail"),
        (i("dark") > 0.08, "recover shadows"),
        (i("highlight") > 0.03, "compress highlights"),
        (i("face_count") > 0, "identity-safe face lighting"),
        (F.lit(True), "professional colour and lighting"),
        (F.lit(True), "quality validation with retry"),
    )


def plan_confidence(found_problems) -> Column:
    return clip(62 + 5 * F.size(found_problems), 62, 97)


def requested_capabilities(i) -> Column:
    faces = i("face_count") > 0
    return F.array_distinct(listed(
        (i("is_screenshot") | (i("compression") > 12), "jpeg_repair"),
        (i("noise") > 8.5, "denoise"),
        (i("blur") < 160, "deblur"),
        (faces & ((i("smallest_face") < 0.025) | (i("blur") < 220) | i("is_screenshot")), "face_recovery"),
        (faces, "face_protect"),
        (i("dark") > 0.08, "lighting"),
        (~i("is_monochrome"), "colour"),
        (i("is_low_resolution") | i("is_screenshot"), "super_resolution"),
    ))


def allow_upscale(capabilities, upscale, screenshot, height, width) -> Column:
    """Super resolution stays only if chosen, for screenshots and for small rasters."""
    wanted = upscale.isin("2× AI Upscale", "2× upscale", "4K AI Upscale", "4K long edge") | screenshot | (F.least(height, width) < 720)
    return F.when(wanted, capabilities).otherwise(F.array_remove(capabilities, "super_resolution"))


def upscale_decision(upscale, screenshot, height, width) -> Column:
    """'2x', '4k' or 'none' for the fallback."""
    auto = (upscale == "Original size") & (screenshot | (F.least(height, width) < 720))
    return F.when(upscale.isin("2× AI Upscale", "2× upscale") | auto, "2x").when(upscale.isin("4K AI Upscale", "4K long edge") & (F.greatest(height, width) < 3840), "4k").otherwise("none")


def straightens(angle, locked_faces, same_geometry) -> Column:
    return (F.abs(angle) >= 0.45) & (F.abs(angle) <= 8) & ~locked_faces & same_geometry


def horizon(angles) -> Column:
    """Median of the segments' angles within 12 degrees of level; 0 without any. Angles are folded into -90 .. 90 first."""
    folded = F.transform(angles, lambda a: F.when(a > 90, a - 180).when(a < -90, a + 180).otherwise(a))
    level = F.array_sort(F.filter(folded, lambda a: F.abs(a) <= 12))
    n = F.size(level)
    middle = (F.get(level, ((n - 1) / 2).cast("int")) + F.get(level, (n / 2).cast("int"))) / 2
    return F.when(n == 0, F.lit(0.0)).otherwise(middle)


def protection(ratio, sharpness) -> Column:
    """(level, most change) of a face."""
    return (
        F.when((ratio < 0.012) | (sharpness < 35), F.struct(F.lit("Maximum").alias("level"), F.lit(0.10).alias("most_change")))
        .when((ratio < 0.035) | (sharpness < 80), F.struct(F.lit("High").alias("level"), F.lit(0.16).alias("most_change")))
        .otherwise(F.struct(F.lit("Normal").alias("level"), F.lit(0.24).alias("most_change")))
    )


def warnings(any_maximum, compression, blur, dark, highlight) -> Column:
    return listed(
        (any_maximum, "Tiny or heavily blurred face detected; maximum identity protection applied"),
        (compression > 20, "Heavy JPEG compression detected"),
        (blur < 80, "Strong blur or missed focus detected"),
        (dark > 0.18, "Large areas of deep shadow detected"),
        (highlight > 0.08, "Large areas of clipped highlights detected"),
    )


def targets(spark: SparkSession) -> DataFrame:
    """The five tiers of limits, a table of fixed size."""
    return spark.createDataFrame(TARGETS, "target string, min_identity double, min_structure double, max_clip double, max_sharp double")


def with_limits(df: DataFrame, target: str = "target") -> DataFrame:
    """Adds the tier's limits; an unknown target counts as Professional."""
    known = F.col(target).isin(*[t[0] for t in TARGETS])
    return df.withColumn(target, F.when(known, F.col(target)).otherwise("Professional")).join(F.broadcast(targets(df.sparkSession)), target)


def validation_reasons(identity, structure, clip_delta, sharp_ratio, same_geometry) -> Column:
    """Which limits a candidate breaks; nothing is judged once geometry changed."""
    broken = listed(
        (identity < F.col("min_identity"), "identity"),
        (structure < F.col("min_structure"), "structure"),
        (clip_delta > F.col("max_clip"), "clipping"),
        (sharp_ratio > F.col("max_sharp"), "sharpness"),
    )
    return F.when(same_geometry, broken).otherwise(F.array(F.lit("geometry")))


def candidate_score(identity, structure, clip_delta, sharp_ratio) -> Column:
    return identity * 0.62 + structure * 0.38 - (clip_delta * 8.0 + F.greatest(F.lit(0.0), sharp_ratio - 1.0) * 0.03)


def review_needed(reason, accepted, post_accepted, quality, safety, faces_protected, similarity, unapplied_step, has_warnings, target, identity_lock=True) -> Column:
    return (
        (reason != "") | ~accepted | ~post_accepted | (quality < 38) | (safety < 38)
        | (F.lit(identity_lock) & (faces_protected > 0) & (similarity < 0.72)) | unapplied_step | (has_warnings & target.isin("Archive", "Museum"))
    )


def mode_name(mode) -> Column:
    """A mode's present name."""
    aliases = F.create_map(*[F.lit(x) for pair in MODE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, mode), mode)


def finish_strength(finish, mode) -> Column:
    """The strength that a finish and a mode select."""
    chosen = F.when(finish == "Natural Finish", "natural").when(finish == "Professional Finish", "strong").when(finish == "Maximum Recovery", "maximum")
    return F.when(mode == "Auto Enhance", "natural").when(mode.isin("Auto Restore", "Auto Screenshot Recovery"), "maximum").when(mode.isin("Auto Portrait", "Auto Celebrations"), "strong").otherwise(chosen)
