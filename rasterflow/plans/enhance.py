"""The whole batch pipeline: measure, score, plan, try strategies, keep the best safe result, flag for review.

Rules are column expressions; pixels are touched in one pass over each photo (``improve``), which tries the strategies, keeps
the best, applies profiles and finishing steps, and compares the result with the original. Candidates never leave the task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterflow.functions.sharing import checkpoint, spread
from rasterflow.operators import images, packs, rules
from rasterflow.operators import transforms as T
from rasterflow.sources import rasters

FACES = "array<struct<x:int,y:int,w:int,h:int>>"
PROFILES = "array<struct<name:string,settings:map<string,string>>>"
RESULT = (
    "photo_id long, out_height int, out_width int, out_data binary, ordinal int, before double, after double, quality_accepted boolean, safe boolean, "
    "identity double, faces_protected int, structure double, clip_delta double, sharp_ratio double, steps array<struct<step:string,applied:boolean,message:string>>"
)


def interleaved(df: DataFrame) -> DataFrame:
    """Adds data, the bytes of planes b, g, r pixel by pixel."""
    hexed = F.array_join(F.flatten(F.transform(F.arrays_zip("b", "g", "r"), lambda t: F.array(*[F.lpad(F.hex(t[c].cast("long")), 2, "0") for c in "bgr"]))), "")
    return df.withColumn("data", F.unhex(hexed))


def i(name: str) -> F.Column:
    return F.col({"compression": "compression_axes", "dark": "dark_35", "highlight": "light_248"}.get(name, name))


def judged(df: DataFrame) -> DataFrame:
    """Adds the scores, the plan, and defaults for what a caller may know of a photo: faces, profiles, horizon, how to upscale, whether it is a screenshot."""
    c = F.col
    known = {"faces": F.array().cast(FACES), "profiles": F.array().cast(PROFILES), "horizon_angle": F.lit(0.0), "upscale": F.lit("none"), "is_screenshot": F.lit(False)}
    df = df.withColumns({n: v for n, v in known.items() if n not in df.columns})
    df = df.withColumns({"face_count": F.size("faces"), "smallest_face": F.coalesce(F.array_min(F.transform("faces", lambda f: f.w * f.h / (c("height") * c("width")))), F.lit(0.0)), "is_low_resolution": rules.is_low_resolution(c("height"), c("width"))})
    df = df.withColumns({
        "engine": rules.engine_quality(c("blur"), c("contrast"), c("noise"), c("dark_8"), c("clipped_250")),
        "safety": rules.safety_score(c("blur"), c("noise"), c("compression_pooled"), c("dynamic_range"), c("dark_35"), c("light_248")),
        "analyser": rules.analyser_score(c("blur"), c("brightness"), c("dark_35"), c("light_250"), c("contrast"), c("noise")),
    }).withColumn("quality_score", F.bround("engine").cast("int"))
    return df.withColumn("plan_name", rules.plan_name(i, F.lit("Auto Detect"))).withColumn("scene", rules.scene(c("face_count"), c("brightness"), c("saturation"), c("width"), c("height")))


def strategy_steps(strategy: int, screenshot, compression, monochrome, noise, blur, dark, light) -> list[tuple[str, list[float]]]:
    """The steps that a strategy carries out on a photo, with its own thresholds."""
    out = [("crop_screenshot", [strategy])] if screenshot else []
    if compression > 8 or screenshot:
        out.append(("repair_compression", [strategy]))
    if monochrome:
        return [*out, ("restore_monochrome", [strategy])]
    if noise > 8.5 and strategy:
        out.append(("denoise", [strategy]))
    if blur < 180:
        out.append(("detail", [strategy]))
    return [*out, ("recover_lighting", [strategy, dark, light]), ("finish", [strategy])]


def _settled(img: np.ndarray, r: dict, done: list) -> tuple:
    """(best strategy, its score, the score before, whether it is taken, pixels)."""
    before = images.quality(T.luma(img))
    best = (-1.0, 0, img, [])
    for k in range(2 if r["plan_name"] == "Professional Light Polish" else 3):
        new, steps = img, strategy_steps(k, r["is_screenshot"], r["compression_axes"], r["is_monochrome"], r["noise"], r["blur"], r["dark_35"], r["light_248"])
        for name, values in steps:
            new = T.STEPS[name](new, *values)
        score = images.quality(T.luma(new))
        if score > best[0]:
            best = (score, k, new, [s for s, _ in steps])
    taken = best[0] + (4.0 if r["is_screenshot"] else 1.5) >= before
    done += [{"step": s, "applied": taken, "message": "applied" if taken else "no better than the original"} for s in best[3]]
    return best[1], best[0] if taken else before, before, taken, best[2] if taken else img


def _improved(img: np.ndarray, r: dict, lock: bool) -> dict:
    done: list[dict] = []
    note = lambda step, old, new: done.append({"step": step, "applied": new is not old, "message": "applied" if new is not old else "not needed"})
    ordinal, after, before, taken, new = _settled(img, r, done)
    for p in r["profiles"] or []:
        old, new = new, T.profile(new, p["name"], dict(p["settings"] or {}))
        note("profile:" + p["name"], old, new)
    faces = [(f["x"], f["y"], f["w"], f["h"]) for f in r["faces"] or []]
    inside = faces if new.shape == img.shape else []
    if not r["is_monochrome"]:
        old, new = new, T.clean_flares(new, faces=inside)
        note("clean_flares", old, new)
    if not (lock and faces) and new.shape == img.shape:
        old, new = new, T.straighten(new, r["horizon_angle"])
        note("straighten", old, new)
    inside = faces if new.shape == img.shape else []
    if inside:
        new = T.relight_faces(new, inside)
    identity, protected = 1.0, 0
    if lock and new.shape == img.shape:
        new, protected, _ = T.lock_faces(new, img, faces)
        identity = T.face_likeness(new, img, faces)  # what the safety check sees: after the lock
    same, safe = new.shape == img.shape, True
    structure, clip_delta, sharp_ratio = 1.0, 0.0, 1.0
    if same:
        a, b = T.luma(img), T.luma(new)
        ends = lambda x: float(((x <= 5) | (x >= 250)).mean())
        structure, clip_delta = T.strict_likeness(img, new), max(0.0, ends(b) - ends(a))
        sharp_ratio = float(T.laplacian(b).astype(np.float64).var() / (T.laplacian(a).astype(np.float64).var() + 1e-6))
        safe = identity >= r["min_identity"] and structure >= r["min_structure"] and clip_delta <= r["max_clip"] and sharp_ratio <= r["max_sharp"]
        new = new if safe else img
    if r["upscale"] == "2x":
        new = T.upscale(new, 2.0)
    elif r["upscale"] == "4k" and max(new.shape[:2]) < 3840:
        new = T.upscale(new, 3840 / max(new.shape[:2]))
    return {"out_height": new.shape[0], "out_width": new.shape[1], "out_data": new.tobytes(), "ordinal": ordinal, "before": before, "after": after, "quality_accepted": taken, "safe": safe,
            "identity": identity, "faces_protected": protected, "structure": structure, "clip_delta": clip_delta, "sharp_ratio": sharp_ratio, "steps": done}


def improve(photos: DataFrame, facts: list[str], lock: bool = True) -> DataFrame:
    """The pixel pass over judged photos with limits: a row per photo, and for one that fails its original and the fault. facts: columns that come along."""
    used = ["photo_id", "height", "width", "data", "plan_name", "is_screenshot", "is_monochrome", "compression_axes", "noise", "blur", "dark_35", "light_248", "faces", "profiles", "horizon_angle", "upscale", "min_identity", "min_structure", "max_clip", "max_sharp"]
    step = pa.struct([("step", pa.string()), ("applied", pa.bool_()), ("message", pa.string())])
    own = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [(n, own.get(t, pa.list_(step))) for n, t in (x.split(" ", 1) for x in RESULT.split(", "))]

    def one(r: dict) -> dict:
        kept = {"photo_id": r["photo_id"], "facts": r["facts"]}
        try:
            return {**kept, **_improved(T.as_bgr(r["data"], r["height"], r["width"]), r, lock)}
        except (ValueError, TypeError, KeyError) as e:
            fault = [{"step": "improve", "applied": False, "message": f"failed safely: {e}"}]
            return {**kept, "out_height": r["height"], "out_width": r["width"], "out_data": r["data"], "quality_accepted": False, "safe": False, "steps": fault}

    def run(batches):
        for batch in batches:
            made = pa.schema([*fields, batch.schema.field("facts")])
            for k in range(0, batch.num_rows, 64):
                part, size = [], 0
                for r in batch.slice(k, 64).to_pylist():
                    part.append(one(r))
                    size += len(part[-1]["out_data"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(part, made)
                        part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_pylist(part, made)

    with_facts = photos.select(*used, F.struct(*facts).alias("facts"))
    return with_facts.mapInArrow(run, f"{RESULT}, facts {with_facts.schema['facts'].dataType.simpleString()}").select("*", "facts.*").drop("facts")


def finished(photos: DataFrame, target: str, lock: bool = True) -> DataFrame:
    """Judged photos through the pixel pass, with the review flag."""
    ready = rules.with_limits(photos.withColumn("target", F.lit(target)))
    made = improve(ready, ["plan_name", "scene", "blur", "dark_35", "light_250", "light_248", "noise", "analyser", "quality_score", "safety", "compression_pooled", "target"], lock)
    c = F.col
    reasons = F.concat_ws(", ", rules.review_reasons(c("blur"), c("dark_35"), c("light_250"), c("noise"), c("analyser")))
    warned = F.size(rules.warnings(F.lit(False), c("compression_pooled"), c("blur"), c("dark_35"), c("light_248"))) > 0
    unapplied = F.exists("steps", lambda s: s.message.startswith("failed"))
    return made.select(
        "photo_id", "plan_name", "scene", "ordinal", F.size("steps").alias("n_steps"), "before", "after", "quality_accepted", "safe", "identity", "faces_protected", "structure", "clip_delta", "sharp_ratio", "steps",
        rules.review_needed(reasons, c("quality_accepted"), c("safe"), c("quality_score"), c("safety"), F.coalesce("faces_protected", F.lit(0)), F.coalesce("identity", F.lit(1.0)), unapplied, warned, c("target"), lock).alias("review_needed"),
        F.col("out_height").alias("height"), F.col("out_width").alias("width"), F.col("out_data").alias("data"),
    )


def seen(planes: DataFrame, height: int, width: int) -> DataFrame:
    """Photos given as planes (photo_id, b, g, r) of one size, measured as images, once however often they are used."""
    dealt = spread(planes.select("photo_id", "b", "g", "r"), "photo_id")
    return checkpoint(images.inspected(interleaved(dealt).withColumns({"height": F.lit(height), "width": F.lit(width), "n_channels": F.lit(3), "orientation": F.lit(1)})))


def enhance(planes: DataFrame, height: int, width: int, target: str = "Professional") -> DataFrame:
    """Photos given as planes through the whole pipeline."""
    return finished(judged(seen(planes, height, width)), target)


def with_profiles(judged_photos: DataFrame, profiles: DataFrame, installed: F.Column) -> DataFrame:
    """Adds the profiles that apply to each photo, in order. profiles: profile_order, pack_id, pack_type, scene_hints, depends_on, settings; a table of fixed size."""
    typed = judged_photos.select("photo_id", rules.image_type(i).alias("image_type"), "scene")
    chosen = packs.choose(packs.match(typed, profiles), "photo_id", installed).where("outcome = 'applied'")
    entry = F.struct((F.col("pack_type") != "hybrid-core").alias("late"), "profile_order", F.col("pack_id").alias("name"))
    # the settings follow by name: maps can't be sorted
    listed = chosen.groupBy("photo_id").agg(F.sort_array(F.collect_list(entry)).alias("order"), F.collect_list(F.struct(F.col("pack_id").alias("name"), "settings")).alias("found"))
    ordered = F.transform("order", lambda o: F.get(F.filter("found", lambda f: f["name"] == o["name"]), F.lit(0)))
    return spread(judged_photos.drop("profiles"), "photo_id").join(listed.select("photo_id", ordered.cast(PROFILES).alias("profiles")), "photo_id", "left")


def output_names(paths: DataFrame, folder: str) -> DataFrame:
    """path and name: where each photo goes below the output folder, in the subfolder that it stands in below folder.

    Photos of one stem (a.png, a.jpg) keep their own suffix in the name, so that none overwrites another."""
    root = F.regexp_replace(F.lit(folder.rstrip("/")), "^file:/+", "file:///") if folder.startswith("file:") else F.lit(folder.rstrip("/"))
    full = F.regexp_replace("path", "^file:/+", "file:///" if folder.startswith("file:") else "/")
    decoded = F.url_decode(F.replace(full, F.lit("+"), F.lit("%2B")))
    target = F.substring(rasters.output_path(decoded, root), F.length(root) + len(rasters.OUTPUT_FOLDER) + 3, F.length(decoded) + 64)
    named = paths.select("path", F.regexp_replace(target, r"_enhanced\.jpg$", "").alias("stem"), F.replace(rasters.suffix(decoded), F.lit("."), F.lit("-")).alias("kind"))
    several = F.count("*").over(Window.partitionBy("stem")) > 1
    return named.select("path", F.concat("stem", F.when(several, F.col("kind")).otherwise(""), F.lit("_enhanced.png")).alias("name"))


def enhance_folder(spark: SparkSession, folder: str, out: str, upscale: str = "Original size", target: str = "Professional", exif: bool = True, faces: DataFrame | None = None, profiles: DataFrame | None = None, installed: list[str] = ()) -> DataFrame:
    """Image files below folder, scanned, decoded, turned upright, measured, planned, improved and written as PNG below out; a row of outcomes per file.

    faces: photo_id and faces, where a detector has found some; profiles: see ``with_profiles``, of the packs installed. Files that
    can't be decoded or written keep a row with error and review_needed; files in output folders, out included, aren't read again."""
    below = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/").startswith(F.lit(re.sub("^file:/+", "/", out.rstrip("/")) + "/"))
    read = checkpoint(images.read_photos(spark, folder, exif).where(~below))
    known = checkpoint(images.inspected(read))
    seen = known.where("error IS NULL")
    if faces is not None:
        seen = seen.join(faces.select("photo_id", F.col("faces").cast(FACES).alias("faces")), "photo_id", "left").withColumn("faces", F.coalesce("faces", F.array().cast(FACES)))
    shot = rules.is_screenshot(F.col("height"), F.col("width"), F.col("text_edge"), F.col("social"))
    seen = seen.withColumn("is_screenshot", F.coalesce(shot, F.lit(False)))
    seen = seen.withColumn("upscale", rules.upscale_decision(F.lit(upscale), F.col("is_screenshot"), F.col("height"), F.col("width")))
    ready = judged(seen)
    if profiles is not None:
        ready = with_profiles(ready, profiles, F.array(*map(F.lit, installed)))
    done = checkpoint(finished(ready, target).join(read.select("photo_id", "path"), "photo_id").join(output_names(read.select("path"), folder), "path"))
    written = T.write_photos(done.select("name", "height", "width", "data"), out)
    report = done.drop("data", "path").join(written, "name", "left")
    faults = known.where("error IS NOT NULL").select("photo_id", F.col("error").alias("fault"))
    rows = read.select("path", "photo_id").join(report, "photo_id", "left").join(faults, "photo_id", "left").withColumn("error", F.coalesce("fault", "error")).drop("fault")
    return rows.withColumn("review_needed", F.col("error").isNotNull() | F.coalesce("review_needed", F.lit(False)))
