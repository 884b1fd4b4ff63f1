"""Registered queries of the image-analytics operators over the driver's tables.

embeddings stand in for rasters, documents for files, events for JSON documents, part, supplier and
lineitem for plug-in packs (see ``sources.rasters``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.functions import pixels as P
from rasterflow.functions.sharing import fresh_folder, numbered, spread
from rasterflow.operators import candidates, dedupe, faces, measure, packs, reports, rules, tiles
from rasterflow.sources import rasters
from rasterflow.sources.rasters import table

R = lambda c, n=6: F.round(c, n).alias(c)


def raster_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = measure.tone(rasters.small_rasters(spark, sf_dir))
    return df.select("photo_id", R("brightness"), R("contrast"), R("dark_35"), R("dark_8"), R("light_250"), R("light_248"), R("clipped_250"))


def raster_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.focus(rasters.small_rasters(spark, sf_dir), 8, 8).select("photo_id", R("blur", 4), R("noise"))


def raster_blockiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.blockiness(rasters.tiled_rasters(spark, sf_dir), 24, 24).select("photo_id", R("compression_axes"), R("compression_pooled"))


def raster_dynamic_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.dynamic_range(rasters.small_rasters(spark, sf_dir)).select("photo_id", R("dynamic_range"))


def raster_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = measure.colour(rasters.colour_rasters(spark, sf_dir))
    return df.select("photo_id", R("colour_cast"), R("saturation"), R("saturation_p90"), R("channel_spread"), "is_monochrome", "is_gray_scan")


def raster_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.gradients(rasters.small_rasters(spark, sf_dir), 8, 8).select("photo_id", R("gradient_x"), R("gradient_y"), "sigma_x", "sigma_y")


def low_light_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.medians(rasters.small_rasters(spark, sf_dir)).select("photo_id", R("median_luma"), R("share_55"), "night_applies")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small rasters with all metrics, the three scores, and stand-ins for size and faces that vary by id."""
    df = measure.all_small(rasters.small_rasters(spark, sf_dir))
    c = F.col
    return df.withColumns({
        "analyser": rules.analyser_score(c("blur"), c("brightness"), c("dark_35"), c("light_250"), c("contrast"), c("noise")),
        "engine": rules.engine_quality(c("blur"), c("contrast"), c("noise"), c("dark_8"), c("clipped_250")),
        "safety": rules.safety_score(c("blur"), c("noise"), c("compression_pooled"), c("dynamic_range"), c("dark_35"), c("light_248")),
        "face_count": (c("photo_id") % 4).cast("int"),
        "smallest_face": F.when(c("photo_id") % 4 == 0, 0.0).otherwise((c("photo_id") % 40) / 1000.0),
        "height": F.lit(600) + (c("photo_id") % 7).cast("int") * 200,
        "width": F.lit(800) + (c("photo_id") % 5).cast("int") * 200,
    }).withColumns({
        "is_screenshot": c("photo_id") % 11 == 0,
        "is_monochrome": c("photo_id") % 5 == 0,
        "is_low_resolution": rules.is_low_resolution(c("height"), c("width")),
        "quality_score": F.bround(c("engine")).cast("int"),
    })


_INSPECTION = {"compression": "compression_axes", "dark": "dark_35", "highlight": "light_248"}


def _i(name: str) -> F.Column:
    return F.col(_INSPECTION.get(name, name))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("photo_id", "analyser", R("engine", 5), "safety")


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scored(spark, sf_dir)
    c = F.col
    return df.select("photo_id", F.concat_ws(", ", rules.review_reasons(c("blur"), c("dark_35"), c("light_250"), c("noise"), c("analyser"))).alias("review_reason"))


def scene_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos, mean score and photos for review by scene."""
    c = F.col
    df = _scored(spark, sf_dir).withColumn("scene", rules.scene(c("face_count"), c("brightness"), F.lit(100.0), c("width"), c("height")))
    reasons = rules.review_reasons(c("blur"), c("dark_35"), c("light_250"), c("noise"), c("analyser"))
    return df.groupBy("scene").agg(F.count("*").alias("photos"), F.round(F.avg("analyser"), 6).alias("mean_score"), F.count_if(F.size(reasons) > 0).alias("for_review"))


def problem_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("photo_id", F.concat_ws("; ", rules.problems(_i)).alias("problems"), rules.image_type(_i).alias("image_type"), rules.plan_confidence(rules.problems(_i)).cast("long").alias("confidence"))


def plan_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("photo_id") % 9 == 0, "Auto Portrait").when(F.col("photo_id") % 9 == 1, "").otherwise("Auto Detect")
    return _scored(spark, sf_dir).select("photo_id", rules.plan_name(_i, mode).alias("plan"), F.concat_ws("; ", rules.plan_stages(_i)).alias("stages"))


def capability_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scored(spark, sf_dir).withColumn("upscale", F.when(F.col("photo_id") % 3 == 0, "4K long edge").otherwise("Original size"))
    asked = rules.allow_upscale(rules.requested_capabilities(_i), F.col("upscale"), F.col("is_screenshot"), F.col("height"), F.col("width"))
    found = df.withColumn("requested", asked)
    return found.select("photo_id", F.concat_ws(",", "requested").alias("requested"), rules.upscale_decision(F.col("upscale"), F.col("is_screenshot"), F.col("height"), F.col("width")).alias("fallback"))


def capability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each capability is asked for, and in which place at first."""
    asked = _scored(spark, sf_dir).select(F.posexplode(rules.requested_capabilities(_i)).alias("place", "capability"))
    return asked.groupBy("capability").agg(F.count("*").alias("n"), F.min("place").cast("long").alias("first_place"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("text").cast("binary").alias("content"))
    return dedupe.first_occurrence(files).where("copies > 1").select(F.col("ord").alias("doc_id"), "sha", F.col("first_ord").alias("first_doc"), "copies", (F.col("ord") == F.col("first_ord")).alias("is_first"))


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("photo_id"), dedupe.signature(F.transform("embedding", lambda v: v.cast("double"))).alias("sig"))


def signature_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir).select("photo_id", dedupe.signature_hex(F.col("sig")).alias("phash"), F.bit_count("sig").cast("long").alias("ones"))


def _flipped(sig: F.Column, key: F.Column) -> F.Column:
    """A copy of a signature with up to nine bits flipped, as the key says."""
    one = F.lit(1).cast("long")
    for k in range(9):
        sig = sig.bitwiseXOR(F.when(key % 10 > k, F.call_function("shiftleft", one, ((key * 7 + k * 13) % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    return sig


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures against bit-flipped copies of all of them, within 7 bits."""
    sigs = _signatures(spark, sf_dir)
    copies = sigs.select(F.col("photo_id").alias("copy_id"), _flipped(F.col("sig"), F.col("photo_id")).alias("sig"))
    return dedupe.near_pairs(sigs, copies, 7, "photo_id", "copy_id").select("photo_id", "copy_id", F.col("distance").cast("long").alias("distance"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with content hash and signature: documents by content; each takes the signature of a photo, flipped a little."""
    sigs = _signatures(spark, sf_dir)
    photos = sigs.agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    digits = lambda a, n: F.conv(F.substring("sha", a, n), 16, 10).cast("long")
    keyed = docs.crossJoin(F.broadcast(photos)).withColumn("photo_id", digits(1, 8) % F.col("n"))
    return keyed.join(sigs, "photo_id").select("ord", "sha", _flipped(F.col("sig"), digits(9, 4) % 1000).alias("sig"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.groups(_files(spark, sf_dir))


def best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), F.col("quality").alias("score"))
    return dedupe.best_of_group(dedupe.groups(_files(spark, sf_dir)), scores).where("is_best").select("group", F.col("ord").alias("doc_id"), "score")


def strategy_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the strategies tried for each photo, and whether it is taken."""
    df = _scored(spark, sf_dir).withColumn("plan", rules.plan_name(_i, F.lit("Auto Detect"))).withColumn("before", F.round("engine", 6))
    tried = candidates.repairs(candidates.expand(df)).withColumn("after", F.round(candidates.quality_of(F.col("work"), 8, 8), 6))
    chosen = candidates.accept(candidates.best(tried.select("photo_id", "ordinal", "strategy", "after", "before", "is_screenshot"), "photo_id", "after", "ordinal"))
    return chosen.select("photo_id", "strategy", R("before", 3), R("after", 3), "accepted", R("improvement", 3))


def duplicate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each member of a duplicate group goes: the group's folder, the best one marked, its enhanced copy among the best photos."""
    scores = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), F.col("quality").alias("score"))
    members = dedupe.best_of_group(dedupe.groups(_files(spark, sf_dir)), scores)
    paths = dedupe.group_outputs(members.withColumn("path", F.concat(F.lit("/photos/doc-"), F.col("ord").cast("string"), F.lit(".jpg"))))
    return paths.select("group", F.col("ord").alias("doc_id"), "copy", "best_copy")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each photo with its follower (the last with itself) as a candidate; every other candidate is the photo itself, mixed with a little of the follower."""
    r = rasters.small_rasters(spark, sf_dir)
    follower = r.select((F.col("photo_id") - 1).alias("photo_id"), F.col("px").alias("out_px"))
    pairs = r.join(follower, "photo_id", "left").withColumn("out_px", F.coalesce("out_px", "px"))
    mixed = F.zip_with("px", "out_px", lambda a, b: F.floor((15 * a + b) / 16).cast("int"))
    return pairs.withColumn("out_px", F.when(F.col("photo_id") % 2 == 0, mixed).otherwise(F.col("out_px")))


def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, out = F.col("px"), F.col("out_px")
    flat = F.when(F.col("photo_id") % 17 == 0, F.transform(out, lambda _: F.lit(90))).otherwise(out)
    df = _pairs(spark, sf_dir).withColumn("out_px", flat)
    return df.select("photo_id", F.round(P.correlation_strict(px, out), 6).alias("strict"), F.round(P.correlation_lenient(px, out), 6).alias("lenient"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(t[0]) for t in rules.TARGETS], F.lit("Unknown"))
    df = _pairs(spark, sf_dir).withColumns({"target": F.get(names, (F.col("photo_id") % 6).cast("int")), "identity": F.when(F.col("photo_id") % 3 == 0, 0.90).otherwise(1.0)})
    return candidates.validate(df)


def post_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("photo_id", "target", R("structure"), R("clip_delta"), F.round(F.log1p("sharp_ratio"), 5).alias("log_sharp_ratio"), F.concat_ws(",", "reasons").alias("reasons"), "accepted")


def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos in fours as candidates of one reference."""
    df = _validated(spark, sf_dir).withColumns({"reference": F.floor(F.col("photo_id") / 4), "candidate": F.col("photo_id") % 4})
    ranked = candidates.rank(df.withColumns({c: F.round(c, 6) for c in ("structure", "clip_delta", "sharp_ratio")}), "reference", "candidate")
    return ranked.select("reference", "attempted", "accepted_candidates", "chosen", "accepted", R("score", 4))


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    df = _scored(spark, sf_dir)
    reasons = rules.review_reasons(c("blur"), c("dark_35"), c("light_250"), c("noise"), c("analyser"))
    key = c("photo_id")
    needed = rules.review_needed(F.concat_ws(", ", reasons), key % 13 != 0, key % 7 != 0, c("quality_score"), c("safety"), c("face_count"), F.lit(1.0) - (key % 50) / 100.0, key % 19 == 0, F.size(rules.warnings(key % 23 == 0, c("compression_pooled"), c("blur"), c("dark_35"), c("light_248"))) > 0, F.when(key % 2 == 0, "Museum").otherwise("Studio"))
    return df.withColumns({"review_needed": needed, "error": F.when(key % 29 == 0, "unreadable"), "root": key % 3})


def review_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir).select("photo_id", "review_needed")


def batch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by output root."""
    ok = F.col("error").isNull()
    return _review(spark, sf_dir).groupBy("root").agg(F.count_if(ok).alias("completed"), F.count_if(~ok | F.col("review_needed")).alias("review"), F.count_if(~ok).alias("failed"))


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the whole batch, duplicates included, as the passes that write its outcomes and duplicate groups see them."""
    outcomes = _review(spark, sf_dir).select("photo_id", "root", "error", "review_needed")
    counted = reports.write_outcomes(outcomes, dedupe.groups(_files(spark, sf_dir)), fresh_folder(spark))
    return spark.range(1).select(*[F.lit(counted[c]).cast("long").alias(c) for c in ("completed", "review", "failed", "duplicates")])


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    df = _scored(spark, sf_dir).withColumns({
        "filename": F.concat(F.lit("photo-"), F.lpad(c("photo_id").cast("string"), 6, "0"), F.lit(".jpg")), "quality_score": c("analyser"), "scene": rules.scene(c("face_count"), c("brightness"), F.lit(100.0), c("width"), c("height")),
        "horizon_angle": rules.horizon(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: ((c("photo_id") * 37 + k * 53) % 720).cast("double") / 4 - 90)),
        "reasons": rules.review_reasons(c("blur"), c("dark_35"), c("light_250"), c("noise"), c("analyser")),
    })
    out = reports.rows(df)
    return out.withColumns({n: F.round(n, 1) for n in ("blur_score", "brightness", "contrast", "noise_score", "horizon_angle")} | {n: F.round(n, 3) for n in ("dark_fraction", "clipped_highlights")})


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that failed, with the file that takes the message."""
    path = F.concat(F.lit("/photos/photo-"), F.col("photo_id").cast("string"), F.lit(".jpg"))
    return reports.error_files(reports.split_errors(_review(spark, sf_dir).withColumn("path", path))[1]).select("photo_id", "error_file", "error")


def review_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos for review: their copies and the texts beside them."""
    path = F.concat(F.lit("/photos/photo-"), F.col("photo_id").cast("string"), F.lit(".jpg"))
    done = reports.split_errors(_review(spark, sf_dir).withColumn("path", path))[0].where("review_needed")
    told = done.withColumns({"image_type": rules.image_type(_i), "plan_name": rules.plan_name(_i, F.lit("Auto Detect")), "problems": rules.problems(_i), "stages": rules.plan_stages(_i)})
    return reports.review_files(told).select("photo_id", "review_file", "details_file", "details")


def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as photographs in path order, numbered from 1."""
    kinds = F.array(*map(F.lit, [".jpg", ".png", ".txt"]))
    path = F.concat(F.lit("/photos/"), F.regexp_replace("url", r"^[a-z]+://", ""), F.lit("/im"), F.col("page_id").cast("string"), F.get(kinds, (F.col("page_id") % 3).cast("int")))
    files = table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(rasters.supported(F.col("path")))
    return numbered(files, "path", "place").select("page_id", "path", "place")


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None to three boxes in each small raster, by its id."""
    r = rasters.small_rasters(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(1), (F.col("photo_id") % 4).cast("int")))
    boxes = r.where(F.col("photo_id") % 4 > 0).withColumn("k", k)
    i = lambda e: e.cast("int")
    return boxes.withColumns({"x": i((F.col("photo_id") + F.col("k")) % 5), "y": i((F.col("photo_id") * 3 + F.col("k")) % 5), "w": i(2 + F.col("photo_id") % 2), "h": i(2 + F.col("k") % 2)})


def face_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = faces.profiles(_faces(spark, sf_dir), 8, 8)
    return df.select("photo_id", F.col("k").cast("long").alias("k"), R("area_ratio"), F.round("brightness", 6).alias("brightness"), R("contrast"), R("sharpness", 4), "level", "most_change")


def face_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All photos with their faces' aggregates, and defaults where there is none."""
    found = faces.per_photo(faces.profiles(_faces(spark, sf_dir), 8, 8))
    every = rasters.small_rasters(spark, sf_dir).select("photo_id")
    return every.join(found, "photo_id", "left").select("photo_id", F.coalesce("face_count", F.lit(0)).alias("face_count"), F.round(F.coalesce("smallest_face", F.lit(0.0)), 6).alias("smallest_face"), F.coalesce("any_maximum", F.lit(False)).alias("any_maximum"))


def face_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least similarity of padded face regions between each photo and its candidate; 1 without faces."""
    pairs = _pairs(spark, sf_dir).select("photo_id", "out_px")
    strict = faces.similarities(_faces(spark, sf_dir).join(pairs, "photo_id"), 8, 8)
    return pairs.join(strict, "photo_id", "left").select("photo_id", F.round(F.coalesce("identity", F.lit(1.0)), 6).alias("identity"), F.coalesce("faces_protected", F.lit(0)).alias("faces"))


#: Specialist profiles (id, kind, hints, packs they need).
PROFILES = [
    (0, "auto-portrait-pro", "processing-profile", ["Portrait / People", "Celebrations"], ["auto-essentials"]),
    (1, "auto-heritage", "processing-profile", ["Black & White Restore", "Old Photo"], ["auto-restoration-core"]),
    (2, "auto-social-recovery", "processing-profile", ["Screenshot Recovery"], []),
    (3, "auto-night-recovery", "processing-profile", ["Low Light"], ["auto-restoration-core"]),
    (4, "auto-restoration-core", "hybrid-core", [], []),
    (5, "auto-motion-recovery", "processing-profile", ["General Photograph", "portrait"], []),
]


def profile_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which profiles fit each photo, and what becomes of them."""
    c = F.col
    photos = _scored(spark, sf_dir).select("photo_id", rules.image_type(_i).alias("image_type"), rules.scene(c("face_count"), c("brightness"), F.lit(100.0), c("width"), c("height")).alias("scene"))
    profiles = spark.createDataFrame(PROFILES, "profile_order int, pack_id string, pack_type string, scene_hints array<string>, depends_on array<string>")
    chosen = packs.choose(packs.match(photos, profiles), "photo_id", F.array(F.lit("auto-restoration-core"), F.lit("auto-heritage")))
    return chosen.select("photo_id", "pack_id", "outcome", F.concat_ws(",", "missing").alias("missing"))


def profile_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applied profiles of each photo beside its messages, paired by position."""
    c = F.col
    photos = _scored(spark, sf_dir).select("photo_id", rules.image_type(_i).alias("image_type"), rules.scene(c("face_count"), c("brightness"), F.lit(100.0), c("width"), c("height")).alias("scene"))
    profiles = spark.createDataFrame(PROFILES, "profile_order int, pack_id string, pack_type string, scene_hints array<string>, depends_on array<string>")
    chosen = packs.choose(packs.match(photos, profiles), "photo_id", F.array(F.lit("auto-restoration-core"), F.lit("auto-heritage")))
    return packs.step_messages(chosen, "photo_id").select("photo_id", "place", "step", "message")


def pack_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities (part brands) that a pack (supplier) names more than once."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pack_id"), "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("capability"))
    return packs.duplicate_capabilities(lines.join(parts, "l_partkey"))


def installed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of each of the nine capabilities, by name: a pack's for the first five, else the file outside packs that a nation stands for."""
    names = F.array(*map(F.lit, packs.CAPABILITIES))
    lines = table(spark, sf_dir, "lineitem")
    files = lines.select(F.get(names, (F.col("l_partkey") % 5).cast("int")).alias("capability"), F.col("l_suppkey").alias("pack_order"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"),
                         F.concat(F.lit("m-"), F.col("l_partkey").cast("string"), F.lit(".onnx")).alias("filename"), (F.col("l_linestatus") == "O").alias("valid"), (F.col("l_returnflag") != "R").alias("there"))
    outside = table(spark, sf_dir, "nation").where("n_nationkey < 9 and n_nationkey <> 6").select(F.concat(F.get(names, F.col("n_nationkey").cast("int")), F.lit(".onnx")).alias("filename"))
    every = spark.createDataFrame([(n,) for n in packs.CAPABILITIES], "capability string")
    return packs.capability_map(packs.with_legacy(every, packs.resolve(files), outside)).select(F.posexplode(F.array_sort(F.map_entries("models"))).alias("place", "m")).select(F.col("place").cast("long").alias("place"), "m.key", "m.value").toDF("place", "capability", "filename")


def capability_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities asked for by photo: those that there is a model for (line items of the first five), and those missing."""
    names = F.array(*map(F.lit, packs.CAPABILITIES))
    have = table(spark, sf_dir, "lineitem").select(F.get(names, (F.col("l_partkey") % 5).cast("int")).alias("capability")).distinct()
    asked = _scored(spark, sf_dir).select("photo_id", rules.requested_capabilities(_i).alias("requested"))
    return packs.steps(asked, have).select("photo_id", F.concat_ws(",", "applied").alias("applied"), F.concat_ws(",", "missing").alias("missing"))


def spec_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as models with files beside them, some broken: the tile size of the specification that counts."""
    k = F.col("event_id")
    own = lambda text: F.concat(F.lit('{"denoise": '), text, F.lit("}"))
    sidecar = F.when(k % 7 == 0, '{"tile_size": 100}').when(k % 7 == 1, "{ broken").when(k % 7 == 2, "[1]")
    plain = F.when(k % 5 == 0, '{"tile_size": 200}').when(k % 5 == 1, "nothing")
    near = F.when(k % 3 == 0, own(F.concat(F.lit('{"tile_size": '), (300 + k % 10).cast("string"), F.lit("}")))).when(k % 11 == 1, own(F.lit("5"))).when(k % 11 == 2, '{"deblur": {}}')
    far = F.when(k % 2 == 0, own(F.lit('{"tile_size": 400}')))
    return spread(table(spark, sf_dir, "events").select("event_id"), "event_id").select("event_id", packs.spec_by_priority(sidecar, plain, near, far, "denoise")["tile_size"].alias("tile_size"))


def spec_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as models whose files have values of other types: those that can be read as the right one, and those that pass on to the next file."""
    k = F.col("event_id")
    choice = lambda n, *texts: F.get(F.array(*[F.lit(t) for t in texts]), (k % n).cast("int"))
    sidecar = choice(11, '{"tile_size": "512"}', '{"tile_size": "big"}', '{"tile_size": null}', '{"overlap": [1]}', '{"tile_size": 300.9}', '{"blend_strength": " 0.5 "}', '{"preserve_size": "no"}', '{"tile_size": true}', '{"layout": 5, "tile_size": 70}', '{"tile_size": "12.5"}', None)
    plain = choice(4, '{"tile_size": 200, "preserve_size": 0}', "7", None, '{"blend_strength": {}}')
    near = choice(3, '{"denoise": {"tile_size": "x"}}', '{"denoise": []}', '{"deblur": {"tile_size": 1}}')
    far = choice(2, '{"denoise": {"tile_size": 400, "layout": "NHWC", "preserve_size": []}}', None)
    s = packs.spec_by_priority(sidecar, plain, near, far, "denoise")
    return spread(table(spark, sf_dir, "events").select("event_id"), "event_id").select("event_id", s.alias("s")).select("event_id", "s.layout", "s.tile_size", "s.blend_strength", "s.preserve_size")


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour rasters as model tensors in each layout, colour order and number range, and back; some tensors come back with numbers that are none."""
    r, k = rasters.colour_rasters(spark, sf_dir), F.col("photo_id")
    r = r.withColumns({"layout": F.when(k % 2 == 0, "nchw").otherwise("nhwc"), "order": F.when(k % 3 == 0, "bgr").otherwise("rgb"), "kind": F.get(F.array(*map(F.lit, packs.RANGES)), (F.floor(k / 2) % 3).cast("int"))})
    coded = r.withColumn("tensor", tiles.encode(tiles.tensor(F.col("b"), F.col("g"), F.col("r"), F.col("layout"), F.col("order")), F.col("kind")))
    odd = F.transform("tensor", lambda v, i: F.when((k % 5 == 0) & (i == 7), float("nan")).when((k % 5 == 0) & (i == 100), float("inf")).when((k % 5 == 0) & (i == 150), float("-inf")).otherwise(v))
    back = coded.withColumn("planes", tiles.planes(tiles.decode(odd, F.col("kind")), F.col("layout"), F.col("order")))
    apart = lambda c: F.aggregate(F.zip_with(c, F.col("planes")[c], lambda a, b: F.when(F.abs(a - b) > 1, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    place = F.aggregate(F.transform("tensor", lambda v, i: v * (i + 1)), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return back.select("photo_id", "layout", "order", "kind", F.round(place / 1000, 3).alias("place_sum"), *[P.total(F.col("planes")[c]).alias(f"{c}_sum") for c in "bgr"], (apart("b") + apart("g") + apart("r")).cast("long").alias("changed"))


def capability_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as packs in key order, their line items as files, part brands as capabilities: the first file of a valid pack."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pack_order"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"), "l_partkey", (F.col("l_returnflag") != "R").alias("there"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("capability"), F.col("p_name").alias("filename"))
    valid = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pack_order"), (F.col("s_acctbal") > 0).alias("valid"))
    files = lines.join(parts, "l_partkey").join(valid, "pack_order")
    found = packs.resolve(files)
    every = parts.select("capability").distinct()
    return every.join(found, "capability", "left").select("capability", F.col("pack_order").alias("supplier"), "filename")


def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as installed files of packs (their sources), against manifests that are wrong in places."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    there = key % 9 != 4
    files = d.select(
        F.col("source").alias("pack_id"), key.alias("position"), F.concat(F.lit("doc-"), key.cast("string"), F.lit(".onnx")).alias("filename"),
        F.when(key % 7 == 3, F.octet_length("text") + 1).when(key % 5 == 0, 0).otherwise(F.octet_length("text")).cast("long").alias("size"),
        F.when(key % 11 == 5, F.repeat(F.lit("0"), 64)).when(key % 4 == 0, "").otherwise(F.sha2("text", 256)).alias("sha256"), (key % 2 == 0).alias("required"),
        F.when(there, F.octet_length("text").cast("long")).alias("actual_size"), F.when(there, F.sha2("text", 256)).alias("actual_sha"),
    )
    return packs.pack_validity(packs.file_errors(files)).select("pack_id", "n_files", "n_errors", "first_error", "valid")


def pack_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as packed files with all kinds of faults, counted by fault."""
    c = F.col
    names = F.array(*map(F.lit, [*packs.CAPABILITIES, "translate"]))
    provided = F.array_compact(F.array(F.when(c("l_linenumber") % 3 != 0, "CPUExecutionProvider"), F.when(c("l_orderkey") % 5 == 0, "CUDAExecutionProvider"), F.when(c("l_orderkey") % 17 == 0, "OtherProvider")))
    files = table(spark, sf_dir, "lineitem").select(
        F.get(names, (c("l_partkey") % 10).cast("int")).alias("capability"), F.when(c("l_orderkey") % 31 == 0, "").when(c("l_orderkey") % 29 == 0, "../m.onnx").otherwise("models/m.onnx").alias("filename"), c("l_quantity").cast("long").alias("size"),
        F.when(c("l_returnflag") == "A", "").otherwise(c("l_shipdate").cast("string")).alias("sha256"), provided.alias("providers"),
        F.when(c("l_linestatus") == "O", c("l_quantity").cast("long") + (c("l_linenumber") == 1).cast("int")).alias("actual_size"), F.when(c("l_tax") < 0.06, c("l_shipdate").cast("string")).otherwise("x").alias("actual_sha"),
    )
    files = files.withColumn("root_safe", packs.safe_member(c("filename")))  # once a row, not once a test
    faults = packs.pack_errors(F.col, c("root_safe"), c("actual_size"), c("actual_sha"))
    return files.select(F.explode(faults).alias("fault")).groupBy("fault").agg(F.count("*").alias("files"))


def spec_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON as model specifications: defaults, clamps and faults."""
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k int")["k"]
    text = F.to_json(F.struct(F.when(k % 3 == 0, "NHWC").when(k % 3 == 1, "weird").alias("layout"), (k * 4).alias("tile_size"), (k - 20).alias("overlap"), (k / 60.0).alias("blend_strength")))
    kinds = "layout string, colour_order string, input_range string, output_range string, tile_size int, overlap int, blend_strength double"
    read = e.select("event_id", "event_type", text.alias("json")).select("*", F.from_json("json", kinds).alias("raw"))
    parsed = read.select("event_id", packs.spec(F.col("json")).alias("s"), packs.spec_errors(lambda n: F.col("raw")[n], F.when(F.col("event_type") == "click", "face_recovery").otherwise("denoise")).alias("faults"))
    return parsed.select("event_id", F.col("s.layout").alias("layout"), F.col("s.tile_size").alias("tile_size"), F.col("s.overlap").alias("overlap"), F.round("s.blend_strength", 6).alias("blend_strength"), F.concat_ws(",", "faults").alias("faults"))


def service_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as replies of an image service: parsed, exploded, decoded; items without data are left out, at most four asked for."""
    t = table(spark, sf_dir, "conversations")
    item = F.struct(F.when(F.col("turn") % 3 != 2, F.base64(F.col("text").cast("binary"))).alias("b64_json"), F.col("turn"))
    replies = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", item.alias("item")))).alias("items"))
    payload = F.to_json(F.struct(F.transform("items", lambda x: x["item"]).alias("data")))
    parsed = replies.select("conv_id", F.from_json(payload, "data array<struct<b64_json: string, turn: bigint>>")["data"].alias("data"))
    images = parsed.select("conv_id", F.explode("data").alias("d")).where("d.b64_json is not null and d.b64_json <> ''")
    out = images.select("conv_id", F.unbase64("d.b64_json").alias("raw")).groupBy("conv_id").agg(F.count("*").alias("images"), F.sum(F.octet_length("raw")).alias("bytes"))
    return out.select("conv_id", "images", "bytes", F.greatest(F.lit(1), F.least(F.col("images"), F.lit(4))).cast("long").alias("asked"))


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses as source files: which are photographs, and where their enhanced copies go."""
    kinds = F.array(*map(F.lit, [".JPG", ".png", ".gif", ".jpeg", ".txt", ".Tiff", "", ".webp"]))
    path = F.concat(F.lit("/photos/"), F.regexp_replace("url", r"^[a-z]+://", ""), F.lit("/im"), F.col("page_id").cast("string"), F.get(kinds, (F.col("page_id") % 8).cast("int")))
    df = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return df.select("page_id", rasters.supported(F.col("path")).alias("supported"), rasters.output_path(F.col("path")).alias("beside"), rasters.output_path(F.col("path"), F.lit("/photos")).alias("below_root"))


def mode_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests in old and new names of modes, with the strength of finish that follows."""
    names = F.array(*map(F.lit, [*rules.MODE_ALIASES, "Auto Enhance", "Advanced"]))
    finish = F.get(F.array(F.lit("Natural Finish"), F.lit("Professional Finish"), F.lit("Maximum Recovery")), (F.col("event_id") % 3).cast("int"))
    df = table(spark, sf_dir, "events").select("event_id", rules.mode_name(F.get(names, (F.col("user_id") % 12).cast("int"))).alias("mode"), finish.alias("finish"))
    return df.groupBy("mode", rules.finish_strength(F.col("finish"), F.col("mode")).alias("strength")).agg(F.count("*").alias("requests"))


def straighten_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizon angles from line segments, and whether a photo is straightened."""
    angles = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: ((F.col("vec_id") * 37 + k * 53) % 720).cast("double") / 4 - 90)
    df = table(spark, sf_dir, "embeddings").select("vec_id", rules.horizon(angles).alias("angle"))
    return df.select(F.col("vec_id").alias("photo_id"), R("angle"), rules.straightens(F.col("angle"), F.col("vec_id") % 4 == 0, F.col("vec_id") % 5 != 0).alias("straightens"))


def screenshot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band statistics of 24 x 24 rasters as those of a phone screenshot."""
    px = F.col("px")
    top, middle, bottom = F.slice(px, 1, 72), F.slice(px, 73, 384), F.slice(px, 457, 120)
    df = rasters.tiled_rasters(spark, sf_dir)
    edges = lambda part: P.share(part, lambda x: x > 170) * 100.0
    social = rules.ui_social_score(edges(top), edges(bottom), P.deviation(top), P.deviation(bottom), P.mean(top), P.mean(middle), P.mean(bottom), F.lit(24) + (F.col("photo_id") % 3 * 10).cast("int"), F.lit(24))
    df = df.withColumns({"social": F.round(social, 6), "text_edge": F.round(edges(px), 6)})
    return df.select("photo_id", "social", "text_edge", rules.is_screenshot(F.lit(24) + (F.col("photo_id") % 3 * 10).cast("int"), F.lit(24), F.col("text_edge"), F.col("social")).alias("is_screenshot"))


def crop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screenshots cut to the rows between the strategies' shares."""
    df = rasters.tiled_rasters(spark, sf_dir)
    out = df.join(F.broadcast(candidates.strategies(spark)))
    kept = candidates.crop_rows(F.col("px"), 24, 24, F.col("crop_top"), F.col("crop_bottom"))
    return out.select("photo_id", "strategy", F.size(kept).cast("long").alias("pixels"), P.total(kept).alias("level_sum"))


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of photos of many sizes, counted and measured by photo."""
    sizes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id"), (200 + F.col("vec_id") % 13 * 50).cast("int").alias("height"), (300 + F.col("vec_id") % 7 * 90).cast("int").alias("width"))
    overlap, step = tiles.step_of(256, 32)
    grid = tiles.grid(sizes, 256, step)
    return grid.groupBy("photo_id").agg(F.count("*").alias("tiles"), F.sum((F.col("y1") - F.col("y")) * (F.col("x1") - F.col("x"))).alias("pixels"), F.max("y").cast("long").alias("last_y"))


def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 rasters in 4 x 4 tiles of step 3, each tile's values raised by its place, added up by weight."""
    r = rasters.small_rasters(spark, sf_dir).withColumns({"height": F.lit(8), "width": F.lit(8)})
    cells = tiles.grid(r, 4, 3).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("y1") - F.col("y")) * (F.col("x1") - F.col("x")) - 1)))
    wide, tall = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    py, px = (F.col("k") / wide).cast("int"), F.col("k") % wide
    value = F.get("px", (F.col("y") + py) * 8 + F.col("x") + px) + F.col("y") + F.col("x")
    patches = cells.select("photo_id", (F.col("y") + py).alias("oy"), (F.col("x") + px).alias("ox"), value.alias("value"), tiles.weight(py, px, tall, wide, 1).alias("weight"))
    done = tiles.overlap_add(patches.withColumnsRenamed({"oy": "y", "ox": "x"}))
    return done.groupBy("photo_id").agg(F.count("*").alias("pixels"), F.sum("value").alias("level_sum"), F.max("value").cast("long").alias("largest"))


def encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels through each model number range and back."""
    r = rasters.small_rasters(spark, sf_dir)
    kind = F.get(F.array(*map(F.lit, packs.RANGES)), (F.col("photo_id") % 3).cast("int"))
    df = r.withColumn("kind", kind).withColumn("coded", tiles.encode(F.col("px"), F.col("kind"))).withColumn("back", tiles.decode(F.col("coded"), F.col("kind")))
    gap = F.aggregate(F.zip_with("px", "back", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: F.greatest(s, x))
    total = F.aggregate("coded", F.lit(0.0), lambda s, x: s + x)
    return df.select("photo_id", "kind", F.round(total, 4).alias("coded_sum"), (gap <= 1).alias("within_one"))


def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as machines with some providers: how many take which first."""
    k = F.col("c_custkey")
    have = F.array_compact(F.array(F.when(k % 2 == 0, "CPUExecutionProvider"), F.lit("OtherProvider"), F.when(k % 3 == 0, "DmlExecutionProvider"), F.when(k % 7 == 0, "CUDAExecutionProvider")))
    df = table(spark, sf_dir, "customer").select(packs.preferred_providers(have).alias("usable"))
    return df.groupBy(F.coalesce(F.get("usable", F.lit(0)), F.lit("none")).alias("provider"), F.size("usable").cast("long").alias("usable")).agg(F.count("*").alias("machines"))


def enhanced_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over 8 x 8 colour rasters, with faces by id, the profiles that fit and a horizon; pixels come back as a digest."""
    from rasterflow.plans import enhance as plan

    r = rasters.colour_rasters(spark, sf_dir)
    key = F.col("photo_id")
    box = F.struct((key % 3).cast("int").alias("x"), (key % 2).cast("int").alias("y"), F.lit(4).alias("w"), F.lit(5).alias("h"))
    df = plan.seen(r, 8, 8).withColumns({
        "faces": F.when(key % 4 == 0, F.array(box)).otherwise(F.array().cast(plan.FACES)),
        "horizon_angle": (key % 25 - 12).cast("double"), "upscale": F.when(key % 10 == 9, "2x").otherwise("none"),
    })
    settings = F.create_map(F.lit("denoise"), F.lit("0.4"), F.lit("shadow_recovery"), F.lit("0.5"), F.lit("detail_recovery"), F.lit("0.3"), F.lit("colour"), F.lit("0.2"))
    profiles = spark.createDataFrame(PROFILES, "profile_order int, pack_id string, pack_type string, scene_hints array<string>, depends_on array<string>").withColumn("settings", settings)
    judged = plan.with_profiles(plan.judged(df), profiles, F.array(F.lit("auto-restoration-core"), F.lit("auto-heritage")))
    done = plan.finished(judged, "Professional")
    kept = F.concat_ws(",", F.transform(F.filter("steps", lambda s: s.applied), lambda s: s.step)).alias("applied")
    return done.select("photo_id", "plan_name", "ordinal", "n_steps", R("before", 3), R("after", 3), "quality_accepted", "safe", "review_needed", "faces_protected", "height", "width", kept, F.sha2("data", 256).alias("data_sha256"))


QUERIES = {f.__name__: f for f in (
    raster_tone, raster_focus, raster_blockiness, raster_dynamic_range, raster_colour, raster_gradients, low_light_gate, quality_scores, review_reasons, scene_rollup, problem_list, plan_stages,
    capability_request, capability_counts, exact_duplicates, signature_bits, near_pairs, duplicate_groups, best_of_group, strategy_accept, pair_correlation, post_validation, candidate_rank, review_flag,
    batch_counters, batch_totals, report_rows, face_profiles, face_summary, face_similarity, profile_outcomes, capability_resolution, manifest_validation, pack_lint, spec_parse, service_response, output_paths,
    mode_names, straighten_plan, screenshot_score, crop_rows, tile_grid, overlap_add, encode_decode, provider_choice, enhanced_photos,
    duplicate_outputs, dead_letters, source_index, profile_messages, pack_duplicates, installed_map, capability_steps, spec_priority, spec_types, layouts,
)}
