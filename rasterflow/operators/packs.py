"""Plug-in packs: manifests, checksums, dependencies, capability lookup, profiles and model specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterflow.functions.pixels import once
from rasterflow.functions.sharing import stored
from rasterflow.operators.rules import listed
from rasterflow.sources import archives, files

FILE = "capability string, filename string, sha256 string, size bigint, providers array<string>, required boolean"
MANIFEST = f"schema_version int, pack_id string, name string, version string, minimum_app_version string, archive_url string, archive_sha256 string, files array<struct<{FILE.replace(' string', ': string').replace(' bigint', ': bigint').replace(' array', ': array').replace(' boolean', ': boolean')}>>"
PROFILE = "pack_type string, pack_id string, name string, scene_hints array<string>, depends_on array<string>, settings map<string, string>"
#: File names of models that stand outside packs.
LEGACY = {
    "super_resolution": "super_resolution_x2.onnx",
    "jpeg_repair": "jpeg_repair.onnx",
    "deblur": "deblur.onnx",
    "denoise": "denoise.onnx",
    "face_protect": "face_protect.onnx",
    "face_recovery": "face_recovery.onnx",
    "colour": "colour.onnx",
    "lighting": "lighting.onnx",
    "inpaint": "inpaint.onnx",
}
#: What a pack may name.
CAPABILITIES = tuple(LEGACY)
PROVIDERS = ("CUDAExecutionProvider", "DmlExecutionProvider", "CPUExecutionProvider")
LAYOUTS = ("auto", "nchw", "nhwc")
COLOURS = ("rgb", "bgr", "gray", "grey", "y")
RANGES = ("zero_one", "minus_one_one", "zero_255")
PROFILE_TYPES = ("processing-profile", "hybrid-core")


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """A row per pack folder with a manifest, in folder order; a manifest that can't be read is a row with corrupt = true and the folder's name as id."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").schema(MANIFEST + ", _corrupt string").json(folder)
    found = raw.withColumn("directory", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/manifest\.json$", 1))
    bad = F.col("_corrupt").isNotNull() | F.col("pack_id").isNull() | F.col("name").isNull() | F.col("version").isNull()
    return defaults(found.withColumn("corrupt", bad)).drop("_corrupt").orderBy("directory")


def defaults(manifests: DataFrame) -> DataFrame:
    """Missing values as readers take them: empty texts, version 0.0.0, size 0, files required, hashes in lower case."""
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d))
    files = F.transform(F.coalesce("files", F.array().cast(f"array<struct<{_pairs(FILE)}>>")), lambda f: F.struct(f["capability"].alias("capability"), f["filename"].alias("filename"), F.lower(F.coalesce(f["sha256"], F.lit(""))).alias("sha256"), F.coalesce(f["size"], F.lit(0)).cast("long").alias("size"), F.coalesce(f["providers"], F.array().cast("array<string>")).alias("providers"), F.coalesce(f["required"], F.lit(True)).alias("required")))
    return manifests.withColumns({
        "pack_id": F.when(F.col("corrupt"), F.col("directory")).otherwise(F.col("pack_id")), "name": F.when(F.col("corrupt"), F.col("directory")).otherwise(F.col("name")), "version": F.when(F.col("corrupt"), "0.0.0").otherwise(F.col("version")),
        "minimum_app_version": text("minimum_app_version", "0.0.0"), "archive_url": text("archive_url"), "archive_sha256": F.lower(text("archive_sha256")), "files": files,
    })


def _pairs(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in ddl.split(", ")))


def manifest_json(manifests: DataFrame) -> DataFrame:
    """Adds json, the manifest as it is written (schema version 2)."""
    names = ["pack_id", "name", "version", "minimum_app_version", "archive_url", "archive_sha256", "files"]
    return manifests.withColumn("json", F.to_json(F.struct(F.lit(2).alias("schema_version"), *names)))


def read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The packs' profiles of known types, in folder order; what can't be read is left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "profile.json").option("multiLine", "true").option("mode", "DROPMALFORMED").schema(PROFILE).json(folder)
    return raw.withColumn("path", F.col("_metadata.file_path")).where(F.col("pack_type").isin(*PROFILE_TYPES)).orderBy("path")


def installed_ids(manifests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Distinct pack ids: a folder's manifest gives it, else its profile. Both need directory and pack_id."""
    named = lambda df: df.select("directory", F.nullif(F.trim("pack_id"), F.lit("")).alias("pack_id"))
    both = named(manifests).withColumnRenamed("pack_id", "first").join(named(profiles).withColumnRenamed("pack_id", "second"), "directory", "full")
    return both.select(F.coalesce("first", "second").alias("pack_id")).dropna().distinct()


def file_errors(files: DataFrame) -> DataFrame:
    """Per file of a manifest joined to what is there (actual_size and actual_sha null if missing): the first fault in order of cost."""
    missing = F.col("actual_size").isNull()
    return files.withColumn("error", F.when(missing, F.when(F.col("required"), F.concat(F.lit("Missing required model: "), "filename")))
        .when((F.col("size") != 0) & (F.col("actual_size") != F.col("size")), F.concat(F.lit("Wrong size for "), "filename", F.lit(": expected "), F.col("size").cast("string"), F.lit(", got "), F.col("actual_size").cast("string")))
        .when((F.col("sha256") != "") & (F.col("actual_sha") != F.col("sha256")), F.concat(F.lit("Checksum failed for "), "filename")))


def pack_validity(errors: DataFrame) -> DataFrame:
    """Per pack: number of faulty files, the first fault in file order, valid."""
    return errors.groupBy("pack_id").agg(F.count("error").alias("n_errors"), F.min(F.when(F.col("error").isNotNull(), F.struct("position", "error")))["error"].alias("first_error"), F.count("*").alias("n_files")).withColumn("valid", F.col("n_errors") == 0)


def duplicate_capabilities(files: DataFrame) -> DataFrame:
    """Capabilities that a pack names more than once."""
    return files.groupBy("pack_id", "capability").agg(F.count("*").alias("n")).where("n > 1")


def resolve(files: DataFrame) -> DataFrame:
    """The first file there is of a valid pack for each capability, by pack order and then position. A partial minimum goes through the shuffle, no list."""
    there = files.where(F.col("valid") & F.col("there"))
    return there.groupBy("capability").agg(F.min(F.struct("pack_order", "position", "filename")).alias("first")).select("capability", "first.pack_order", "first.filename")


def with_legacy(capabilities: DataFrame, resolved: DataFrame, outside: DataFrame) -> DataFrame:
    """Each capability's file: a pack's, else the legacy file if it is there. outside: filename."""
    names = F.create_map(*[F.lit(x) for pair in LEGACY.items() for x in pair])
    left = capabilities.join(resolved.select("capability", F.col("filename").alias("from_pack")), "capability", "left").withColumn("legacy", F.try_element_at(names, F.col("capability")))
    there = outside.select(F.col("filename").alias("legacy"), F.lit(True).alias("there"))
    return left.join(there, "legacy", "left").select("capability", F.coalesce("from_pack", F.when(F.col("there"), F.col("legacy"))).alias("filename"))


def match(photos: DataFrame, profiles: DataFrame) -> DataFrame:
    """Photos x profiles that fit: a hint lies in the photo's type and scene (any case); without hints only core packs fit. profiles: a table of fixed size."""
    hay = F.lower(F.concat_ws(" ", "image_type", "scene"))
    fits = F.when(F.size("scene_hints") == 0, F.col("pack_type") == "hybrid-core").otherwise(F.exists("scene_hints", lambda h: F.contains(hay, F.lower(h))))
    return photos.join(F.broadcast(profiles), fits)


def choose(matched: DataFrame, key: str, installed: Column, limit: int = 2) -> DataFrame:
    """Outcome per photo and fitting profile: missing dependencies don't take one of the limit's places; core packs come first, then profile order."""
    ready = matched.withColumn("missing", F.array_except("depends_on", installed))
    order = Window.partitionBy(key, F.size("missing") == 0).orderBy((F.col("pack_type") == "hybrid-core").desc(), "profile_order")
    place = F.row_number().over(order)
    return ready.withColumn("outcome", F.when(F.size("missing") > 0, "missing dependency").when(place <= limit, "applied").otherwise("limit reached"))


def step_messages(chosen: DataFrame, key: str) -> DataFrame:
    """key, place (from 0), step and message: a photo's applied profiles beside its messages by position.

    Messages of profiles that were passed over count as well, so a step may stand beside another one's message. A photo
    has at most one row per profile, so its lists are short."""
    name = F.col("pack_id")
    # fixed values: the messages' words
    message = F.when(F.size("missing") > 0, F.concat(F.lit("Skipped "), name, F.lit(": install "), F.concat_ws(", ", "missing"), F.lit(" first"))).when(F.col("outcome") == "applied", F.concat(F.lit("Applied installed profile: "), name)).otherwise(F.concat(F.lit("Skipped "), name, F.lit(": safe profile stacking limit reached")))
    row = F.struct((F.col("pack_type") != "hybrid-core").alias("late"), "profile_order", "pack_id", (F.col("outcome") == "applied").alias("applied"), message.alias("message"))
    told = chosen.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("told"))
    applied = F.filter("told", lambda t: t["applied"])
    pairs = F.transform(applied, lambda t, k: F.struct(F.concat(F.lit("profile:"), t["pack_id"]).alias("step"), F.get(F.col("told"), k)["message"].alias("message")))
    return told.select(key, F.posexplode(pairs).alias("at", "pair")).select(key, F.col("at").cast("long").alias("place"), "pair.step", "pair.message")


def capability_map(found: DataFrame) -> DataFrame:
    """One row with models, a map of capability to filename for those that have one; found: a row for each of the nine names."""
    return found.where(F.col("filename").isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct("capability", "filename"))).alias("models"))


def installed(manifests: DataFrame, errors: DataFrame, pack_id: str) -> DataFrame:
    """The pack of this id with valid, or no row if it isn't there; an unreadable manifest is invalid. errors: pack_validity."""
    one = manifests.where(F.col("directory") == pack_id)
    return one.join(errors.select("pack_id", F.col("valid").alias("files_valid")), "pack_id", "left").withColumn("valid", ~F.col("corrupt") & F.coalesce("files_valid", F.lit(True))).drop("files_valid")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A row per pack of a catalogue file, in its order."""
    pack = "pack_id: string, name: string, version: string, status: string, description: string, capabilities: array<string>, neural_capabilities: array<string>, profile_capabilities: array<string>, release_tag: string"
    raw = spark.read.option("multiLine", "true").schema(f"schema_version int, catalog_version string, packs array<struct<{pack}>>").json(path)
    return raw.select("catalog_version", F.posexplode("packs").alias("pack_order", "p")).select("catalog_version", "pack_order", "p.*")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """A row per pack of a file of profile templates; settings as texts."""
    template = "name: string, description: string, scene_hints: array<string>, capabilities: array<string>, depends_on: array<string>, settings: map<string, string>"
    raw = spark.read.option("multiLine", "true").schema(f"schema_version int, profile_version string, packs map<string, struct<{template}>>").json(path)
    return raw.select("profile_version", F.explode("packs").alias("pack_id", "t")).select("profile_version", "pack_id", "t.*")


def spec(json_text: Column) -> Column:
    """A model specification with defaults and clamps: lower-cased names, tile 64 or more, overlap 0 or more, blend 0 .. 1."""
    kinds = "layout string, colour_order string, input_range string, output_range string, input_name string, output_name string, tile_size int, overlap int, preserve_size boolean, blend_strength double"
    return once(F.from_json(json_text, kinds), _spec_fields)


def _spec_fields(raw: Column) -> Column:
    text = lambda n, d: F.lower(F.coalesce(raw[n], F.lit(d))).alias(n)
    return F.struct(
        text("layout", "auto"), text("colour_order", "rgb"), text("input_range", "zero_one"), text("output_range", "zero_one"),
        F.coalesce(raw["input_name"], F.lit("")).alias("input_name"), F.coalesce(raw["output_name"], F.lit("")).alias("output_name"),
        F.greatest(F.lit(64), F.coalesce(raw["tile_size"], F.lit(256))).alias("tile_size"), F.greatest(F.lit(0), F.coalesce(raw["overlap"], F.lit(32))).alias("overlap"),
        F.coalesce(raw["preserve_size"], F.lit(False)).alias("preserve_size"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(raw["blend_strength"], F.lit(1.0)))).alias("blend_strength"),
    )


_WHOLE, _NUMBER = r"^\s*[+-]?\d(_?\d)*\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def typed_spec(document: Column) -> Column:
    """A specification from a document (VARIANT) as its reader takes it, null where it takes none.

    Names take any value as text. Numbers may be whole, broken (cut where a whole one is wanted), true or false, or texts of
    numbers; any other value, JSON's null too, makes the document invalid, as does a document that isn't an object. What is absent has its default.
    The document is parsed once for all of its fields, and a field's kind is found once."""
    return once(document, _typed_fields)


def _typed_fields(document: Column) -> Column:
    def field(name):
        return F.try_variant_get(document, f"$.{name}", "variant")

    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    as_type = lambda v, t: F.try_variant_get(v, "$", t)

    def number(name, default, target, shape):
        def told(plain):
            return F.struct(plain.isNotNull().alias("valid"), F.coalesce(plain, F.lit(default).cast(target)).alias("value"))

        def use(v):
            text = F.when(as_type(v, "string").rlike(shape), F.replace(F.trim(as_type(v, "string")), F.lit("_"), F.lit("")))
            plain = once(kind(v), lambda k: F.when(k == "STRING", text.try_cast(target)).when(k == "BOOLEAN", as_type(v, "boolean").cast("int").cast(target)).when(k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), as_type(v, "double").try_cast(target)))
            return F.when(v.isNull(), told(F.lit(default).cast(target))).otherwise(once(plain, told))

        return once(field(name), use)

    def text(name, default):
        named = lambda v: once(kind(v), lambda k: F.when(k == "VOID", "None").when(k == "BOOLEAN", F.initcap(as_type(v, "string"))).otherwise(as_type(v, "string")))
        return once(field(name), lambda v: F.when(v.isNull(), default).otherwise(named(v)))

    def truth(name):
        empty = lambda v, k: (k == "VOID") | ((k == "BOOLEAN") & ~as_type(v, "boolean")) | ((k == "STRING") & (as_type(v, "string") == "")) | (k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & (as_type(v, "double") == 0)) | F.to_json(v).isin("[]", "{}")
        return once(field(name), lambda v: F.when(v.isNull(), F.lit(False)).otherwise(once(kind(v), lambda k: ~empty(v, k))))

    def whole(numbers):
        low = lambda n, d: F.lower(text(n, d)).alias(n)
        done = F.struct(
            low("layout", "auto"), low("colour_order", "rgb"), low("input_range", "zero_one"), low("output_range", "zero_one"), text("input_name", "").alias("input_name"), text("output_name", "").alias("output_name"),
            F.greatest(F.lit(64), numbers["tile_size"]["value"]).cast("long").alias("tile_size"), F.greatest(F.lit(0), numbers["overlap"]["value"]).cast("long").alias("overlap"),
            truth("preserve_size").alias("preserve_size"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), numbers["blend_strength"]["value"])).alias("blend_strength"),
        )
        return F.when((kind(document) == "OBJECT") & numbers["tile_size"]["valid"] & numbers["overlap"]["valid"] & numbers["blend_strength"]["valid"], done)

    read = F.struct(number("tile_size", 256, "long", _WHOLE).alias("tile_size"), number("overlap", 32, "long", _WHOLE).alias("overlap"), number("blend_strength", 1.0, "double", _NUMBER).alias("blend_strength"))
    return once(read, whole)


def spec_by_priority(sidecar: Column, plain: Column, own_catalogue: Column, parent_catalogue: Column, capability: str) -> Column:
    """The specification that counts of a model's files, given as texts (null: no such file): the sidecar, the plain file, the catalogue
    beside the model, that of the folder above, else the defaults.

    A file that can't be read as JSON or has a value of the wrong type is passed over; a catalogue that lacks the capability gives the defaults."""
    document = lambda text: F.try_parse_json(text)

    def entry(text):
        own = lambda v: F.coalesce(F.try_variant_get(v, f"$.{capability}", "variant"), F.parse_json(F.lit("{}")))
        return once(document(text), lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), own(v)))

    return F.coalesce(typed_spec(document(sidecar)), typed_spec(document(plain)), typed_spec(entry(own_catalogue)), typed_spec(entry(parent_catalogue)), typed_spec(F.parse_json(F.lit("{}"))))


def spec_errors(s, capability: Column) -> Column:
    """What a specification breaks; s(name): its raw columns, null where absent."""
    tile, overlap, blend = F.coalesce(s("tile_size"), F.lit(256)), F.coalesce(s("overlap"), F.lit(32)), F.coalesce(s("blend_strength"), F.lit(1.0))
    named = lambda n, d, allowed: ~F.lower(F.coalesce(s(n), F.lit(d))).isin(*allowed)
    return listed(
        (named("layout", "auto", LAYOUTS), "layout"),
        (named("colour_order", "rgb", COLOURS), "colour_order"),
        (named("input_range", "zero_one", RANGES), "input_range"),
        (named("output_range", "zero_one", RANGES), "output_range"),
        (tile < 64, "tile_size"),
        ((overlap < 0) | (overlap >= F.floor(tile / 2)), "overlap"),
        (~blend.between(0.0, 1.0), "blend_strength"),
        (capability.isin("face_recovery", "face_protect") & (blend > 0.50), "face blend_strength"),
    )


def pack_errors(f, root_safe: Column, actual_size: Column, actual_sha: Column) -> Column:
    """What a packed file breaks; f(name): its columns."""
    there = actual_size.isNotNull()
    unknown = F.array_except(f("providers"), F.array(*map(F.lit, PROVIDERS)))
    checked = root_safe & there & (f("filename") != "")
    return listed(
        (~f("capability").isin(*CAPABILITIES), "unsupported capability"),
        (f("filename") == "", "missing filename"),
        ((f("filename") != "") & ~root_safe, "unsafe filename path"),
        ((f("filename") != "") & root_safe & ~there, "missing model file"),
        (checked & (f("size") != 0) & (actual_size != f("size")), "file size mismatch"),
        (checked & (f("sha256") == ""), "SHA-256 is required"),
        (checked & (f("sha256") != "") & (actual_sha != f("sha256")), "SHA-256 mismatch"),
        (checked & (F.size(f("providers")) == 0), "provider list is required"),
        (checked & (F.size(unknown) > 0), "unsupported providers"),
        (checked & ~F.array_contains(f("providers"), "CPUExecutionProvider"), "CPU fallback is required"),
    )


def safe_member(name: Column) -> Column:
    """Whether an archive member stays below its folder: not absolute, and its .. steps never lead out."""
    parts = F.split(F.regexp_replace(name, r"\\", "/"), "/")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")), lambda s, p: F.struct((s["depth"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("depth"), F.least(s["least"], s["depth"] + F.when(p == "..", -1).otherwise(0)).alias("least")))
    return ~F.startswith(name, F.lit("/")) & ~name.rlike(r"^[A-Za-z]:") & (depth["least"] >= 0)


def archive_faults(members: DataFrame) -> DataFrame:
    """A row per archive of ``archives.members``: its members, unsafe names, bytes and fault; ready where it may be unpacked.

    An archive with a single unsafe name isn't unpacked at all, nor is one that can't be read or holds an encrypted member."""
    told = members.withColumn("safe", safe_member(F.col("member"))).groupBy("archive").agg(
        F.count("member").alias("members"), F.count_if(~F.col("safe")).alias("unsafe"), F.count_if("encrypted").alias("encrypted"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.min_by("member", F.when(~F.col("safe"), F.col("position"))).alias("first_unsafe"), F.max("error").alias("error"),
    )
    fault = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable archive: "), "error")).when(F.col("unsafe") > 0, F.concat(F.lit("unsafe path in archive: "), "first_unsafe"))
        .when(F.col("encrypted") > 0, "encrypted member")
    )
    return told.select("archive", "members", "unsafe", "bytes", fault.alias("fault"), fault.isNull().alias("ready"))


def unpack_archives(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Unpacks the archives below folder that are ready, each into the folder of its own name below out; ``archive_faults`` of all of them.

    Contents go from the task that reads an archive straight to the sink, some megabytes at a time; the job's failure takes all files back."""
    judged = stored(archive_faults(archives.members(spark, folder)))
    ready = judged.where("ready").select("archive").repartition("archive")
    place = F.concat(F.regexp_replace("archive", r"(?i)\.zip$", ""), F.lit("/"), F.col("target"))
    files.write_files(archives.pieces(ready, folder).withColumn("name", place), out)
    return judged


def preferred_providers(available: Column) -> Column:
    """The known providers there are, best first."""
    return F.array_intersect(F.array(*map(F.lit, PROVIDERS)), available)


def steps(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Applied and missing capabilities per photo, in order; available: capability (a table of fixed size)."""
    have = available.agg(F.collect_set("capability").alias("have"))
    return requested.crossJoin(F.broadcast(have)).withColumns({"applied": F.filter("requested", lambda c: F.array_contains("have", c)), "missing": F.filter("requested", lambda c: ~F.array_contains("have", c))}).drop("have")
