import json

from pyspark.sql import functions as F

from rasterflow.operators import packs, reports
from rasterflow.sources import rasters


def put(root, pack, name, payload):
    (root / pack).mkdir(exist_ok=True)
    (root / pack / name).write_text(payload if isinstance(payload, str) else json.dumps(payload))


def test_manifests_profiles_and_ids(spark, tmp_path):
    put(tmp_path, "a", "manifest.json", {"pack_id": "a", "name": "A", "version": "1", "files": [{"capability": "denoise", "filename": "m.onnx", "sha256": "ABC"}]})
    put(tmp_path, "b", "manifest.json", "{ broken")
    put(tmp_path, "a", "profile.json", {"pack_id": "other", "pack_type": "processing-profile", "name": "A", "scene_hints": ["Low"]})
    put(tmp_path, "c", "profile.json", {"pack_id": "c", "pack_type": "hybrid-core", "name": "C"})
    put(tmp_path, "d", "profile.json", {"pack_id": "d", "pack_type": "unknown"})
    put(tmp_path, "e", "profile.json", "nothing")
    found = packs.read_manifests(spark, str(tmp_path)).collect()
    assert [(r.directory, r.pack_id, r.corrupt, r.minimum_app_version) for r in found] == [("a", "a", False, "0.0.0"), ("b", "b", True, "0.0.0")]
    assert found[0].files[0].sha256 == "abc" and found[0].files[0].required and found[0].files[0].size == 0
    profiles = packs.read_profiles(spark, str(tmp_path)).withColumn("directory", F.regexp_extract("path", r"([^/]+)/profile\.json$", 1))
    assert [r.pack_id for r in profiles.collect()] == ["other", "c"]
    ids = packs.installed_ids(packs.read_manifests(spark, str(tmp_path)).where("not corrupt"), profiles)
    assert {r.pack_id for r in ids.collect()} == {"a", "c"}
    written = json.loads(packs.manifest_json(packs.read_manifests(spark, str(tmp_path))).first().json)
    assert written["schema_version"] == 2 and written["files"][0]["capability"] == "denoise"


def test_first_fault_of_each_file(spark):
    rows = [("p", 1, "a", 0, "", True, None, None), ("p", 2, "b", 0, "", False, None, None), ("p", 3, "c", 5, "x", True, 4, "y"), ("p", 4, "d", 0, "x", True, 4, "y"), ("q", 1, "e", 4, "", True, 4, "y")]
    df = spark.createDataFrame(rows, "pack_id string, position int, filename string, size long, sha256 string, required boolean, actual_size long, actual_sha string")
    assert [r.error for r in packs.file_errors(df).orderBy("pack_id", "position").collect()] == ["Missing required model: a", None, "Wrong size for c: expected 5, got 4", "Checksum failed for d", None]
    valid = {r.pack_id: r.valid for r in packs.pack_validity(packs.file_errors(df)).collect()}
    assert valid == {"p": False, "q": True}


def test_core_first_and_two_at_most(spark):
    photos = spark.createDataFrame([(1, "Low Light", "night"), (2, "None", "none")], "photo_id int, image_type string, scene string")
    rows = [(0, "n1", "processing-profile", ["low LIGHT"], []), (1, "n2", "processing-profile", ["night"], ["gone"]), (2, "n3", "processing-profile", ["light"], []), (3, "core", "hybrid-core", [], []), (4, "bare", "processing-profile", [], [])]
    profiles = spark.createDataFrame(rows, "profile_order int, pack_id string, pack_type string, scene_hints array<string>, depends_on array<string>")
    got = {(r.photo_id, r.pack_id): r.outcome for r in packs.choose(packs.match(photos, profiles), "photo_id", F.array(F.lit("core"))).collect()}
    assert got == {(1, "n1"): "applied", (1, "n2"): "missing dependency", (1, "n3"): "limit reached", (1, "core"): "applied", (2, "core"): "applied"}


def test_specifications(spark):
    df = spark.createDataFrame([('{"layout": "NHWC", "tile_size": 5, "overlap": -3, "blend_strength": 7}',), ("{}",)], "j string")
    got = [r.s.asDict() for r in df.select(packs.spec(F.col("j")).alias("s")).collect()]
    assert (got[0]["layout"], got[0]["tile_size"], got[0]["overlap"], got[0]["blend_strength"]) == ("nhwc", 64, 0, 1.0)
    assert (got[1]["layout"], got[1]["colour_order"], got[1]["tile_size"], got[1]["overlap"]) == ("auto", "rgb", 256, 32)
    none = F.lit(None).cast("string")
    pick = packs.spec_by_priority(none, none, F.lit('{"deblur": "{}"}'), F.lit('{"denoise": "{\\"overlap\\": 9}"}'), "denoise")
    assert spark.range(1).select(pick["overlap"].alias("p")).first().p == 32  # a catalogue without the capability ends the search


def test_archive_members(spark):
    names = ["a/b.onnx", "../x", "a/../../x", "a/../b", "/etc/x", "C:\\x", "..\\x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.ok for r in df.select(packs.safe_member(F.col("n")).alias("ok")).collect()] == [True, False, False, True, False, False, False]


def test_capability_lookup(spark):
    files = spark.createDataFrame([("denoise", 2, 0, "late", True, True), ("denoise", 1, 5, "first", True, True), ("denoise", 0, 0, "bad", False, True), ("deblur", 1, 0, "away", True, False)], "capability string, pack_order int, position int, filename string, valid boolean, there boolean")
    asked = spark.createDataFrame([("denoise",), ("deblur",), ("colour",)], "capability string")
    outside = spark.createDataFrame([("deblur.onnx",)], "filename string")
    got = {r.capability: r.filename for r in packs.with_legacy(asked, packs.resolve(files), outside).collect()}
    assert got == {"denoise": "first", "deblur": "deblur.onnx", "colour": None}


def test_paths_and_report(spark, tmp_path):
    df = spark.createDataFrame([("/r/a/x.y.JPG",), ("/r/z.txt",)], "path string")
    got = df.select(rasters.supported(F.col("path")).alias("s"), rasters.output_path(F.col("path")).alias("b"), rasters.output_path(F.col("path"), F.lit("/r")).alias("r")).collect()
    assert tuple(got[0]) == (True, "/r/a/Professionally Enhanced/x.y_enhanced.jpg", "/r/Professionally Enhanced/a/x.y_enhanced.jpg") and not got[1].s
    row = [("f.jpg", 50, "General photo", 1.0, 2.0, 0.1, 0.0, 3.0, 4.0, 0, 0.0, "")]
    report = spark.createDataFrame(row, "filename string, quality_score int, scene string, blur_score double, brightness double, dark_fraction double, clipped_highlights double, contrast double, noise_score double, face_count int, horizon_angle double, review_reason string")
    reports.write_single(report, str(tmp_path / "one"), "r.csv")
    assert (tmp_path / "one" / "r.csv").read_bytes().startswith(b"\xef\xbb\xbffilename,quality_score")
    reports.write_single(report.limit(0), str(tmp_path / "none"), "r.csv")
    assert not (tmp_path / "none" / "r.csv").exists()
    batch = spark.createDataFrame([(True, None), (False, "x"), (False, None)], "review_needed boolean, error string")
    assert tuple(reports.counters(batch).first()) == (2, 2, 1)


def test_catalogue_templates_and_one_pack(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 1, "catalog_version": "2", "packs": [{"pack_id": "a", "name": "A", "capabilities": ["denoise"]}, {"pack_id": "b", "name": "B"}]}))
    assert [(r.pack_order, r.pack_id, r.capabilities) for r in packs.read_catalogue(spark, str(tmp_path / "c.json")).orderBy("pack_order").collect()] == [(0, "a", ["denoise"]), (1, "b", None)]
    (tmp_path / "t.json").write_text(json.dumps({"profile_version": "1", "packs": {"a": {"name": "A", "scene_hints": ["Low"], "settings": {"denoise": 0.5, "lock": True}}}}))
    one = packs.read_templates(spark, str(tmp_path / "t.json")).first()
    assert (one.pack_id, one.scene_hints, one.settings) == ("a", ["Low"], {"denoise": "0.5", "lock": "true"})
    own = tmp_path / "packs"
    own.mkdir()
    put(own, "a", "manifest.json", {"pack_id": "a", "name": "A", "version": "1"})
    put(own, "b", "manifest.json", "{ broken")
    found = packs.read_manifests(spark, str(own))
    errors = spark.createDataFrame([("a", True)], "pack_id string, valid boolean")
    assert [r.valid for n in ("a", "b", "gone") for r in packs.installed(found, errors, n).collect()] == [True, False]


def test_specification_that_is_no_object_is_passed_over(spark):
    none = F.lit(None).cast("string")
    pick = packs.spec_by_priority(F.lit("[1]"), F.lit("{ broken"), F.lit('{"denoise": 5}'), F.lit('{"denoise": {"overlap": 9}}'), "denoise")
    last = packs.spec_by_priority(none, none, F.lit("broken"), none, "denoise")
    row = spark.range(1).select(pick["overlap"].alias("a"), last["overlap"].alias("b")).first()
    assert (row.a, row.b) == (9, 32)


def test_specifications_are_parsed_once(spark):
    s = packs.spec_by_priority(F.lit('{"tile_size": "512"}'), F.col("t"), F.col("t"), F.col("t"), "denoise")
    df = spark.createDataFrame([(1, "{}")], "id int, t string").select(s.alias("s"))
    parsed = df._jdf.queryExecution().analyzed().toString().count("parse_json(")
    assert parsed <= 7  # four files, the catalogues' two defaults and the last one's
    assert df.first().s.tile_size == 512
