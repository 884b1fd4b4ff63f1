"""The sink of files, archives, counters, reports of many roots, typed specifications and tensor layouts."""

import csv
import io
import time
import warnings
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.operators import packs, reports, tiles
from rasterflow.sources import archives, files


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".") and "_staged-" not in str(p)}


def test_files_by_name(spark, tmp_path):
    out = tmp_path / "out put"
    rows = spark.createDataFrame([("a.txt", "one"), ("b/c d.txt", "two"), ("b/e.txt", None), ("\u00e9.txt", "x" * 100_000)], "name string, content string")
    files.write_files(rows.repartition(3), f"file://{out}")
    assert tree(out) == {"a.txt": b"one", "b/c d.txt": b"two", "b/e.txt": b"", "\u00e9.txt": b"x" * 100_000}
    files.write_files(rows.where("name = 'a.txt'").withColumn("content", F.lit("new")), str(out))  # a later run's file takes the place of the earlier one's
    assert tree(out)["a.txt"] == b"new" and len(tree(out)) == 4
    files.write_files(rows.limit(0), f"file://{tmp_path}/none")
    assert tree(tmp_path / "none") == {}


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    for bad in ("../up.txt", "/root.txt", "", None):
        rows = spark.createDataFrame([(f"f{k}.txt", "x") for k in range(40)] + [(bad, "x")], "name string, content string")
        out = tmp_path / f"out{len(bad or '')}{bad is None}"
        with pytest.raises(Exception, match="not a name"):
            files.write_files(rows.repartition(8), f"file://{out}")
        time.sleep(1)  # tasks that were still running
        assert tree(out) == {}
    twice = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "name string, content string").coalesce(1)
    with pytest.raises(Exception, match="follow each other"):
        files.write_files(twice, f"file://{tmp_path}/twice")
    time.sleep(1)
    assert tree(tmp_path / "twice") == {}


def test_archives_are_listed_and_unpacked(spark, tmp_path):
    source, big = tmp_path / "packs", bytes(range(256)) * 40_000
    (source / "deep er").mkdir(parents=True)

    def pack(name, *members):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # of names that come twice
            with zipfile.ZipFile(source / name, "w", zipfile.ZIP_DEFLATED) as z:
                for n, content in members:
                    z.writestr(n, content)

    pack("good.zip", ("manifest.json", "{}"), ("models/", ""), ("models/m.onnx", big), ("models/empty", b""), ("models/../side.txt", "x"), ("manifest.json", "{1}"))
    for k, bad in enumerate(("../up", "a/../../up", "/root", "C:/x", "a\\\\..\\\\..\\\\x")):
        pack(f"bad{k}.zip", ("fine", "1"), (bad, "2"))
    pack("deep er/many.ZIP", *[(f"d{k % 7}/f{k}", str(k)) for k in range(10_000)])
    pack("none.zip")
    (source / "torn.zip").write_bytes((source / "good.zip").read_bytes()[:-30])
    (source / "note.txt").write_text("no archive")
    assert archives.members(spark, f"file://{source}").where("archive = 'good.zip'").orderBy("position").select("member", "size", "is_folder").collect()[:3] == [("manifest.json", 2, False), ("models/", 0, True), ("models/m.onnx", len(big), False)]
    out = tmp_path / "out"
    got = {r.archive: r for r in packs.unpack_archives(spark, f"file://{source}", f"file://{out}").collect()}
    assert len(got) == 9 and {k for k, r in got.items() if r.ready} == {"good.zip", "deep er/many.ZIP", "none.zip"}
    assert got["torn.zip"].fault.startswith("unreadable") and got["torn.zip"].members == 0 and got["none.zip"].members == 0
    assert {(r.unsafe, r.members) for k, r in got.items() if k.startswith("bad")} == {(1, 2)} and got["bad0.zip"].fault == "unsafe path in archive: ../up"
    found = tree(out)
    assert {k: v for k, v in found.items() if k.startswith("good/")} == {"good/manifest.json": b"{1}", "good/models/m.onnx": big, "good/models/empty": b"", "good/side.txt": b"x"}
    assert len(found) == 10_004 and found["deep er/many/d3/f9999"] == b"9999"
    (tmp_path / "bare").mkdir()
    assert packs.unpack_archives(spark, f"file://{tmp_path}/bare", f"file://{tmp_path}/o2").count() == 0


def test_counters_of_the_writing_pass(spark, tmp_path):
    results = spark.createDataFrame([(k, None if k % 5 else "bad", k % 3 == 0) for k in range(60)], "photo_id long, error string, review_needed boolean").repartition(6)
    members = spark.createDataFrame([(1, 0, 3), (1, 1, 4), (2, 0, 5), (2, 1, 6), (2, 2, 7)], "group long, position int, ord long")
    got = reports.write_outcomes(results, members, f"file://{tmp_path}/o")
    assert got == {"completed": 48, "review": 28, "failed": 12, "duplicates": 3} and got == got | reports.counters(results).first().asDict()
    assert spark.read.parquet(f"file://{tmp_path}/o/outcomes").count() == 60
    assert reports.write_outcomes(results.limit(0), members.limit(0), f"file://{tmp_path}/none") == dict.fromkeys(got, 0)


def test_reports_of_roots(spark, tmp_path):
    rows = [(f"r{k % 3}" if k % 3 else "", k, f'say "{k}", yes', None if k % 2 else k / 4) for k in range(200)]
    files.write_reports(spark.createDataFrame(rows, "root string, k int, text string, v double").repartition(7), f"file://{tmp_path}/o", "root", "k", "Report.csv")
    found = tree(tmp_path / "o")
    assert set(found) == {"Report.csv", "r1/Report.csv", "r2/Report.csv"}
    for name, raw in found.items():
        assert raw.startswith(b"\xef\xbb\xbfk,text,v\r\n")
        got = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))[1:]
        want = [r[1:] for r in rows if r[0] == name.rpartition("/")[0]]
        assert got == [[str(k), t, "" if v is None else str(v)] for k, t, v in want]


def test_values_of_the_wrong_type_pass_on(spark):
    def tile(side, plain=None, near=None, far=None):
        one = lambda t: F.lit(t).cast("string")
        return spark.range(1).select(packs.spec_by_priority(one(side), one(plain), one(near), one(far), "denoise")["tile_size"].alias("t")).first().t

    assert tile('{"tile_size": "512"}') == 512 and tile('{"tile_size": 99.9}') == 99 and tile('{"tile_size": true}') == 64 and tile('{"tile_size": " 1_000 "}') == 1000
    for bad in ('{"tile_size": "x"}', '{"tile_size": null}', '{"overlap": []}', '{"blend_strength": {}}', "[]", "5", "{", ""):
        assert tile(bad, '{"tile_size": 70}') == 70, bad
    assert tile(None, None, '{"denoise": 5}', '{"denoise": {"tile_size": 80}}') == 80
    assert tile(None, None, "{}", '{"denoise": {"tile_size": 80}}') == 256 == tile(None)
    s = spark.range(1).select(packs.typed_spec(F.parse_json(F.lit('{"layout": "NCHW", "input_name": 7, "preserve_size": "false", "blend_strength": "2", "output_range": null}'))).alias("s")).first().s
    assert (s.layout, s.input_name, s.preserve_size, s.blend_strength, s.output_range, s.overlap) == ("nchw", "7", True, 1.0, "none", 32)


@pytest.mark.parametrize("order", ["bgr", "rgb"])
@pytest.mark.parametrize("layout", ["nchw", "nhwc"])
def test_layouts_and_back(spark, layout, order):
    img = np.random.default_rng(2).integers(0, 256, (5, 7, 3))
    b, g, r = (img[..., k].ravel().tolist() for k in range(3))
    df = spark.createDataFrame([(b, g, r)], "b array<int>, g array<int>, r array<int>").withColumn("t", tiles.tensor(F.col("b"), F.col("g"), F.col("r"), F.lit(layout), F.lit(order)))
    row = df.select("t", tiles.planes(F.col("t"), F.lit(layout), F.lit(order)).alias("p")).first()
    want = img if order == "bgr" else img[..., ::-1]
    assert row.t == (want.transpose(2, 0, 1) if layout == "nchw" else want).ravel().tolist()
    assert (row.p.b, row.p.g, row.p.r) == (b, g, r)
