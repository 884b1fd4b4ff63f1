"""Report rows, counters and outputs per collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rasterflow.sources import files, rasters

#: Columns of the report, in order.
COLUMNS = ["filename", "quality_score", "scene", "blur_score", "brightness", "dark_fraction", "clipped_highlights", "contrast", "noise_score", "face_count", "horizon_angle", "review_reason"]


def rows(analysed: DataFrame) -> DataFrame:
    """Report rows: two digits for levels, four for shares."""
    return analysed.select(
        "filename", "quality_score", "scene", F.bround("blur", 2).alias("blur_score"), F.bround("brightness", 2).alias("brightness"), F.bround("dark_35", 4).alias("dark_fraction"),
        F.bround("light_250", 4).alias("clipped_highlights"), F.bround("contrast", 2).alias("contrast"), F.bround("noise", 2).alias("noise_score"), "face_count", F.bround("horizon_angle", 2).alias("horizon_angle"),
        F.concat_ws(", ", "reasons").alias("review_reason"),
    )


def write_reports(report: DataFrame, folder: str, root: str = "root") -> None:
    """One CSV part set per output root; nothing is written for a root without rows."""
    report.write.mode("overwrite").partitionBy(root).option("header", "true").csv(folder)


def write_single(report: DataFrame, folder: str, name: str = "Photo Report.csv", root: str | None = None) -> None:
    """One UTF-8 file with a byte-order mark, or one in the folder of each root; no file without rows. The task that writes a file keeps a row at a time."""
    rooted = report.select(*COLUMNS, (F.col(root) if root else F.lit("")).alias("root"))
    files.write_reports(rooted, folder, "root", "filename", name)


def counters(results: DataFrame) -> DataFrame:
    """completed, review (failed ones included) and failed of a batch; results: review_needed, error (null if none)."""
    ok = F.col("error").isNull()
    return results.agg(F.count_if(ok).alias("completed"), F.count_if(~ok | F.col("review_needed")).alias("review"), F.count_if(~ok).alias("failed"))


def write_outcomes(results: DataFrame, members: DataFrame, folder: str) -> dict[str, int]:
    """Writes the outcomes of a batch and the members of its duplicate groups below folder; completed, review, failed and duplicates as these very passes saw them.

    results: as for ``counters``; members: see ``dedupe.groups``, of which each but a group's first is a duplicate. The counters are observed where rows go into
    files, in the job's last stage, so nothing is scanned again, and a task that is tried twice counts once."""
    ok = F.col("error").isNull()
    seen, copied = Observation(), Observation()
    batch = results.observe(seen, F.count_if(ok).alias("completed"), F.count_if(~ok | F.col("review_needed")).alias("review"), F.count_if(~ok).alias("failed"))
    batch.write.parquet(f"{folder.rstrip('/')}/outcomes")
    members.observe(copied, F.count_if(F.col("position") > 0).alias("duplicates")).write.parquet(f"{folder.rstrip('/')}/duplicates")
    return seen.get | copied.get


def split_errors(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) of an outcome column error."""
    return results.where(F.col("error").isNull()).drop("error"), results.where(F.col("error").isNotNull())


def error_files(failed: DataFrame) -> DataFrame:
    """Adds error_file, the file below the output folder that takes a failed photo's message; path: the source."""
    return failed.withColumn("error_file", F.concat(F.lit("Review Needed/"), rasters.stem(F.col("path")), F.lit("_ERROR.txt")))


def review_files(photos: DataFrame) -> DataFrame:
    """Adds review_file, details_file and details of photos for review (path, image_type, plan_name, problems, stages)."""
    base = F.concat(F.lit("Review Needed/"), rasters.stem(F.col("path")), F.lit("_enhanced"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    # fixed values: the words before each part
    lines = F.array_compact(F.array(
        F.concat(F.lit("["), name, F.lit("]")), F.concat(F.lit("Detected: "), "image_type"), F.concat(F.lit("Pipeline: "), "plan_name"),
        F.when(F.size("problems") > 0, F.concat(F.lit("Problems: "), F.concat_ws(", ", "problems"))), F.concat(F.lit("Stages: "), F.concat_ws(" \u2192 ", "stages")),
    ))
    return photos.withColumns({"review_file": F.concat(base, F.lit(".jpg")), "details_file": F.concat(base, F.lit(".txt")), "details": F.array_join(lines, "\n")})
