"""Whole images of any size: upright pixels, and all measurements in one vectorised pass over each.

``measure`` has the same measurements as column expressions for small rasters; here a row holds an image's bytes, so numpy
looks at each once per Arrow batch. Blur, noise and the horizon are taken from a preview of at most ``PREVIEW`` pixels a side.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.functions import pixels as P
from rasterflow.operators import rules
from rasterflow.operators import transforms as T
from rasterflow.sources import rasters

#: Fixed value: longest side of the preview.
PREVIEW = 1400
MEASURES = (
    "brightness double, contrast double, dark_35 double, dark_8 double, light_250 double, light_248 double, clipped_250 double, blur double, noise double, edge_x double, edge_y double, all_x double, all_y double, "
    "dynamic_range double, colour_cast double, saturation double, saturation_p90 double, channel_spread double, is_monochrome boolean, is_gray_scan boolean, text_edge double, top_edge double, bottom_edge double, top_std double, bottom_std double, top_mean double, middle_mean double, bottom_mean double, horizon_angle double"
)
_NAMES = [x.split(" ")[0] for x in MEASURES.split(", ")]


def orientation(content: bytes) -> int:
    """The EXIF orientation of a JPEG, PNG or TIFF file; 1 where there is none or it can't be read."""
    try:
        if content[:2] == b"\xff\xd8":
            at = 2
            while content[at] == 0xFF and content[at + 1] != 0xDA:
                size = int.from_bytes(content[at + 2 : at + 4], "big")
                if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                    return _tag(content[at + 10 : at + 2 + size])
                at += 2 + size
        elif content[:4] == b"\x89PNG":
            at = 8
            while at + 8 <= len(content):
                size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
                if kind == b"eXIf":
                    return _tag(content[at + 8 : at + 8 + size])
                at += 12 + size
        elif content[:4] in (b"II*\0", b"MM\0*"):
            return _tag(content)
    except (IndexError, struct.error):
        pass
    return 1


def _tag(tiff: bytes) -> int:
    order = "<" if tiff[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(n):
        tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * k)
        if tag == 0x0112:
            return value if 1 <= value <= 8 else 1
    return 1


def horizon(gray: np.ndarray) -> float:
    """Median angle of straight edges within 12 degrees of level: lines with 90 votes or more that span a fifth of the width."""
    least, angles = max(80, gray.shape[1] // 5), []
    if gray.shape[1] <= least:  # no line can span it
        return 0.0
    y, x = np.nonzero(T.edges(gray, 60, 160))
    for degrees in range(-12, 13):
        c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        line = np.rint(y * c - x * s).astype(np.int64)
        if not len(line):
            break
        line -= line.min()
        votes = np.bincount(line)
        first, last = np.full(len(votes), gray.shape[1]), np.zeros(len(votes), np.int64)
        np.minimum.at(first, line, x)
        np.maximum.at(last, line, x)
        angles += [float(degrees)] * int(((votes >= 90) & (last - first >= least)).sum())
    return float(np.median(angles)) if angles else 0.0


def _steps(gray: np.ndarray) -> tuple[float, ...]:
    """Mean differences between neighbours along both axes: those across 8-pixel block edges, then all. None under 24 pixels."""
    if min(gray.shape) < 24:
        return (None,) * 4
    along = [np.abs(np.diff(gray.astype(np.int32), axis=k)) for k in (1, 0)]
    return float(along[0][:, 7::8].mean()), float(along[1][7::8].mean()), float(along[0].mean()), float(along[1].mean())


def _bands(gray: np.ndarray) -> tuple[float, ...]:
    """Shares of edge pixels in per cent (all, top, bottom), deviations (top, bottom) and means (top, middle, bottom) of the screen bands."""
    rows, found = np.arange(len(gray)), T.edges(gray, 70, 150)
    top, bottom = rows < max(30, int(len(gray) * 0.12)), rows >= int(len(gray) * 0.80)
    every = np.ones_like(top)
    middle = ~top & ~bottom if (~top & ~bottom).any() else every
    percent = [100.0 * float(found[part].mean()) if part.any() else 0.0 for part in (every, top, bottom)]
    return (*percent, *(float(gray[part].std()) if part.any() else 0.0 for part in (top, bottom)), *(float(gray[part].mean()) for part in (top, middle, bottom)))


def softened(gray: np.ndarray) -> np.ndarray:
    """Binomial 3 x 3 average in whole levels, rounded half up."""
    pad = T.padded(gray.astype(np.int32), 1, "reflect" if min(gray.shape) > 1 else "edge")
    rows = pad[:-2] + 2 * pad[1:-1] + pad[2:]
    return (rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:] + 8) >> 4


def quality(gray: np.ndarray) -> float:
    """The engine's score of a gray plane, as ``rules.engine_quality`` has it."""
    noise = (gray.astype(np.int32) - softened(gray)).std()
    raw = 35 + min(np.log1p(T.laplacian(gray).astype(np.float64).var()) * 8.2, 41) + min(gray.std() / 55, 1) * 23 - (gray >= 250).mean() * 95 - (gray <= 8).mean() * 80 - max(noise - 8, 0) * 0.9
    return float(np.clip(raw, 0, 100))


def measure_image(img: np.ndarray) -> tuple:
    """The values of MEASURES."""
    gray = T.luma(img)
    scale = min(1.0, PREVIEW / max(gray.shape))
    small = T._bytes(np.rint(T.area_resize(gray, *(max(1, round(n * scale)) for n in gray.shape)))) if scale < 1 else gray
    high, low = img.max(-1).astype(np.int32), img.min(-1).astype(np.int32)
    sat = np.where(high > 0, (510 * (high - low) + high) // (2 * np.maximum(high, 1)), 0)
    means, p90, spread = img.reshape(-1, 3).mean(0), float(np.percentile(sat, 90)), float((high - low).mean())
    share = lambda x: float(x.mean())
    return (
        share(gray), float(gray.std()), share(gray < 35), share(gray <= 8), share(gray > 250), share(gray > 248), share(gray >= 250),
        float(T.laplacian(small).astype(np.float64).var()), float((small.astype(np.int32) - softened(small)).std()), *_steps(gray),
        float(np.percentile(gray, 95) - np.percentile(gray, 5)), float(np.ptp(means)), share(sat), p90, spread, p90 < 18, spread < 9, *_bands(gray), horizon(small),
    )


def inspected(photos: DataFrame) -> DataFrame:
    """Photos (photo_id, height, width, n_channels, data, orientation) as upright three-channel pixels with their measurements; what can't be read keeps a row with error."""
    schema = f"photo_id long, height int, width int, data binary, error string, {MEASURES}"

    def one(photo_id, height, width, channels, data, turned):
        try:
            if (height or 0) <= 0:
                raise ValueError("unreadable image")
            img = T.orient(T.as_bgr(data, height, width, channels), turned or 1)
            return photo_id, img.shape[0], img.shape[1], img.tobytes(), None, *measure_image(img)
        except (ValueError, TypeError) as e:
            return photo_id, None, None, None, str(e), *[None] * len(_NAMES)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), *[pa.bool_() if n.startswith("is_") else pa.float64() for n in _NAMES]]

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for k in range(batch.num_rows):  # large images go on by themselves
                rows.append(one(*(c[k].as_py() for c in batch.columns)))
                size += len(rows[-1][3] or b"")
                if size > 8 << 20 or len(rows) == 256 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["photo_id", "height", "width", "data", "error", *_NAMES])
                    rows, size = [], 0

    c = F.col
    raw = photos.select("photo_id", "height", "width", "n_channels", "data", "orientation").mapInArrow(run, schema)
    steps = [c(n) for n in ("edge_x", "edge_y", "all_x", "all_y")]
    social = rules.ui_social_score(c("top_edge"), c("bottom_edge"), c("top_std"), c("bottom_std"), c("top_mean"), c("middle_mean"), c("bottom_mean"), c("height"), c("width"))
    none = c("all_x").isNull() & c("error").isNull()
    scored = raw.withColumns({"compression_axes": F.when(none, 0.0).otherwise(P.axes_score(*steps)), "compression_pooled": F.when(none, 0.0).otherwise(P.pooled_score(*steps)), "social": F.when(c("error").isNull(), social)})
    return scored.drop("edge_x", "edge_y", "all_x", "all_y", "top_edge", "bottom_edge", "top_std", "bottom_std", "top_mean", "middle_mean", "bottom_mean")


def read_photos(spark: SparkSession, folder: str, exif: bool = True) -> DataFrame:
    """path, photo_id, height, width, n_channels, data, orientation of the image files below a folder, its output folder left out; files that can't be decoded keep a row without pixels. Only orientations are looked up by path."""
    pixels = rasters.decoded(spark, folder, keep_broken=True).where(rasters.is_source(F.col("path"))).withColumn("photo_id", F.xxhash64("path"))
    if not exif:
        return pixels.withColumn("orientation", F.lit(1))

    @F.arrow_udf("int")
    def turned(content: pa.Array) -> pa.Array:
        return pa.array([orientation(c.as_buffer().to_pybytes() if c.is_valid else b"") for c in content], pa.int32())

    heads = rasters.scan_photos(spark, folder).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), turned(F.substring("content", 1, 1 << 16)).alias("orientation"))
    return pixels.join(heads.where("orientation <> 1"), "path", "left").withColumn("orientation", F.coalesce("orientation", F.lit(1)))
